"""Kernels over binary content: containers, images, audio."""
