"""Classifiers trained here, on Spark ML."""
