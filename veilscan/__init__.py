"""veilscan: a PySpark-native analytics engine for screening untrusted content."""

__version__ = "0.1.0"
