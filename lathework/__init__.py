"""lathework: a PySpark-native engine for messy tabular data."""

__version__ = "0.1.0"
