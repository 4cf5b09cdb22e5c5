"""A PySpark-native engine for document semantics."""

__version__ = "0.1.0"
