"""A PySpark-native engine for building, searching and evaluating text corpora."""

__version__ = "0.1.0"
