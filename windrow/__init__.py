"""windrow: a PySpark-native engine for auditing text corpora and evaluation tables."""

__version__ = "0.1.0"
