"""Spark-native hybrid text search and analytics over multilingual article collections."""

__version__ = "0.1.0"
