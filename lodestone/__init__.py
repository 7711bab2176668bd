"""Lodestone: a Spark-native engine for corpora of source files and documents."""

__version__ = "0.1.0"
