"""Spark-native daily listing-price index engine."""

__version__ = "0.1.0"
