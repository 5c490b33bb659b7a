"""Spark-native analytics for plate-imaging examinations."""

__version__ = "0.1.0"
