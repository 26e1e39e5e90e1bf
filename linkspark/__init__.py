"""Spark-native analytics for road-link travel-time observations."""

__version__ = "0.1.0"
