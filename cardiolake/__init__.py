"""Spark-native analytics for long cardiac recordings."""
