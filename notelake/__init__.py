"""Spark-native analytics over versioned notice corpora."""
