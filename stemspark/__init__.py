"""Spark-native point-cloud measurement engine."""
