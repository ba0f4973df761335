"""Spark-native analytics over dated, two-sided records."""
