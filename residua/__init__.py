"""Spark-native operators for keyed, ordered and point-cloud measurement tables."""
