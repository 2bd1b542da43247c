"""Spark-native analytics for subscription catalogs: capacity, value scores, rankings and data quality."""
