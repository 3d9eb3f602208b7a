"""Spark-native talent-screening analytics."""
