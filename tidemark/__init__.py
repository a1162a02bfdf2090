"""Spark-native portfolio and market analytics."""
