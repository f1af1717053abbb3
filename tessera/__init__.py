"""Spark-native text, vector and knowledge analytics."""
