"""Spark-native analytics over spatial capture and flood tables."""
