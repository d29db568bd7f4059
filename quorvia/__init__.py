"""Spark-native analytics over answer distributions."""
