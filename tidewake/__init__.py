"""Spark-native engine for trajectory data."""
