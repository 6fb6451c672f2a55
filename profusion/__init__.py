"""Spark-native entity resolution and profile analytics."""
