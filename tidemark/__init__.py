"""Spark-native analytics for interaction event logs."""
