"""Spark-native property-graph analytics."""
