"""Spark-native 3-D spatial index, ray-query and table engine."""
