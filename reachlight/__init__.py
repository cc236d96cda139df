"""Spark-native reachability and listing analytics."""
