"""Spark-native analytics of network data-plane state."""
