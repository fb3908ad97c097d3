"""Spark-native analytics of connection evidence: packets, exception logs and ping logs."""
