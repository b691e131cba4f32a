"""Spark-native analytics over ledger transactions and network observations."""
