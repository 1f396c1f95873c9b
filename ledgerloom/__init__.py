"""Spark-native operators for financial ledgers and the documents they come from."""
