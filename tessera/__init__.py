"""Tessera: a Spark-native engine for source-tree analytics."""
