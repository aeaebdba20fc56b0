"""Spark-native catalogue, reconciliation and text-corpus analytics."""
