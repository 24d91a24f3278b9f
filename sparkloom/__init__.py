"""Spark-native skill registry, document extraction and chat processing."""
