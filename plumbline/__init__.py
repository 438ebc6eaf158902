"""Spark-native preparation, encoding and evaluation of annotated drawings."""
