"""Spark-native analytics over wide record tables, and the decisions made from them."""
