"""Spark-native code search, code-graph analytics and corpus preparation."""
