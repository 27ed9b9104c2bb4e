"""Spark-native document search, scoring and workflow analytics."""
