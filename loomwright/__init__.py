"""Spark-native text, calendar and reconciliation operators."""
