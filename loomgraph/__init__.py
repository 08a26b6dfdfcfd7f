"""Spark-native curation of evidence-backed knowledge graphs."""
