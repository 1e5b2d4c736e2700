"""Spark-native engine for building and auditing text-pair corpora."""
