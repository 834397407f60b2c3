"""Spark-native detection and redaction of personal data in text columns."""
