"""Sensitive-data detection, redaction, reversal and audit on Spark."""
