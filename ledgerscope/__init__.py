"""Spark-native forensics over ledger-style transaction data."""

__version__ = "0.1.0"
