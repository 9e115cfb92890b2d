"""Spark DataFrame analytics for asset-transfer ledgers."""
