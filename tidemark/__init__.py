"""Spark-first analytics over ordered OHLCV series."""
