"""Spark-first analytics for walk-forward mean-reversion studies."""
