"""Tabular feature engineering and model-evaluation analytics as Spark DataFrame jobs."""
