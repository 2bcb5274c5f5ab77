"""Tabular analytics and model comparison as Spark DataFrame jobs."""
