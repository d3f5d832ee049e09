"""Catalog search, recommendation and profile analytics as Spark DataFrame jobs."""
