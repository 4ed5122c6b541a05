"""Retrieval and knowledge analytics as Spark jobs."""
