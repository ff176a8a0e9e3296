"""Lodestone: documentation search and corpus analytics as Spark jobs."""
