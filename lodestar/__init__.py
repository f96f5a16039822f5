"""Lodestar: directory search, log analytics and curation as Spark jobs."""
