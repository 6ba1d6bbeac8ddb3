"""Book ingestion, hybrid search and event projections as Spark jobs."""
