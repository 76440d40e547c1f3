"""Document retrieval and data processing expressed as Spark jobs."""
