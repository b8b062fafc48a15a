"""Repository facts and corpus preparation as Spark jobs."""
