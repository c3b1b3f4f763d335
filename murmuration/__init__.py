"""Social-content analytics as Spark jobs."""
