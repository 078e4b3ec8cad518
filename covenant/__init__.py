"""Credit-research analytics as Spark jobs."""
