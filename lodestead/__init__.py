"""Evidence-based entity resolution and corpus preparation as Spark jobs."""
