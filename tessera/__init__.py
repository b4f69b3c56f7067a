"""tessera: knowledge-base analytics as Spark DataFrame jobs."""
