"""Long-term-memory retrieval and analytics as Spark DataFrame plans."""
