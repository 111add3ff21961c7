"""Evidence retrieval, longitudinal analytics and training-data operators as Spark jobs."""
