"""A Spark-first transformation and analytics engine."""
