"""Flight-operations analytics as Spark DataFrame jobs."""
