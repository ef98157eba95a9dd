"""Schedule-delay analytics as PySpark DataFrame jobs."""
