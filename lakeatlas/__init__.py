"""Schema-catalogue analytics on Spark."""
