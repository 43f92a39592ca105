"""Materials analytics on Spark."""
