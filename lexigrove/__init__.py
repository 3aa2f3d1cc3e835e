"""Text retrieval on Spark: see README.md."""
