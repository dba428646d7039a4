"""Evidence retrieval and citation analytics on Spark."""
