"""Code-graph retrieval and analytics on Spark."""
