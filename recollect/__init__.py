"""Vector-memory retrieval, evidence verification and corpus preparation on Spark."""
