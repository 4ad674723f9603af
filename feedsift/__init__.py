"""Feed trust, reconciliation and corpus preparation on Spark."""
