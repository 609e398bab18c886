"""Road-network workload analytics on Spark."""
