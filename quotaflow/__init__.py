"""quotaflow: sales analytics as Spark jobs (tables, CDC, metrics, retrieval, monitoring)."""
