"""Consumer-panel and survey analytics as plain Spark DataFrame jobs."""
