"""sigstrata: multi-resolution signal summaries as Spark dataflow."""
