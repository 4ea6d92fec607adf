"""Mail filtering on Spark: messages as tables, policies as columns."""
