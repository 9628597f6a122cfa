"""A Spark engine for site-compliance and task analytics."""
