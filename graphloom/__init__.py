"""Code-structure graph analytics on Spark."""
