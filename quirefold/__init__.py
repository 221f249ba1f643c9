"""Document-to-workflow analytics on PySpark."""
