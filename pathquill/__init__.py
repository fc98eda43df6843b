"""Path-query engine for JSON documents and typed tables on PySpark."""
