"""Incremental analytics on PySpark."""
