"""Incremental execution: versioned state, engine, watermarks and pipelines."""
