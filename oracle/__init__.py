"""Reference SQL for the query catalogue, written for DuckDB on the same tables."""
