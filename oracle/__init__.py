"""Independent SQL for every query, run by DuckDB on the same tables."""
