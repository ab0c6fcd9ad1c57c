"""The query catalogue: each query with its DuckDB twin."""
