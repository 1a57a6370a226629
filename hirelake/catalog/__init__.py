"""Registered report queries (Spark) and their DuckDB oracles."""
