"""Test support: the DuckDB oracle SQL for every registered query."""
