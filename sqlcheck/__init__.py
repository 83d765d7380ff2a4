"""DuckDB oracle SQL for the driver's correctness check (not part of the library)."""
