"""DuckDB oracle SQL for the parity check (test side, not library code)."""
