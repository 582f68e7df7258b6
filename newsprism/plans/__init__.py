"""Query catalog (Spark side) and the matching DuckDB oracle SQL."""
