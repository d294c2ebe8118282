"""DuckDB statements that state each registered query's result independently of Spark."""
