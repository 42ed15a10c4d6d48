"""Storage: databases, column families and their versioned tables of Parquet segments."""
