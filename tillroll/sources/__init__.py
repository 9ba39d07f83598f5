"""Sources (parquet tables, CSV files, sample data) and sinks (JSON, Parquet history)."""
