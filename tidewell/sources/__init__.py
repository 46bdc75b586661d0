"""Sources and sinks: Parquet tables, and the row-log format."""
