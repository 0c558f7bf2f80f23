"""Sources and sinks: driver tables, NDJSON(.zst) records, Parquet/JSON writers."""
