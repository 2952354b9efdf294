"""Sources and sinks: scans of files and object stores, and versioned Parquet tables."""
