"""Sources and sinks: JSON lines, CSV, manifests, and versioned tables on Parquet."""
