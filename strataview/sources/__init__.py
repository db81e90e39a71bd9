"""Where tables live: read-only folders of Parquet files, and versioned tables."""
