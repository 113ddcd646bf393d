"""Scans (feeds, regions, model answers) and versioned Parquet tables."""
