"""News-corpus ETL and analytics on Spark DataFrames and Structured Streaming."""
