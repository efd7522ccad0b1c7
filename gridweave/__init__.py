"""Table reshaping on Spark: mapping, deduplication, row positions, column types."""
