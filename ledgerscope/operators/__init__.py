"""Table-to-table operators. Each takes and returns lazy DataFrames."""
