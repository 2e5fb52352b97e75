"""Table-to-table operators: DataFrames in, lazy DataFrames out."""
