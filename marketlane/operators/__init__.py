"""Set-based shop operators: DataFrames in, DataFrames out."""
