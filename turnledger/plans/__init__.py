"""Reports: each function takes turns and sessions and returns lazy DataFrames."""
