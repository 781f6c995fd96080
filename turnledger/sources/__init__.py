"""Log files in, history tables in and out."""
