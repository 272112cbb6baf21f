"""Readers and writers: planning cube from the given tables, CSV/Parquet in, result bundle out."""
