"""Queries over the Parquet tables and the SQL they are checked against."""
