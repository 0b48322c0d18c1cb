"""Queries over the TPC-H-like tables and their DuckDB equivalents."""
