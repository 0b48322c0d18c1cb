"""Structured Streaming forms of the history operators."""
