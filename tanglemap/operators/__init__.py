"""Operators over node, edge, history and text DataFrames."""
