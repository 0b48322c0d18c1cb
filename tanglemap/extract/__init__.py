"""Source files to graph rows."""
