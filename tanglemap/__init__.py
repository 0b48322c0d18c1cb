"""Spark-native analytics for dependency graphs, change history and text corpora.

Every operator is a function from DataFrames (plus parameters) to a DataFrame,
so that operators compose with ``DataFrame.transform`` and Catalyst sees one
declarative plan.
"""

from importlib import import_module

__version__ = "0.2.0"

_HOMES = {"Catalog": "sources.catalog", "EDGE_KINDS": "extract.rows", "NODE_KINDS": "extract.rows", "extract_sources": "extract.rows", "scan_files": "sources.files"}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    """Public names are imported on first use, so Python workers load only what they run."""
    if name in _HOMES:
        return getattr(import_module(f"tanglemap.{_HOMES[name]}"), name)
    raise AttributeError(name)
