"""Source trees as DataFrames."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tanglemap.functions.paths import base_name, ignored, language_of
from tanglemap.scratch import cut

# Fixed values.
SKIPPED_FOLDERS = (
    ".git", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "node_modules", ".next", ".nuxt", "dist", "build",
    ".tox", ".venv", "venv", "env", ".env", ".idea", ".vscode", "coverage", ".eggs",
)
SKIPPED_FILES = (".DS_Store", "Thumbs.db")

FOLDERS_IN_TASK = 256
FILES_IN_TASK = 512


def _spread(rows: DataFrame, in_task: int) -> DataFrame:
    return rows.repartition(max(1, -(-rows.count() // in_task)), "path")


def _listed(uri: str):
    """Children of each folder: ``path`` (relative to the root) and ``is_folder``."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = arrow_fs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder in batch.path:
                found = store.get_file_info(arrow_fs.FileSelector(f"{root}/{folder}" if folder else root, allow_not_found=True))
                names = [(f"{folder}/{f.base_name}" if folder else f.base_name, f.type == arrow_fs.FileType.Directory) for f in found if f.type != arrow_fs.FileType.NotFound]
                yield pd.DataFrame(names, columns=["path", "is_folder"]).astype({"path": object, "is_folder": bool})

    return listed


def _contents(uri: str):
    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = arrow_fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path in batch.path:
                with store.open_input_stream(f"{root}/{path}") as stream:
                    raw = stream.read()
                yield pd.DataFrame({"path": [path], "text": [raw.decode("utf-8", "replace")], "file_hash": [hashlib.sha256(raw).hexdigest()]})

    return contents


def list_files(spark: SparkSession, root: str, patterns: Sequence[str] = ()) -> DataFrame:
    """``path`` (relative) of the files that have a parser, without hidden and skipped folders
    and what ``patterns`` ignore. Folders are listed level by level on the executors, and only
    those that count, so a skipped folder is never opened. Names that begin with ``_`` count
    like others (Spark's own readers would hide them)."""
    uri = root if "://" in root else Path(root).absolute().as_uri()
    level = spark.createDataFrame([("",)], "path string")
    found = spark.createDataFrame([], "path string")
    unwanted = ignored(F.col("path"), patterns)
    while not level.isEmpty():
        children = cut(_spread(level, FOLDERS_IN_TASK).mapInPandas(_listed(uri), "path string, is_folder boolean").filter(~unwanted))
        found = found.unionByName(children.filter(~F.col("is_folder")).select("path"))
        name = base_name(F.col("path"))
        level = children.filter(F.col("is_folder") & ~name.startswith(".") & ~name.isin(*SKIPPED_FOLDERS)).select("path")
    return found.filter(~base_name(F.col("path")).isin(*SKIPPED_FILES) & language_of(F.col("path")).isNotNull())


def scan_files(spark: SparkSession, root: str, patterns: Sequence[str] = ()) -> DataFrame:
    """``path`` (relative), ``text`` and ``file_hash`` (of the bytes) of :func:`list_files`.
    Bytes that are no UTF-8 become replacement characters. The store must be one that Arrow
    opens on the executors: mounted folders, HDFS, S3, GCS."""
    uri = root if "://" in root else Path(root).absolute().as_uri()
    return _spread(list_files(spark, root, patterns), FILES_IN_TASK).mapInPandas(_contents(uri), "path string, text string, file_hash string")


def read_patterns(text: str) -> list[str]:
    return [line.strip() for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]
