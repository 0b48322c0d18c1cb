"""Version-control history as DataFrames: running git, and parsing its text."""

from __future__ import annotations

import shutil
import subprocess
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tanglemap.scratch import shared_dir

HASH = r"^[0-9a-f]{40}$"


def run_git(root: str, *args: str) -> str:
    """Output of a git command; RuntimeError if git is missing or fails."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
    except FileNotFoundError as missing:
        raise RuntimeError("git is not installed") from missing
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or "git failed")
    return done.stdout


MARK = "\x1e"  # parts the commits of a spooled log


def _spooled(spark: SparkSession, root: str, *args: str) -> str:
    """Output of a git command as a file in the shared folder, piped there in small pieces."""
    uri = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}.txt"
    store, path = arrow_fs.FileSystem.from_uri(uri if "://" in uri else Path(uri).absolute().as_uri())
    store.create_dir(path.rpartition("/")[0], recursive=True)
    try:
        process = subprocess.Popen(["git", "-C", root, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    except FileNotFoundError as missing:
        raise RuntimeError("git is not installed") from missing
    with process, store.open_output_stream(path) as out:
        shutil.copyfileobj(process.stdout, out)
        told = process.stderr.read().decode(errors="replace").strip()
    if process.returncode:
        raise RuntimeError(told or "git failed")
    return uri


def log_lines(spark: SparkSession, root: str, option: str = "--numstat", since: str | None = None) -> DataFrame:
    """``file_no, line_no, line`` of a log: one number a commit, so that commits parse apart.
    The log goes to the shared folder and is read from there, one commit a record, by the
    executors."""
    uri = _spooled(spark, root, "log", option, "--format=%x1e%H", *([f"--since={since}"] if since else []))
    commits = spark.read.option("lineSep", MARK).text(uri).filter(F.length("value") > 0)
    lines = commits.select(F.xxhash64(F.substring("value", 1, 40)).alias("file_no"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return lines.filter(F.length("line") > 0)


def _with_commit(lines: DataFrame) -> DataFrame:
    """Carries each commit line forward over the lines that follow it."""
    order = Window.partitionBy("file_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_commit = F.col("line").rlike(HASH)
    return lines.withColumn("commit_id", F.last(F.when(is_commit, F.col("line")), ignorenulls=True).over(order)).filter(~is_commit & F.col("commit_id").isNotNull())


def parse_numstat(lines: DataFrame) -> DataFrame:
    """``commit_id, file_path, added, deleted``; unless both counts are numbers (they are not
    for a binary file) both are 0."""
    parts = F.split("line", "\t", 3)
    number = lambda i: F.get(parts, F.lit(i)).try_cast("long")
    count = lambda i: F.when(number(0).isNotNull() & number(1).isNotNull(), number(i)).otherwise(F.lit(0).cast("long"))
    rows = _with_commit(lines).filter(F.size(parts) == 3)
    return rows.select("commit_id", F.get(parts, F.lit(2)).alias("file_path"), count(0).alias("added"), count(1).alias("deleted"))


def parse_name_only(lines: DataFrame) -> DataFrame:
    return _with_commit(lines).filter(F.trim("line") != "").select("commit_id", F.col("line").alias("file_path"))


def parse_blame(lines: DataFrame) -> DataFrame:
    """Authors of ``file_path, line_no, line`` rows in porcelain form."""
    return lines.filter(F.col("line").startswith("author ")).select("file_path", "line_no", F.substring("line", 8, 1 << 20).alias("author"))


def blame(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """``file_path, line_no, author``, one git process a file, spread over executors; the
    working tree must be visible there. Files that fail give no row."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch.file_path:
                try:
                    text = run_git(root, "blame", "--line-porcelain", "--", path)
                except RuntimeError:
                    continue
                authors = [line[7:] for line in text.splitlines() if line.startswith("author ")]
                if not authors:  # an empty file
                    continue
                yield pd.DataFrame({"file_path": path, "line_no": range(1, len(authors) + 1), "author": authors})

    return files.select("file_path").mapInPandas(one, "file_path string, line_no int, author string")


def is_work_tree(root: str) -> bool:
    return (Path(root) / ".git").exists()
