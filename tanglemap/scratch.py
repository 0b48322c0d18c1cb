"""Lineage cuts in the folder that all executors share.

A cluster names that folder in ``spark.checkpoint.dir``, or its user by ``setCheckpointDir``.
Only where neither is and driver and executors are one process (a laptop) a folder of our
own is used.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

FALLBACK_DIR = "/tmp/checkpoints/tanglemap"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_workspace: ContextVar[str | None] = ContextVar("workspace", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets the checkpoint directory where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    given = spark.sparkContext.getCheckpointDir()
    if given is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(FALLBACK_DIR)
        given = spark.sparkContext.getCheckpointDir()
    return given.rstrip("/")


def scratch_folder(spark: SparkSession, label: str, kept: bool = False) -> str:
    """The path of a new folder, not made yet, in the shared one; in the workspace's, unless ``kept``."""
    return f"{not kept and _workspace.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def workspace(spark: SparkSession, label: str) -> Iterator[None]:
    """Tables stored inside lie in one folder, which is removed at the end, and shuffle files go as
    soon as the query that wrote them has ended. So nothing lazy over such tables may leave."""
    folder, before = scratch_folder(spark, label), spark.conf.get(SHUFFLE_CLEANUP, None)
    inside = _workspace.set(folder)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        _workspace.reset(inside)
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
        _remove(spark, folder)


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: the rows are stored once and lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Table:
    """A Parquet table in the shared folder, removed with :meth:`drop`.

    Columnar and compressed, so it suits large intermediate results; small ones
    go through :func:`cut`.
    """

    def __init__(self, df: DataFrame, label: str, kept: bool = False):
        self.spark = df.sparkSession
        self.path = scratch_folder(self.spark, label, kept)
        df.write.parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)
