"""Shared helpers of the corpus operators.

Column policy of all operators: what an operator adds wins over an input column
of the same name (compared without case); all other input columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **used: Column) -> DataFrame:
    """The whole input row as struct ``_row`` beside the columns an operator works on,
    so that no name of the input can clash with a working name."""
    return df.select(F.struct("*").alias("_row"), *[c.alias(k) for k, c in used.items()])


def unpacked(df: DataFrame, names: Sequence[str], **added: Column) -> list[Column]:
    """Columns to select: those of ``_row`` that nothing added shadows, then ``added``."""
    taken = {k.lower() for k in added}
    kept = [F.col("_row")[n].alias(n) for n in names if n.lower() not in taken]
    return [*kept, *[c.alias(k) for k, c in added.items()]]


def hashable(df: DataFrame) -> list[Column]:
    """Columns that ``xxhash64`` takes: all whose type holds no map or variant."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
