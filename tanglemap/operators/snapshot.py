"""Keyed overwrite, incremental comparison and regression gating between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

TOLERANCE = 0.05


def incremental_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``file_path`` and ``status`` by content hash: new, changed, unchanged or removed. A
    stored hash that is null or empty counts as changed."""
    s = stored.select("file_path", F.nullif("file_hash", F.lit("")).alias("old"), F.lit(True).alias("was"))
    c = current.select("file_path", F.col("file_hash").alias("now"), F.lit(True).alias("is"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").when(F.col("old") == F.col("now"), "unchanged").otherwise("changed")
    return s.join(c, "file_path", "full_outer").select("file_path", status.alias("status"))


def latest_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; ``order`` decides, all other columns break ties."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_last")
    return rows.groupBy(*key).agg(best).select(*[c if c in key else F.col("_last")[c].alias(c) for c in rows.columns])


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """``fresh`` rows replace stored rows of their keys."""
    return stored.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def overwrite_files(stored: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """Replaces all rows of the changed files, also of those that have no fresh row."""
    return stored.join(changed.select("file_path").distinct(), "file_path", "left_anti").select(*stored.columns).unionByName(fresh)


def remove_files(stored: DataFrame, removed: DataFrame) -> DataFrame:
    return stored.join(removed.select("file_path").distinct(), "file_path", "left_anti").select(*stored.columns)


def instability_regressions(baseline: DataFrame, current: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Files of both whose instability exceeds the stored one (kept to 4 digits) by more."""
    before = baseline.select("file_path", F.round("instability", 4).alias("before"))
    out = before.join(current.select("file_path", F.col("instability").alias("now")), "file_path").filter(F.col("now") > F.col("before") + tolerance)
    return out.select("file_path", F.lit("instability").alias("metric"), "before", F.round("now", 4).alias("after"))


def new_rows(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Current keys that the baseline lacks (cycles by sorted members, hubs by path)."""
    return current.select(key).distinct().join(baseline.select(key).distinct(), key, "left_anti")


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each file's metrics between two snapshots; a missing side counts as 0."""
    b = before.select("file_path", *[F.col(c).alias(f"b_{c}") for c in ("fan_in", "fan_out", "instability")])
    a = after.select("file_path", *[F.col(c).alias(f"a_{c}") for c in ("fan_in", "fan_out", "instability")])
    out = b.join(a, "file_path", "full_outer")
    return out.select("file_path", *[(F.coalesce(f"a_{c}", F.lit(0.0)) - F.coalesce(f"b_{c}", F.lit(0.0))).alias(f"d_{c}") for c in ("fan_in", "fan_out", "instability")])


def metadata_get(rows: DataFrame, key: str) -> DataFrame:
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("version")))
    return rows.filter(F.col("key") == key).withColumn("r", last).filter("r = 1").select("key", "value")
