"""Coupling metrics kept up to date by signed changes instead of the whole graph.

The state is a row a file with its sums, and a row a value of fan-in with the number of
files that have it. A change is an edge with a sign: -1 for what a file had, +1 for what it
has now. Sums take signed changes as they come, so the work goes with the changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tanglemap.operators import coupling
from tanglemap.scratch import cut


@dataclass
class MetricState:
    """``sums(file_path, fan_in, fan_out)`` of every file with an edge, known or not, and
    ``tally(fan_in, n)`` of the known files."""

    files: DataFrame
    sums: DataFrame
    tally: DataFrame

    def metrics(self) -> DataFrame:
        """As :func:`tanglemap.operators.coupling.module_metrics`."""
        zero = F.lit(0.0)
        out = self.files.join(self.sums, "file_path", "left").select("file_path", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))
        both = F.col("fan_in") + F.col("fan_out")
        return out.withColumn("instability", F.when(both > 0, F.col("fan_out") / both).otherwise(0.0))


def _sums(changes: DataFrame) -> DataFrame:
    """``file_path, fan_in, fan_out`` of edges ``src, target, kind, sign``, summed."""
    weighted = coupling._weighted(changes)
    amount = F.col("weight") * F.col("sign")
    zero = F.lit(0.0)
    both = weighted.select(F.explode(F.array(F.struct(F.col("target").alias("file_path"), amount.alias("fan_in"), zero.alias("fan_out")), F.struct(F.col("src").alias("file_path"), zero.alias("fan_in"), amount.alias("fan_out")))).alias("e"))
    return both.select("e.*").filter("file_path is not null").groupBy("file_path").agg(F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out"))


def _tally(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("fan_in").agg(F.count("*").alias("n"))


def metric_state(files: DataFrame, edges: DataFrame, target: str = "dst") -> MetricState:
    """From all ``edges(src, kind, <target>)``; ``files(file_path)`` are those that are known."""
    known = files.select("file_path").distinct()
    sums = _sums(edges.select("src", F.col(target).alias("target"), "kind", F.lit(1).alias("sign")))
    state = MetricState(known, sums, _tally(known.limit(0).select(F.lit(0.0).alias("fan_in"))))
    return MetricState(known, sums, _tally(state.metrics()))


def edge_changes(before: DataFrame, now: DataFrame, changed: DataFrame, target: str = "dst") -> DataFrame:
    """``src, target, kind, sign`` of the edges that ``changed(file_path)`` had and have; edges of
    other files are not read beyond that filter. Equal edges on both sides cancel out."""
    of = changed.select(F.col("file_path").alias("src")).distinct()
    rows = [df.join(of, "src", "left_semi").select("src", F.col(target).alias("target"), "kind", F.lit(sign).alias("sign")) for df, sign in ((before, -1), (now, 1))]
    summed = rows[0].unionByName(rows[1]).groupBy("src", "target", "kind").agg(F.sum("sign").alias("sign"))
    return summed.filter("sign <> 0")


def resolution_changes(edges: DataFrame, files: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The signed changes of edges of files that stay, where files that come or go change what an
    import means: of ``edges(src, dst, kind)`` only those whose target can name such a file
    are resolved, against ``files`` (before) and against the files after."""
    turned = added.select("file_path").union(removed.select("file_path")).distinct()
    stays = edges.join(turned.withColumnRenamed("file_path", "src"), "src", "left_anti").select("src", "dst", "kind")
    after = files.select("file_path").join(removed.select("file_path"), "file_path", "left_anti").union(added.select("file_path")).distinct()
    # a target that names a file ends like its path or its dotted module, or is all dots
    last = lambda c: F.lower(F.element_at(F.split(c, r"[./]"), -1))
    module = coupling.module_name(F.col("file_path"))
    named = turned.select(F.explode(F.array(last(module), last(F.col("file_path")), F.lit(""))).alias("last")).distinct()
    touched = cut(stays.withColumn("last", last(F.col("dst"))).join(named, "last", "left_semi").select("src", "dst", "kind"))
    sides = [coupling.resolve_imports(touched, known).select("src", F.col("resolved").alias("target"), "kind", F.lit(sign).alias("sign")) for known, sign in ((files, -1), (after, 1))]
    return sides[0].unionByName(sides[1]).groupBy("src", "target", "kind").agg(F.sum("sign").alias("sign")).filter("sign <> 0")


def apply_changes(state: MetricState, changes: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> MetricState:
    """The state after ``changes(src, target, kind, sign)`` and after files came and went. Rows that
    come to nothing go; only sums of files that change, and their counts, move."""
    files = state.files
    if removed is not None:
        files = files.join(removed.select("file_path"), "file_path", "left_anti")
    if added is not None:
        files = files.union(added.select("file_path")).distinct()
    moved = cut(_sums(changes))
    sums = state.sums.unionByName(moved).groupBy("file_path").agg(F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out")).filter("fan_in <> 0 or fan_out <> 0")

    touched = moved.select("file_path")
    for turned in (added, removed):
        touched = touched if turned is None else touched.union(turned.select("file_path"))
    touched = cut(touched.distinct())
    signed = []
    for at, sign in ((MetricState(state.files, state.sums, state.tally), -1), (MetricState(files, sums, state.tally), 1)):
        some = MetricState(at.files.join(touched, "file_path", "left_semi"), at.sums.join(touched, "file_path", "left_semi"), at.tally)
        signed.append(some.metrics().select("fan_in", F.lit(sign).cast("long").alias("n")))
    tally = state.tally.select("fan_in", "n").unionByName(signed[0]).unionByName(signed[1]).groupBy("fan_in").agg(F.sum("n").alias("n")).filter("n <> 0")
    return MetricState(files, sums, tally)


def god_modules(state: MetricState, percentile: int = 90) -> DataFrame:
    """As :func:`tanglemap.operators.coupling.god_modules`, with the threshold from the tally."""
    return coupling.above_quantile(state.metrics(), state.tally, percentile)
