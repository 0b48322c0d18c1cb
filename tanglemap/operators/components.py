"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tanglemap.scratch import cut


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` to ``(node, component)``, where the component is the smallest
    node of it. Nodes without a link to another node do not appear; null ends are ignored.

    Alternates large-star and small-star steps until the edge set stays as it is. A round is
    two aggregations and two equi-joins on edge rows; the edges never leave the executors
    and their number never grows. Hubs are joined rows, not gathered groups, so adaptive
    execution can split them. Each round is checkpointed.
    """
    at = cut(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src > dst").distinct())
    before = _signature(at)
    for _ in range(max_rounds):
        both = at.unionByName(at.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.join(low, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.explode(F.array(F.struct("src", F.col("low").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")))).alias("e"))
        at = cut(small.select("e.src", "e.dst").filter("src > dst").distinct())
        now = _signature(at)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return at.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(at.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
