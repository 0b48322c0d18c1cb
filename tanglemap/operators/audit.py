"""Audit operators: cohesion, cycle pivots, test risk, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tanglemap.operators.components import connected_components


def lcom4(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """Per class the number of groups of methods that calls connect. ``methods(class_name,
    method)``; ``calls(class_name, src, dst)`` inside a class. Methods are
    known by 64-bit hashes, which join and sort faster than names."""
    node = lambda m: F.xxhash64("class_name", m)
    all_methods = methods.select("class_name", node("method").alias("node")).distinct()
    edges = calls.select(node("src").alias("src"), node("dst").alias("dst"))
    found = connected_components(edges)
    placed = all_methods.join(found, "node", "left").select("class_name", F.coalesce("component", "node").alias("component"))
    return placed.distinct().groupBy("class_name").agg(F.count("*").alias("lcom4"))


def cycle_pivots(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """Each cycle's member that most edges from outside the cycle reach (``fan_in``), the file
    to start from; of several the first by name."""
    members = cycles.select("component", F.explode("members").alias("file_path"))
    inner = members.select("component", F.col("file_path").alias("src"), F.lit(True).alias("inside"))
    into = edges.select("src", "dst").join(members, F.col("dst") == F.col("file_path")).join(inner, ["component", "src"], "left").filter("inside is null")
    counted = members.join(into.groupBy("component", "file_path").agg(F.count("*").alias("n")), ["component", "file_path"], "left")
    ranked = counted.select("component", F.struct((-F.coalesce("n", F.lit(0))).alias("less"), "file_path").alias("m"))
    best = ranked.groupBy("component").agg(F.min("m").alias("p"), F.count("*").cast("long").alias("size"))
    return best.select("component", F.col("p.file_path").alias("pivot"), (-F.col("p.less")).cast("long").alias("fan_in"), "size")


def test_risk(metrics: DataFrame, churned: DataFrame, bus: DataFrame, untested: DataFrame, min_fan_out: float = 10, min_churn: int = 10, min_fan_in: float = 10) -> DataFrame:
    """Files with a reason to test first: untested and far-reaching, untested and busy, known
    to one author and depended on."""
    marked = metrics.join(untested.select("file_path").distinct().withColumn("untested", F.lit(True)), "file_path", "left").join(churned.select("file_path", "commits"), "file_path", "left").join(bus.select("file_path", "bus_factor"), "file_path", "left")
    reasons = F.filter(
        F.array(
            F.when(F.col("untested") & (F.col("fan_out") >= min_fan_out), "untested_high_fan_out"),
            F.when(F.col("untested") & (F.col("commits") >= min_churn), "untested_high_churn"),
            F.when((F.col("bus_factor") == 1) & (F.col("fan_in") >= min_fan_in), "single_author_high_fan_in"),
        ),
        lambda r: r.isNotNull(),
    )
    return marked.select("file_path", F.explode(reasons).alias("reason"))


def health_score(findings: DataFrame, *scope: str) -> DataFrame:
    """100 less weighted findings by ``severity``, at least 0, rounded: one row, or one for each
    value of the ``scope`` columns."""
    # Fixed values.
    weight = F.create_map(*[F.lit(x) for pair in {"critical": 15.0, "high": 5.0, "medium": 2.0, "low": 0.5}.items() for x in pair])
    cost = F.coalesce(F.sum(F.coalesce(F.try_element_at(weight, F.col("severity")), F.lit(0.0))), F.lit(0.0))
    return findings.groupBy(*scope).agg(F.round(F.greatest(F.lit(100.0) - cost, F.lit(0.0))).cast("int").alias("health"), F.count("*").alias("findings"))


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Edges ``(src, dst)`` that lead from a lower to a higher layer; ``layers(file_path,
    layer)``, the lowest 0. Files without a layer break no rule."""
    low = layers.select(F.col("file_path").alias("src"), F.col("layer").alias("src_layer"))
    high = layers.select(F.col("file_path").alias("dst"), F.col("layer").alias("dst_layer"))
    met = edges.groupBy("src", "dst").agg(F.count("*").alias("edges")).join(low, "src").join(high, "dst")
    return met.filter("src_layer < dst_layer").select("src", "dst", "src_layer", "dst_layer", "edges")


def main_sequence(metrics: DataFrame, classes: DataFrame) -> DataFrame:
    """Abstractness (share of abstract classes, 0 without classes) and distance from the main
    sequence, ``|abstractness + instability - 1|``; ``classes(file_path, abstract)``."""
    share = classes.groupBy("file_path").agg(F.avg(F.col("abstract").cast("double")).alias("abstractness"))
    a = F.coalesce("abstractness", F.lit(0.0))
    return metrics.join(share, "file_path", "left").select("file_path", a.alias("abstractness"), "instability", F.abs(a + F.col("instability") - 1).alias("distance"))


def churn_trend(history: DataFrame) -> DataFrame:
    """Commits of each file by month, and how they change from month to month: the slope of the
    least-squares line over months with commits, null with fewer than two."""
    month = F.year("ts") * 12 + F.month("ts")
    monthly = history.select("file_path", "commit_id", month.alias("month")).distinct().groupBy("file_path", "month").agg(F.count("*").alias("commits"))
    return monthly.groupBy("file_path").agg(F.count("*").alias("months"), F.sum("commits").alias("commits"), F.regr_slope(F.col("commits").cast("double"), F.col("month").cast("double")).alias("slope"))


def class_coupling(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """Per class ``cbo`` (other classes that it calls or that call it) and ``rfc`` (its methods
    and the distinct methods of other classes that they call). ``methods(method, class_name)``,
    ``calls(src, dst)`` between methods."""
    at = methods.select("method", "class_name").distinct()
    pairs = calls.select("src", "dst").distinct().join(at.toDF("src", "a"), "src").join(at.toDF("dst", "b"), "dst").filter("a <> b")
    both = pairs.select(F.col("a").alias("class_name"), F.col("b").alias("other")).union(pairs.select("b", "a")).distinct().groupBy("class_name").agg(F.count("*").alias("cbo"))
    called = pairs.select(F.col("a").alias("class_name"), "dst").distinct().groupBy("class_name").agg(F.count("*").alias("called"))
    own = at.groupBy("class_name").agg(F.count("*").alias("own"))
    zero = F.lit(0).cast("long")
    return own.join(both, "class_name", "left").join(called, "class_name", "left").select("class_name", F.coalesce("cbo", zero).alias("cbo"), (F.col("own") + F.coalesce("called", zero)).alias("rfc"))


def change_risk(metrics: DataFrame, hot: DataFrame) -> DataFrame:
    """Instability times hotspot score of files that have both."""
    return metrics.select("file_path", "instability").join(hot.select("file_path", "hotspot_score"), "file_path").select("file_path", (F.col("instability") * F.col("hotspot_score")).alias("risk"))
