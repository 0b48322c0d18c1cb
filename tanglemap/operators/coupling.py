"""Structural coupling: import resolution, fan-in, fan-out, instability, hubs, inheritance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tanglemap.functions.paths import module_name
from tanglemap.operators.order_stats import order_statistics
from tanglemap.scratch import cut

WEIGHTS = {"IMPORTS_FROM": 1.0, "USES_TYPE": 1.0}


def module_map(files: DataFrame) -> DataFrame:
    """Dotted module to file; of files with one name the first by path."""
    return files.groupBy(module_name(F.col("file_path")).alias("module")).agg(F.min("file_path").alias("file_path"))


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``edges(src, dst, ..)`` with ``resolved``: the file an import means, or null if external.

    In this order: the target is a file; it is a known module; it starts with dots, each of
    which drops a part of the source's path; it has no dot and names a sibling module. All
    four are equi-joins on candidate names, so the work is linear in the edges."""
    known = module_map(files)
    paths = files.select(F.col("file_path").alias("p0")).distinct()
    parts = F.split("src", "/")
    dots = F.length(F.regexp_extract("dst", r"^(\.*)", 1))
    rest = F.regexp_replace("dst", r"^\.+", "")
    package = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.greatest(dots, F.lit(1)), F.lit(0))), ".")
    relative = F.when(dots > 0, F.concat_ws(".", F.when(package != "", package), F.when(rest != "", rest)))
    sibling = F.when((F.instr("dst", ".") == 0) & (package != ""), F.concat(package, F.lit("."), F.col("dst")))
    out = edges.withColumns({"m2": F.col("dst"), "m3": relative, "m4": sibling}).join(paths, F.col("dst") == F.col("p0"), "left")
    for m in ("m2", "m3", "m4"):
        out = out.join(known.select(F.col("module").alias(f"{m}_name"), F.col("file_path").alias(f"{m}_file")), F.col(m) == F.col(f"{m}_name"), "left")
    return out.select(*edges.columns, F.coalesce("p0", "m2_file", "m3_file", "m4_file").alias("resolved"))


def _weighted(edges: DataFrame) -> DataFrame:
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return edges.filter(F.col("kind").isin(*WEIGHTS)).withColumn("weight", F.element_at(weight, F.col("kind")))


def fan_out(edges: DataFrame) -> DataFrame:
    """Weighted out-edges, external targets and repeats included."""
    return _weighted(edges).groupBy(F.col("src").alias("file_path")).agg(F.sum("weight").alias("fan_out"))


def fan_in(edges: DataFrame, target: str = "dst") -> DataFrame:
    return _weighted(edges).filter(F.col(target).isNotNull()).groupBy(F.col(target).alias("file_path")).agg(F.sum("weight").alias("fan_in"))


def module_metrics(files: DataFrame, edges: DataFrame, target: str = "dst") -> DataFrame:
    """Per file: fan-in, fan-out and instability, which is 0 for an isolated file."""
    out = files.select("file_path").distinct().join(fan_in(edges, target), "file_path", "left").join(fan_out(edges), "file_path", "left")
    ca, ce = F.coalesce("fan_in", F.lit(0.0)), F.coalesce("fan_out", F.lit(0.0))
    return out.select("file_path", ca.alias("fan_in"), ce.alias("fan_out"), F.when(ca + ce > 0, ce / (ca + ce)).otherwise(0.0).alias("instability"))


def _place(size, percentile: int):
    """Rank below an exclusive quantile of ``size`` values, and hundredths on to the next."""
    j = min(max(percentile * (size + 1) // 100, 1), size - 1)
    return j, percentile * (size + 1) - j * 100


def god_modules(metrics: DataFrame, percentile: int = 90) -> DataFrame:
    """Files whose fan-in exceeds the exclusive quantile of all fan-ins (interpolated between
    order statistics, extrapolated at the ends). Fewer than two files give none.

    The two order statistics come from :func:`tanglemap.operators.order_stats.order_statistics`."""
    if not 1 <= percentile <= 99:
        raise ValueError("percentile must be from 1 to 99")
    values = cut(metrics.select("fan_in"))
    size = values.count()
    if size < 2:
        return metrics.select("file_path", "fan_in", "fan_out", "instability").limit(0)
    j, delta = _place(size, percentile)
    low, high = order_statistics(values, "fan_in", [j, j + 1])
    return metrics.filter(F.col("fan_in") > (low * (100 - delta) + high * delta) / 100).select("file_path", "fan_in", "fan_out", "instability")


def above_quantile(metrics: DataFrame, tally: DataFrame, percentile: int = 90) -> DataFrame:
    """:func:`god_modules` with the quantile from ``tally(fan_in, n)``, a row for each value of
    fan-in, whose number goes with the largest fan-in and not with the files."""
    upto = F.sum("n").over(Window.orderBy("fan_in").rowsBetween(Window.unboundedPreceding, 0))
    size = tally.agg(F.sum("n").alias("n")).first()["n"] or 0
    if size < 2:
        return metrics.select("file_path", "fan_in", "fan_out", "instability").limit(0)
    j, delta = _place(size, percentile)
    ranked = tally.withColumn("upto", upto)
    low, high = ranked.agg(*[F.min(F.when(F.col("upto") >= r, F.col("fan_in"))).alias(f"r{r}") for r in (j, j + 1)]).first()
    return metrics.filter(F.col("fan_in") > (low * (100 - delta) + high * delta) / 100).select("file_path", "fan_in", "fan_out", "instability")


def flagged_modules(metrics: DataFrame, instability: float = 0.8, percentile: int = 90) -> DataFrame:
    """Hubs, and used files that are at least so unstable."""
    gods = god_modules(metrics, percentile).select("file_path", F.lit(True).alias("is_god"))
    out = metrics.join(gods, "file_path", "left").withColumn("is_god", F.coalesce("is_god", F.lit(False)))
    return out.filter(F.col("is_god") | ((F.col("fan_in") > 0) & (F.col("instability") >= instability)))


def class_children(classes: DataFrame, inherits: DataFrame) -> DataFrame:
    """Direct subclasses of each class, one an edge."""
    counts = inherits.groupBy(F.col("dst").alias("qualified_name")).agg(F.count("*").alias("children"))
    return classes.select("qualified_name").distinct().join(counts, "qualified_name", "left").select("qualified_name", F.coalesce("children", F.lit(0)).cast("long").alias("children"))


def _climbed(parent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``parent(src, dst)``, one row a class, to ``(src, top, steps)``: the end of each walk over
    parents and its length; and the classes ``(src)`` whose walk has none, as it meets a cycle.

    Pointer doubling: a round joins walks with walks. While a walk that ends is still open,
    each round closes some; so a round that closes none leaves only those that meet a cycle."""
    walk = cut(parent.select("src", F.col("dst").alias("top"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open")))
    before = None
    while True:
        ahead = walk.select(F.col("src").alias("at"), F.col("top").alias("next"), F.col("steps").alias("more"))
        joined = walk.join(ahead, walk.top == ahead["at"], "left")
        walk = cut(joined.select("src", F.coalesce("next", "top").alias("top"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("at").isNotNull().alias("open")))
        still = walk.filter("open").count()
        if still in (0, before):
            return walk.filter("not open").select("src", "top", "steps"), walk.filter("open").select("src")
        before = still


def _cycles_of(parent: DataFrame) -> DataFrame:
    """``parent(src, dst)`` of classes whose walks all meet a cycle, to the classes on one:
    ``(top, length)``. As many steps as there are classes lead from anywhere onto a cycle, and
    from all of its classes to all of them."""
    size = parent.count()
    walk, length = parent.select("src", F.col("dst").alias("top"), F.least("src", "dst").alias("low")), 1
    while length < size:
        ahead = walk.select(F.col("src").alias("top"), F.col("top").alias("next"), F.col("low").alias("lower"))
        walk = cut(walk.join(ahead, "top").select("src", F.col("next").alias("top"), F.least("low", "lower").alias("low")))
        length *= 2
    on = walk.select("top").distinct()
    named = walk.join(on.withColumnRenamed("top", "src"), "src", "left_semi").select(F.col("src").alias("top"), "low")
    return named.join(named.groupBy("low").agg(F.count("*").alias("length")), "low").select("top", "length")


def inheritance_metrics(classes: DataFrame, inherits: DataFrame) -> DataFrame:
    """Depth (length of the walk over parents, an external parent included, a cycle cut at
    the first class met again) and direct children of each class. ``inherits(src, dst, id)``:
    of several parents the edge of greatest id counts.

    There is no limit of depth: about ``log2`` of the longest walk rounds of one join each. A
    walk that meets a cycle has the length of its way there and the cycle's."""
    parent = cut(inherits.groupBy("src").agg(F.max_by("dst", F.struct("id", "dst")).alias("dst")))
    ended, endless = _climbed(parent)
    depths = ended.select("src", F.col("steps").alias("depth"))
    if not endless.isEmpty():
        caught = cut(parent.join(endless, "src", "left_semi"))
        cycles = cut(_cycles_of(caught))
        tails, _ = _climbed(caught.join(cycles.select(F.col("top").alias("src")), "src", "left_anti"))
        depths = depths.unionByName(cycles.select(F.col("top").alias("src"), F.col("length").alias("depth"))).unionByName(tails.join(cycles, "top").select("src", (F.col("steps") + F.col("length")).alias("depth")))
    out = class_children(classes, inherits).join(depths.withColumnRenamed("src", "qualified_name"), "qualified_name", "left")
    return out.select("qualified_name", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), "children")
