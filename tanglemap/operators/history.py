"""Change-history operators: churn, hotspots, co-change, knowledge concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tanglemap.scratch import cut

COVERAGE = 0.8


def since(history: DataFrame, moment: str | None) -> DataFrame:
    """Commits at or after an ISO date or timestamp."""
    return history if moment is None else history.filter(F.col("ts") >= F.lit(moment).cast(history.schema["ts"].dataType))


def churn(history: DataFrame, moment: str | None = None) -> DataFrame:
    """Per file: distinct commits, lines added and deleted."""
    rows = since(history, moment)
    # two partial aggregations instead of a distinct aggregate: one row a (file, commit) before the second shuffle
    once = rows.groupBy("file_path", "commit_id").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    return once.groupBy("file_path").agg(F.count("commit_id").alias("commits"), F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"))


def commit_numbers(history: DataFrame, unit: str = "month") -> DataFrame:
    """``commit_id, ts, period, number``: the commits of each period (such as a month) numbered from
    1 by time. A commit counts from its first moment; without one it has no period."""
    commits = history.groupBy("commit_id").agg(F.min("ts").alias("ts")).filter("commit_id is not null and ts is not null")
    nth = F.row_number().over(Window.partitionBy("period").orderBy("ts", "commit_id"))
    return commits.withColumn("period", F.date_trunc(unit, "ts")).withColumn("number", nth.cast("long"))


def commit_bitmaps(history: DataFrame, numbers: DataFrame) -> DataFrame:
    """``file_path, period, bucket, bits``: which commits of a period touched a file, 32,768 to a
    bitmap. A history that grows adds periods; bitmaps of older ones stay as they are."""
    rows = history.select("commit_id", "file_path").join(numbers.select("commit_id", "period", "number"), "commit_id")
    keyed = rows.select("file_path", "period", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("at"))
    return keyed.groupBy("file_path", "period", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def commits_between(bitmaps: DataFrame, numbers: DataFrame, group: Column, since: str, until: str, unit: str = "month") -> DataFrame:
    """``name, commits``: distinct commits from ``since`` until before ``until`` that touched any file
    of each group (an expression over ``file_path``, such as its folder), exactly. Bitmaps of a
    group are united; those of periods that the window cuts are also cut, by a bitmap of the
    period's commits inside. Commits are never listed again, whatever groups and windows."""
    kind = numbers.schema["ts"].dataType
    start, end = F.lit(since).cast(kind), F.lit(until).cast(kind)
    named = bitmaps.filter((F.col("period") >= F.date_trunc(unit, start)) & (F.col("period") < end))
    united = named.groupBy(group.alias("name"), "period", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    cut_off = (F.col("period") == F.date_trunc(unit, start)) | (F.col("period") == F.date_trunc(unit, end))
    inside = numbers.filter(cut_off & (F.col("ts") >= start) & (F.col("ts") < end)).select("period", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("at"))
    masks = inside.groupBy("period", "bucket").agg(F.bitmap_construct_agg("at").alias("mask"))
    both = united.filter(cut_off).join(masks, ["period", "bucket"]).select("name", "period", "bucket", F.explode(F.array("bits", "mask")).alias("bits"))
    both = both.groupBy("name", "period", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    counted = united.filter(~cut_off).unionByName(both).select("name", F.bitmap_count("bits").alias("n"))
    return counted.groupBy("name").agg(F.sum("n").alias("commits")).filter("commits > 0")


def hotspots(metrics: DataFrame, churned: DataFrame, limit: int | None = None) -> DataFrame:
    """Commits times coupling (fan-in plus fan-out) of files that have both."""
    coupling = F.col("fan_in") + F.col("fan_out")
    out = metrics.join(churned, "file_path").select("file_path", F.col("commits").alias("churn"), coupling.alias("coupling"), (F.col("commits") * coupling).alias("hotspot_score"))
    return out if limit is None else out.orderBy(F.desc("hotspot_score"), "file_path").limit(limit)


HEAVY_FILES = 1_000  # a commit of more files is not squared as a whole
BLOCK_FILES = 500


def _heavy_pairs(heavy: DataFrame, totals: DataFrame, min_shared: int, min_ratio: float) -> DataFrame:
    """``file_a, file_b`` of the files that may share enough of ``heavy(commit_id, file_path, files)``
    without any other commit. Of two files that share ``k`` of them one is, in any one order of
    commits, met before the last ``k - 1`` of either; with the largest commits last, these are
    left out before pairs are made. What is left of a commit is dealt out in pairs of blocks."""
    nth = F.row_number().over(Window.partitionBy("file_path").orderBy("files", "commit_id"))
    held = F.count("*").over(Window.partitionBy("file_path"))
    rows = heavy.withColumns({"nth": nth, "h": held}).join(totals, "file_path")
    needed = F.greatest(F.lit(min_shared), F.ceil(F.lit(min_ratio) * F.col("n") - 1e-9))
    rows = rows.filter(F.col("nth") <= F.col("h") - min_shared + 1).withColumn("leads", F.col("nth") <= F.col("h") - needed + 1)
    sizes = rows.groupBy("commit_id").agg(F.ceil(F.count("*") / BLOCK_FILES).alias("blocks"))
    rows = rows.join(sizes, "commit_id").withColumn("mine", F.pmod(F.xxhash64("file_path"), F.col("blocks")))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("commit_id", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "file_path", "n", "leads")
    pairs = spread.alias("a").join(spread.alias("b"), ["commit_id", "low", "high"])
    # in a pair of two blocks only files of different blocks meet; those of one meet where both numbers are equal
    pairs = pairs.filter("a.file_path < b.file_path and (low = high or a.mine <> b.mine)").filter("case when a.n < b.n then a.leads when a.n > b.n then b.leads else a.leads and b.leads end")
    return pairs.select(F.col("a.file_path").alias("file_a"), F.col("b.file_path").alias("file_b")).distinct()


def _shared_heavy(pairs: DataFrame, heavy: DataFrame) -> DataFrame:
    """How many commits of ``heavy`` each of ``pairs(file_a, file_b)`` shares, if any."""
    of = lambda side: heavy.select("commit_id", F.col("file_path").alias(side))
    return pairs.join(of("file_a"), "file_a").join(of("file_b"), ["file_b", "commit_id"]).groupBy("file_a", "file_b").agg(F.count("*").alias("heavy"))


def temporal_coupling(history: DataFrame, min_shared: int = 5, min_ratio: float = 0.3, exclude: DataFrame | None = None, jaccard: bool = False, heavy_files: int = HEAVY_FILES) -> DataFrame:
    """Pairs of files that change together: ``shared_commits`` and its ratio to the rarer
    file's commits, tested before rounding. ``exclude(file_a, file_b)`` drops pairs, such as
    those with a direct import, in either order.

    Files with fewer than ``min_shared`` commits are in no pair and go before any pair is made;
    counting combines before the shuffle, and the support threshold comes before the joins
    with commit counts. ``jaccard`` relates the shared commits to those of either file.

    Commits of at most ``heavy_files`` such files are joined with themselves. Larger ones only
    add to pairs that these make and that can still reach both thresholds, and to those of
    :func:`_heavy_pairs`; no task makes more than ``BLOCK_FILES`` squared pairs of a commit."""
    files = history.select("commit_id", "file_path").distinct()
    totals = files.groupBy("file_path").agg(F.count("*").alias("n")).filter(F.col("n") >= min_shared)
    files = files.join(totals.select("file_path"), "file_path", "left_semi")
    large = cut(files.groupBy("commit_id").agg(F.count("*").alias("files")).filter(F.col("files") > heavy_files))
    any_large = not large.isEmpty()
    light = files.join(large, "commit_id", "left_anti") if any_large else files
    pairs = light.alias("a").join(light.alias("b"), "commit_id").filter("a.file_path < b.file_path")
    shared = pairs.groupBy(F.col("a.file_path").alias("file_a"), F.col("b.file_path").alias("file_b")).agg(F.count("*").alias("shared_commits"))

    def counted(rows: DataFrame) -> DataFrame:
        return rows.join(totals.withColumnsRenamed({"file_path": "file_a", "n": "n_a"}), "file_a").join(totals.withColumnsRenamed({"file_path": "file_b", "n": "n_b"}), "file_b")

    if any_large:
        heavy = cut(files.join(large, "commit_id"))
        held = heavy.groupBy("file_path").agg(F.count("*").alias("h"))
        most = shared.join(held.toDF("file_a", "h_a"), "file_a", "left").join(held.toDF("file_b", "h_b"), "file_b", "left")
        reach = F.col("shared_commits") + F.least(F.coalesce("h_a", F.lit(0)), F.coalesce("h_b", F.lit(0)))
        hopeful = counted(most).filter((reach >= min_shared) & (reach >= F.lit(min_ratio) * F.least("n_a", "n_b") - 1e-9))
        light_pairs = cut(hopeful.select("file_a", "file_b", "shared_commits"))
        found = light_pairs.select("file_a", "file_b").union(_heavy_pairs(heavy, totals, min_shared, min_ratio)).distinct()
        both = found.join(light_pairs, ["file_a", "file_b"], "left").join(_shared_heavy(found, heavy), ["file_a", "file_b"], "left")
        zero = F.lit(0).cast("long")
        shared = both.select("file_a", "file_b", (F.coalesce("shared_commits", zero) + F.coalesce("heavy", zero)).alias("shared_commits"))
    shared = shared.filter(F.col("shared_commits") >= min_shared)
    if exclude is not None:
        either = exclude.select("file_a", "file_b").unionByName(exclude.select(F.col("file_b").alias("file_a"), F.col("file_a").alias("file_b")))
        shared = shared.join(either, ["file_a", "file_b"], "left_anti")
    ratio = F.col("shared_commits") / (F.col("n_a") + F.col("n_b") - F.col("shared_commits") if jaccard else F.least("n_a", "n_b"))
    return counted(shared).filter(ratio >= min_ratio).select("file_a", "file_b", "shared_commits", F.round(ratio, 4).alias("coupling_ratio"))


def author_lines(blame: DataFrame) -> DataFrame:
    return blame.groupBy("file_path", "author").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"))


def bus_factor(blame: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Per file: the author of most lines (ties: first seen), their share in percent, and the
    fewest authors who together hold ``coverage`` of the lines."""
    by_size = Window.partitionBy("file_path").orderBy(F.desc("lines"), "first_line", "author")
    whole = Window.partitionBy("file_path")
    ranked = author_lines(blame).select(
        "file_path",
        "author",
        "lines",
        F.row_number().over(by_size).alias("rank"),
        F.sum("lines").over(by_size.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("lines").over(whole).alias("total"),
    )
    enough = F.min(F.when(F.col("upto") / F.col("total") >= coverage, F.col("rank")))
    top = F.max(F.when(F.col("rank") == 1, F.struct("author", "lines", "total")))
    out = ranked.groupBy("file_path").agg(top.alias("t"), enough.alias("bus_factor"))
    return out.select("file_path", F.col("t.author").alias("top_author"), F.round(100.0 * F.col("t.lines") / F.col("t.total"), 1).alias("top_author_pct"), "bus_factor")


def top_author(blame: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("lines"), "first_line", "author"))
    return author_lines(blame).withColumn("rank", rank).filter("rank = 1").select("file_path", F.col("author").alias("top_author"), "lines")
