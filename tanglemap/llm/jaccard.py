"""Exact n-gram Jaccard join by a token-group matrix.

Documents with the same shingle set are one class. Classes are partitioned into
groups of similar ones, each led by the class that its members resemble most. The
matrix holds, for each shingle, the groups whose members have it in the part of a
global order (frequent shingles last) that any link must touch. A class counts its
shared shingles with each larger group's union there; only groups whose count
reaches the least that a linked member would give are opened. In a group, classes
are held as their differences from the leader.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tanglemap.llm.shingles import shingle_sets
from tanglemap.operators.components import connected_components
from tanglemap.scratch import Table, cut

MAX_HOT = 200_000  # bound of the broadcast list of frequent shingles: 1.6 MB
FIRSTS = 32  # near copies share most of so many first shingles, texts with a passage in common do not
HOT_IN_BATCH, HOT_IN_ALL = 3, 32  # groups of a part of a batch, and of all parts counted
ROWS_HELD = 2_000
RECENTRED = 16  # members from which a group looks for its middle again
MAX_WANTED = 1_000_000  # keys of texts to be compared that are broadcast: some 20 MB


def required(n: int, num: int, den: int) -> int:
    """Least overlap of a linked pair whose one set has ``n`` shingles."""
    return -(-num * n // den)


def _slack(n):
    return 1 + n // 40


def _prefix(n: int, num: int, den: int) -> int:
    return min(n, n - required(n, num, den) + _slack(n))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``ROWS_HELD`` rows, so that a worker holds the shingles of few texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_HELD):
            yield batch.slice(start, ROWS_HELD)


def _raws(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def hot_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles that many different documents have, most frequent first up
    to a fixed bound. They only fix the global order, so any list gives right results. All
    documents are seen; in a batch, one of whose first shingles more than half are first in those
    before (a near copy, mostly) is not counted, and shingles of fewer than three of the others
    stay out of the sum. A passage in common makes no near copy, however its hashes fall."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            firsts: set[int] = set()
            sets: list[np.ndarray] = []
            for s in shingle_sets(_raws(batch.column(0)), k):
                head = s[:FIRSTS].tolist()
                if head and 2 * len(firsts.intersection(head)) <= len(head):
                    sets.append(s)
                firsts.update(head)
            values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            del sets
            values.sort()  # in place, as memory allows no second copy of a batch's shingles
            starts = np.flatnonzero(np.r_[len(values) > 0, values[1:] != values[:-1]])
            n = np.diff(np.append(starts, len(values)))
            often = n >= HOT_IN_BATCH
            yield pa.RecordBatch.from_arrays([pa.array(values[starts[often]].astype(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])

    sums = texts.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = sums.filter(F.col("n") >= HOT_IN_ALL).orderBy(F.desc("n"), "token").limit(MAX_HOT)
    return np.sort(np.array([r[0] for r in top.select("token").collect()], dtype=np.uint64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)


def _index_rows(k: int, num: int, den: int, hot):
    """Each text's class row, and for the first text of a class in a task its matrix rows."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _parts(batches):
            rows, tokens, owners, sizes = [], [], [], []
            keys, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for key, name, s in zip(keys, ids, shingle_sets(_raws(batch.column(0)), k, hot.value), strict=True):
                n = len(s)
                if not n:
                    rows.append((key, None, 0, name))
                    continue
                cls = _class_of(s)
                rows.append((key, cls, n, name))
                if cls in seen:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(cls)
                head = _signed(s[: _prefix(n, num, den)])
                tokens.append(head)
                owners.append(np.full(len(head), cls))
                sizes.append(np.full(len(head), n, dtype=np.int32))
            key, cls, n, name = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array([False] * len(rows)), pa.array(key, pa.int64()), pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(name, pa.int64())], INDEX_COLUMNS)
            if tokens:
                t = np.concatenate(tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(t), dtype=bool)), pa.array(t), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes)), pa.nulls(len(t), pa.int64())], INDEX_COLUMNS
                )

    return index


INDEX_COLUMNS = ["matrix", "key", "cls", "n", "id"]


def _arrays(k: int, hot):
    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets = [_signed(s) for s in shingle_sets(_raws(batch.column(0)), k, hot.value)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["cls", "arr"])

    return arrays


class _Bounds:
    """Bounds of sizes and overlaps as columns, for links at ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n: Column) -> Column:
        """Smallest set that can link with one of ``n``; :meth:`most` the largest."""
        return F.ceil(self.num * n / self.den).cast("long")

    def most(self, n: Column) -> Column:
        return F.floor(self.den * n / self.num).cast("long")

    def slack(self, n: Column) -> Column:
        return F.floor(n / 40).cast("long") + 1

    def prefix(self, n: Column) -> Column:
        return F.least(n, n - self.least(n) + self.slack(n)).cast("long")

    def overlap(self, a: Column, b: Column) -> Column:
        """Least overlap of linked sets of these sizes."""
        return F.ceil(self.num * (a + b) / (self.num + self.den)).cast("long")

    def apart(self, a: Column, b: Column) -> Column:
        """Most shingles that only one of two linked sets of these sizes has."""
        return F.floor((self.den - self.num) * (a + b) / (self.den + self.num)).cast("long")

    def fits(self, n: Column, low: Column, high: Column) -> Column:
        return (self.most(n) >= low) & (self.least(n) <= high)

    def shared(self, n: Column, low: Column, high: Column) -> Column:
        """Least number of shingles that the prefixes of a set of ``n`` and of a linked one,
        of a size from ``low`` to ``high``, have in common. Both hold an initial part of the
        overlap in the global order: what the overlap needs and the rest of the set cannot
        give. The first side's share grows with the other's size, the second's falls with it
        but for rounding (3 at most)."""
        low, high = F.greatest(low, self.least(n)), F.least(high, self.most(n))
        mine = self.overlap(n, low) - n + self.prefix(n)
        other = self.overlap(n, high) - high + self.prefix(high) - F.when(low < high, 3).otherwise(0)
        return F.greatest(F.lit(1), F.least(mine, other))


def _leaders(rows: DataFrame, b: _Bounds, num: int, den: int) -> DataFrame:
    """``rows(token, cls, n, s, common)`` to ``(cls, grp)``: a class joins the leader that most
    classes could join, if it shares half of its shared shingles with it; else it leads
    itself. The leader of a shingle, among classes of like size, is the one whose shingles
    are the most common: the middle of a family of near copies, which all its members meet."""
    rows = rows.withColumn("band", F.floor(F.log("n") / math.log(den / num)).cast("int"))
    typical = F.col("common") / b.prefix(F.col("n")) + F.pmod("cls", F.lit(1 << 20)) / float(1 << 41)
    best = rows.groupBy("token", "band").agg(F.max_by("cls", typical).alias("leader"))
    met = rows.join(best, ["token", "band"]).filter("cls <> leader").groupBy("cls", "leader").agg(F.count("*").alias("c"), F.max("s").alias("s"), F.max("n").alias("n"))
    met = cut(met.filter((F.col("c") >= b.slack(F.col("n"))) & (2 * F.col("c") >= F.col("s"))).select("cls", "leader"))
    drawn = cut(met.groupBy("leader").agg(F.count("*").alias("drawn")))
    own = drawn.select(F.col("leader").alias("cls"), F.col("drawn").alias("own"))
    top = met.join(drawn, "leader").groupBy("cls").agg(F.max(F.struct("drawn", "leader")).alias("top")).join(own, "cls", "left")
    follows = F.col("top") > F.struct(F.coalesce("own", F.lit(0).cast("long")).alias("drawn"), F.col("cls").alias("leader"))
    return top.filter(follows).select("cls", F.col("top.leader").alias("grp"))


def _visits(rows: DataFrame, sizes: DataFrame, b: _Bounds) -> DataFrame:
    """``rows(token, cls, n, s, grp)`` to ``(cls, grp)``: the larger groups whose union shares so
    many prefix shingles with a class that a member may link with it."""
    rows = rows.join(sizes, "grp")
    union = rows.groupBy("token", "grp", "members").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("s").alias("most"))
    several = union.groupBy("token").agg(F.min("grp").alias("a"), F.max("grp").alias("z")).filter("a <> z").select("token")
    union = union.join(several, "token", "left_semi").toDF("token", "to", "to_members", "low", "high", "most")
    n = F.col("n")
    larger = F.struct("to_members", "to") > F.struct("members", "grp")
    may = b.fits(n, F.col("low"), F.col("high")) & (b.shared(n, F.col("low"), F.col("high")) <= F.least("s", "most"))
    met = rows.join(union, (rows.token == union.token) & larger & may).select("cls", "to", "n", "low", "high")
    met = met.groupBy("cls", "to").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return met.filter(F.col("c") >= b.shared(n, F.col("low"), F.col("high"))).select("cls", F.col("to").alias("grp"))


def _recentred(entries: DataFrame) -> DataFrame:
    """``entries`` of larger groups as differences from the member in the very middle: the one
    that differs least from what most members hold. Leaders are chosen by prefixes, which
    many near copies have in common with the middle; this only lessens the work of
    :func:`_open`."""
    large = cut(entries.filter("home").groupBy("grp").agg(F.count("*").alias("members")).filter(F.col("members") >= RECENTRED))
    spread = entries.filter("home").join(large, "grp").select("grp", "cls", "members", "diff").repartition("grp", "cls")  # not by group alone
    tokens = spread.select("grp", "members", F.explode("diff").alias("token"))
    most = tokens.groupBy("grp", "token").agg(F.count("*").alias("holders"), F.first("members").alias("members")).filter(2 * F.col("holders") > F.col("members"))
    most = cut(most.groupBy("grp").agg(F.collect_list("token").alias("most")))  # one row a group, no longer than two of its mean differences
    held = F.size(F.array_intersect("diff", "most"))
    off = F.col("d") + F.size("most") - 2 * held
    ranked = entries.filter("home").join(most, "grp").select("grp", F.size("most").alias("size"), F.struct(off.alias("off"), "cls").alias("m"))
    best = ranked.groupBy("grp", "size").agg(F.min("m").alias("m")).filter("m.off < size").select("grp", "m.cls")
    middle = entries.join(cut(best), ["grp", "cls"]).select("grp", F.col("n").alias("m_n"), F.col("diff").alias("m_diff"), F.col("cls").alias("m_cls"))
    out = entries.join(cut(middle), "grp", "left")
    moved = F.concat(F.array_except("diff", "m_diff"), F.array_except("m_diff", "diff"))
    diff = F.when(F.col("m_cls").isNull(), F.col("diff")).otherwise(moved)
    return out.select("grp", "cls", "home", "n", F.coalesce("m_n", "ln").alias("ln"), diff.alias("diff"), F.coalesce("m_cls", "grp").alias("leader")).withColumn("d", F.size("diff").cast("long"))


def _open(entries: DataFrame, b: _Bounds) -> DataFrame:
    """``entries(grp, cls, home, n, ln, d, diff)``, classes compared with their groups' leaders,
    to links ``(src, dst)`` that do not lead over the leader.

    Two sets differ in what just one of their differences from the leader holds. So a class
    that is no near copy of the leader can only link with a member of which it shares a
    stated part of the difference, and the first common shingle, the group's rarest first,
    comes early in both. Shingles that only one class of the group has drop out unseen.

    What is counted by group is stored before it is joined back, so that each join has
    exchanges of its own and adaptive execution can split a large group."""
    d, n = F.col("d"), F.col("n")
    far = d > b.apart(n, F.col("ln"))
    entries = entries.withColumn("far", far).withColumn("reach", b.apart(n, b.most(n)))
    met = entries.filter("home or not far")  # what visitors that are far from the leader meet, and members that are far
    top = met.groupBy("grp").agg(F.max(F.struct("d", "cls")).alias("top"))
    rest = met.join(top, "grp").filter("cls <> top.cls").groupBy("grp").agg(F.max("d").alias("next"))
    widest = F.when(F.col("cls") == F.col("top.cls"), F.col("next")).otherwise(F.col("top.d"))
    kept = entries.join(cut(top.join(rest, "grp", "left")), "grp").withColumn("asks", F.col("far") & F.coalesce(d - F.col("reach") <= widest, F.lit(False))).drop("top", "next")
    asked = cut(kept.filter("asks").select("grp").distinct())
    kept = cut(kept.filter("home or asks or not far").join(asked, "grp", "left_semi").repartition("grp", "cls"))  # not by group alone

    tokens = kept.select("grp", "cls", "home", "asks", "n", "ln", "d", "reach", "far", F.explode("diff").alias("token"))
    often = cut(tokens.groupBy("grp", "token").agg(F.count("*").alias("df")).filter("df > 1"))
    tokens = tokens.join(often, ["grp", "token"])
    each = Window.partitionBy("grp", "cls")
    tokens = tokens.withColumn("at", F.row_number().over(each.orderBy("df", "token"))).withColumn("of", F.count("*").over(each))
    tokens = cut(tokens.withColumn("at", F.col("at") - 1 + d - F.col("of")))  # read as probes and as index
    surplus = F.greatest(F.lit(0), n - F.col("ln"))
    probes = tokens.filter("asks and at <= reach").select("grp", "token", F.col("home").alias("x_home"), *[F.col(c).alias(f"x_{c}") for c in ("cls", "n", "d", "at")])
    index = tokens.filter((F.col("home") | ~F.col("far")) & (F.col("at") <= d - F.greatest(F.lit(1), F.ceil((d + 1 - surplus) / 2)))).select("grp", "token", "asks", *[F.col(c).alias(f"y_{c}") for c in ("cls", "n", "d", "at")])
    x, y = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    most = b.apart(x("n"), y("n"))
    common = F.greatest(F.lit(1), F.ceil((x("d") + y("d") - most) / 2))
    may = (x("cls") != y("cls")) & (~F.col("asks") | ~F.col("x_home") | (x("cls") > y("cls"))) & (F.abs(x("d") - y("d")) <= most) & (x("at") <= x("d") - common) & (y("at") <= y("d") - common)
    pairs = probes.alias("p").join(index.alias("i"), (F.col("p.grp") == F.col("i.grp")) & (F.col("p.token") == F.col("i.token")) & may).select("p.grp", "x_cls", "y_cls", most.alias("most")).distinct()
    side = lambda c: kept.select("grp", F.col("cls").alias(f"{c}_cls"), F.col("diff").alias(f"{c}_diff"))
    both = pairs.join(side("x"), ["grp", "x_cls"]).join(side("y"), ["grp", "y_cls"])
    gap = F.size("x_diff") + F.size("y_diff") - 2 * F.size(F.array_intersect("x_diff", "y_diff"))
    return both.filter(gap <= F.col("most")).select(F.col("x_cls").alias("src"), F.col("y_cls").alias("dst"))


def jaccard_components(docs: DataFrame, *, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the id column, ``n_shingles`` and ``component_id``, the smallest id
    reachable by links. Documents link when ``den`` times the intersection of their shingle
    sets is at least ``num`` times the union.

    Words are split at ASCII white space, A-Z lower-cased; a document of fewer than ``k`` words
    is one shingle, one without words, or with a null text, is empty and linked with nothing.
    Equal sets (exact copies among them) are one class and always together. Repeated rows each
    give a row. A null id takes part and gets its component's smallest id, if it has one. Ids
    are integers. Other columns do not pass through. An empty table gives an empty table.

    Exact up to 64-bit hashing of shingles and sets. The hot list only orders shingles, and
    the choice of groups only decides the work: any pair that can link is compared in the
    group of one of them. No group is gathered: members are compared with their leader, a
    row each, and further only through shingles of their differences from it, so a family of
    near copies costs by its members. A task holds a batch of texts.
    """
    spark = docs.sparkSession
    b = _Bounds(num, den)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    texts = texts.withColumn("key", F.xxhash64("text"))
    hot = spark.sparkContext.broadcast(hot_shingles(texts, k))

    index = Table(texts.select("text", "key", "id").mapInArrow(_index_rows(k, num, den, hot), "matrix boolean, key long, cls long, n int, id long"), "shingle-index")
    matrix = index.read().filter("matrix").select(F.col("key").alias("token"), "cls", F.col("n").cast("long").alias("n"))
    met = matrix.groupBy("token").agg(F.min("cls").alias("a"), F.max("cls").alias("z"), F.count("*").alias("df")).filter("a <> z").select("token", "df")
    shared = Table(matrix.join(met, "token").distinct(), "shared-shingles")
    by_text = cut(index.read().filter("not matrix").groupBy("key").agg(F.first("cls").alias("cls"), F.first("n").alias("n"), F.min("id").alias("one")))
    index.drop()

    n = F.col("n")
    alive = shared.read().groupBy("cls").agg(F.count("*").alias("s"), F.sum(F.log2("df")).alias("common"), F.first("n").alias("n"))
    alive = alive.filter(F.col("s") >= b.shared(n, b.least(n), b.most(n))).select("cls", "s", "common")
    rows = Table(shared.read().drop("df").join(alive, "cls"), "live-shingles")
    shared.drop()
    follows = cut(_leaders(rows.read(), b, num, den))
    placed = rows.read().join(follows, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    placed = Table(placed, "grouped-shingles")
    rows.drop()
    sizes = cut(placed.read().select("cls", "grp").distinct().groupBy("grp").agg(F.count("*").alias("members")))
    visits = _visits(placed.read(), sizes, b)
    seats = cut(follows.withColumn("home", F.lit(True)).unionByName(visits.withColumn("home", F.lit(False))))
    placed.drop()

    wanted = seats.select("cls").union(seats.select("grp")).distinct()
    wanted = cut(by_text.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("key", "one")).alias("r")).join(wanted, "cls", "left_semi").select("cls", "r.key", "r.one"))
    read = texts.select("text", "key", "id")
    if wanted.count() <= MAX_WANTED:  # else the texts are shuffled by the join below
        read = read.join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi")
    read = read.join(wanted, (read.key == wanted.key) & read.id.eqNullSafe(wanted.one)).select("text", "cls")
    arrays = Table(read.mapInArrow(_arrays(k, hot), "cls long, arr array<long>").dropDuplicates(["cls"]), "shingle-sets")

    mine = arrays.read()
    leader = arrays.read().select(F.col("cls").alias("grp"), F.col("arr").alias("l_arr"))
    diff = F.concat(F.array_except("arr", "l_arr"), F.array_except("l_arr", "arr"))
    entries = seats.join(mine, "cls").join(leader, "grp").select("grp", "cls", "home", F.size("arr").cast("long").alias("n"), F.size("l_arr").cast("long").alias("ln"), diff.alias("diff"))
    entries = Table(entries.withColumn("d", F.size("diff").cast("long")), "differences")
    arrays.drop()
    near = F.col("d") <= b.apart(n, F.col("ln"))
    middles = Table(_recentred(entries.read()), "middles")
    links = entries.read().filter(near).select(F.col("cls").alias("src"), F.col("grp").alias("dst"))
    links = links.unionByName(middles.read().filter(near).select(F.col("cls").alias("src"), F.col("leader").alias("dst")))
    found = connected_components(links.unionByName(_open(middles.read(), b)))
    entries.drop()
    middles.drop()

    labelled = by_text.join(found, by_text.cls == found.node, "left").select("key", F.coalesce("component", "cls").alias("component"), "n")
    out = cut(texts.select("id", "key").join(labelled, "key", "left"))
    least = out.filter("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    out = out.join(least, "component", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))
