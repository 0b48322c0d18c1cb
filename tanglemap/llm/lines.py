"""Line deduplication within a small edit distance, in DataFrame operations alone.

Segment-partition join: a line is split into ``tau + 1`` segments, so that any line
within ``tau`` edits holds one of them unchanged, at a place its length allows. Keys of
(length, segment number, substring) find such pairs; a banded bit-parallel edit distance
verifies them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tanglemap.operators.components import connected_components

TAU = 2  # edits at most
PER_EDIT = 6  # characters that a line must have for each edit that still leaves a near copy
BLOCK = 64  # lines of one key that one task compares with as many others
LETTERS = "eatnorishdlu"  # their counts bound the edit distance from below


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edit_distance_within(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of arrays of characters, if ``tau`` at most, else some larger number.

    Bit ``i`` of the two delta words stands for row ``j - tau + i`` of column ``j``, so the
    band moves with the diagonal and ``2 * tau + 1`` bits do for any length. The distance is
    followed along the diagonal that ends in the last cell; it never falls there, so a pair
    beyond ``tau`` costs next to nothing from then on.
    """
    bits = 2 * tau + 1
    mask = (1 << bits) - 1
    shift = F.size(a) - F.size(b)

    def match(j: Column, c: Column) -> Column:
        out = None
        for i in range(bits):
            bit = F.when(F.get(a, j - tau + i - 1) == c, F.lit(1 << i)).otherwise(F.lit(0))
            out = bit if out is None else out.bitwiseOR(bit)
        return out

    def word(x: Column) -> Column:
        return x.bitwiseAND(F.lit(mask))

    def step(state: Column, j: Column) -> Column:
        vp, vn = state["vp"], state["vn"]

        def moved(pm: Column) -> Column:
            diagonal = word((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn))

            def after(d0: Column) -> Column:
                hp = word(vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))))
                hn = d0.bitwiseAND(vp)
                down = F.shiftright(d0, 1)
                on = F.shiftright(d0, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(bits)]), shift + tau + 1))
                counts = (j + shift >= 1) & (on == 0)
                return F.struct(
                    word(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)))).alias("vp"),
                    down.bitwiseAND(hp).alias("vn"),
                    (state["d"] + counts.cast("int")).alias("d"),
                )

            return _let(diagonal, after)

        return F.when(state["d"] > tau, state).otherwise(_let(match(j, F.get(b, j - 1)), moved))

    first = F.struct(F.lit(mask ^ ((1 << tau) - 1)).alias("vp"), F.lit(0).alias("vn"), F.abs(shift).alias("d"))
    ends = F.aggregate(F.sequence(F.lit(1), F.size(b)), first, step)["d"]
    trivial = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(F.abs(shift) > tau, F.abs(shift)).when(trivial, F.greatest(F.size(a), F.size(b))).otherwise(ends)


def _core(a: Column, b: Column) -> Column:
    """Both arrays without their common front."""
    same = F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True), F.lit(0)).cast("int")
    start = F.when(same > 0, same).otherwise(F.greatest(F.size(a), F.size(b)) + 1)
    return F.struct(F.slice(a, start, F.size(a) + 1).alias("a"), F.slice(b, start, F.size(b) + 1).alias("b"))


def char_edits(a: Column, b: Column, tau: int) -> Column:
    """As :func:`edit_distance_within`; only what differs is aligned."""

    def backward(front: Column) -> Column:
        return _let(_core(F.reverse(front["a"]), F.reverse(front["b"])), lambda p: edit_distance_within(p["a"], p["b"], tau))

    return _let(_core(a, b), backward)


def within_edits(x: Column, y: Column, tau: int) -> Column:
    """Whether two strings are within ``tau`` edits."""
    return _let(F.struct(F.split(x, "").alias("a"), F.split(y, "").alias("b")), lambda p: char_edits(p["a"], p["b"], tau)) <= tau


def edits_allowed(a: Column, b: Column, tau: int, per_edit: int) -> Column:
    """Edits between near copies of these lengths: one for each ``per_edit`` characters of the
    shorter line, ``tau`` at most."""
    return F.least(F.lit(tau), F.floor(F.least(a, b) / per_edit))


def _keys(line: Column, tau: int) -> Column:
    """Index keys of the line's own segments and probe keys for lines of its length down to
    ``tau`` less; a probe at the segment's own place in an equally long line is its index key."""
    length = F.length(line)
    out = []
    for less in range(tau + 1):
        target = length - less
        short = F.floor(target / (tau + 1)).cast("int")
        longer = target % (tau + 1)  # so many segments, the last ones, have one character more
        for i in range(1, tau + 2):
            wide = F.greatest(F.lit(0), longer - (tau + 1 - i))
            size = short + F.when(F.lit(i) > (tau + 1) - longer, 1).otherwise(0)
            begin = short * (i - 1) + F.greatest(F.lit(0), wide - F.when(F.lit(i) > (tau + 1) - longer, 1).otherwise(0)) + 1
            low, high = max(-(i - 1), less - (tau + 1 - i)), min(i - 1, less + (tau + 1 - i))
            for offset in range(low, high + 1):
                own = less == 0 and offset == 0
                out.append(F.struct(F.xxhash64(F.lit(i), target, F.substring(line, begin + offset, size)).alias("key"), F.lit(own).alias("own")))
    return F.array(*out)


def near_line_pairs(lines: DataFrame, tau: int = TAU, per_edit: int = PER_EDIT) -> DataFrame:
    """``lines(h, line)``, one row a distinct line, to pairs ``(src, dst)`` of hashes of lines
    within :func:`edits_allowed`. Lines of one key meet in blocks of bounded size; a pair whose
    lengths and letter counts allow the distance is verified there, and only true pairs leave a
    block. Segments are exact from ``tau + 1`` characters on, so ``per_edit`` must be more than
    ``tau``; a line too short for one edit has no near copy."""
    if per_edit <= tau:
        raise ValueError("per_edit must be more than tau")
    lines = lines.filter(F.length("line") >= per_edit)
    counts = [(F.length("line") - F.length(F.replace(F.col("line"), F.lit(c), F.lit("")))).cast("int") for c in LETTERS]
    shape = F.array(F.length("line"), *counts)
    keyed = lines.select("h", _keys(F.col("line"), tau).alias("ks"))  # a projection of its own shares subexpressions
    keyed = keyed.select("h", F.explode("ks").alias("k")).select("h", "k.key", "k.own")
    by_key = Window.partitionBy("key")
    met = keyed.withColumn("rows", F.count("*").over(by_key)).filter("rows > 1")
    # few lines meet another, so only these bring their text along
    met = met.join(lines.select("h", "line"), "h").select("key", F.pmod(F.col("h"), F.ceil(F.col("rows") / BLOCK)).alias("block"), F.struct("h", "own", shape.alias("shape"), "line").alias("x"))
    blocks = met.groupBy("key", "block").agg(F.collect_list("x").alias("xs"))
    own = blocks.filter(F.exists("xs", lambda x: x["own"])).select("key", F.filter("xs", lambda x: x["own"]).alias("ys"))
    parted = lambda xs: F.transform(xs, lambda x: F.struct(x["h"].alias("h"), x["shape"].alias("shape"), F.split(x["line"], "").alias("chars")))
    blocks = blocks.join(own, "key").select(parted("xs").alias("xs"), parted("ys").alias("ys"))

    def near(x: Column, y: Column) -> Column:
        drift = F.aggregate(F.zip_with(F.slice(x["shape"], 2, len(LETTERS)), F.slice(y["shape"], 2, len(LETTERS)), lambda p, q: F.abs(p - q)), F.lit(0), lambda s, v: s + v)
        allowed = (x["h"] != y["h"]) & (F.abs(x["shape"][0] - y["shape"][0]) <= tau) & (drift <= 2 * tau)
        edits = edits_allowed(x["shape"][0], y["shape"][0], tau, per_edit)
        return F.when(allowed, char_edits(x["chars"], y["chars"], tau) <= edits).otherwise(False)

    pair = lambda x: F.transform(F.filter("ys", lambda y: near(x, y)), lambda y: F.struct(F.least(x["h"], y["h"]).alias("src"), F.greatest(x["h"], y["h"]).alias("dst")))
    return blocks.select(F.explode(F.flatten(F.transform("xs", pair))).alias("p")).select("p.src", "p.dst").distinct()


def duplicate_lines(docs: DataFrame, *, tau: int = TAU, per_edit: int = PER_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row an id: the id column, ``n_lines``, ``n_exact`` and ``n_near`` (lines dropped as
    equal, or only near, to the line that stays) and ``dropped`` (their numbers from 0, sorted).

    Lines are split at ``\\n``; one of white space alone never drops. Equal lines are one
    class; lines within ``tau`` edits, and one edit for each ``per_edit`` characters of the
    shorter, join classes, and so on transitively. Of a class the line of the smallest (id, number) stays, a null id before
    others. Rows of equal id count as one document whose line numbers coincide; all lines of
    a null text, there are none, and an empty text has one blank line. Other columns do not
    pass through. An empty table gives an empty table.

    Texts move once, as distinct lines (each task combines its own first); after that only
    hashes move, and the texts of candidate pairs. A line that a third of the corpus shares
    is one row of the join. Exact up to 64-bit hashing of lines.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("no", "line"))
    occurs = rows.select("id", "no", F.xxhash64("line").alias("h"), "line", F.trim("line") == "")
    occurs = occurs.toDF("id", "no", "h", "line", "blank")
    lines = occurs.filter(~F.col("blank")).groupBy("h").agg(F.first("line").alias("line"))
    classes = connected_components(near_line_pairs(lines, tau, per_edit)).select(F.col("node").alias("h"), "component")

    placed = occurs.filter(~F.col("blank")).select("id", "no", "h").join(classes, "h", "left").select("id", "no", "h", F.coalesce("component", "h").alias("class"))
    stays = placed.groupBy("class").agg(F.min(F.struct("id", "no", "h")).alias("s"), F.count("*").alias("n")).filter("n > 1").select("class", "s")
    drops = placed.join(stays, "class").filter(~(F.col("id").eqNullSafe(F.col("s.id")) & (F.col("no") == F.col("s.no")))).select("id", "no", (F.col("h") == F.col("s.h")).alias("exact"))
    drops = drops.groupBy("id").agg(F.array_sort(F.collect_set("no")).alias("dropped"), F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_near"))
    sizes = docs.select(F.col(id_col).alias("id"), F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0)).cast("long").alias("n")).groupBy("id").agg(F.sum("n").alias("n_lines"))
    out = sizes.join(drops, sizes.id.eqNullSafe(drops.id), "left")
    zero = F.lit(0).cast("long")
    return out.select(sizes.id.alias(id_col), "n_lines", F.coalesce("n_exact", zero).alias("n_exact"), F.coalesce("n_near", zero).alias("n_near"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def deduplicate_lines(docs: DataFrame, *, tau: int = TAU, per_edit: int = PER_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that :func:`duplicate_lines` names."""
    found = duplicate_lines(docs, tau=tau, per_edit=per_edit, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("_id"), F.col("dropped").alias("_dropped"))
    packed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    joined = packed.join(found, F.col("_key").eqNullSafe(F.col("_id")), "left")
    numbered = F.transform(F.split("_text", "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    kept = F.filter(numbered, lambda x: ~F.array_contains("_dropped", x["i"]))
    text = F.when(F.size("_dropped") > 0, F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).otherwise(F.col("_text"))
    return joined.select(*[(text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
