"""Exact order statistics by distributed selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

ACCURACY = 10_000  # of the sketch: a bracket keeps about 4 rows of so many
FEW = 1_000  # rows of a bracket that are brought together and sorted


@dataclass
class _Bracket:
    rank: int
    low: float
    high: float
    below: int  # rows less than ``low``
    inside: int  # rows from ``low`` to ``high``


def order_statistics(rows: DataFrame, column: str, ranks: Sequence[int]) -> list[float | None]:
    """The values of these ranks (1 is the smallest) of a numeric column, None beyond its rows.
    Nulls have no rank; equal values take a rank each.

    A sketch of what a bracket holds gives two values around the rank, one pass counts what is
    below and between them, and so on until few rows or one value is left: some three passes
    for any size, each a map-side aggregate. Neither a sort nor a window runs over all rows."""
    value = F.col(column).cast("double")
    rows = rows.select(value.alias("v")).filter("v is not null")
    all_of = rows.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    brackets = {r: _Bracket(r, all_of["low"], all_of["high"], 0, all_of["n"]) for r in set(ranks) if 1 <= r <= all_of["n"]}
    found: dict[int, float] = {}
    while True:
        for r, b in brackets.items():
            if r not in found and (b.low == b.high or b.inside <= FEW):
                near = [b.low] * b.inside if b.low == b.high else sorted(x["v"] for x in rows.filter(F.col("v").between(b.low, b.high)).collect())
                found[r] = near[r - b.below - 1]
        wide = [b for r, b in brackets.items() if r not in found]
        if not wide:
            return [found.get(r) for r in ranks]
        guesses = rows.agg(*[F.percentile_approx(F.when(F.col("v").between(b.low, b.high), F.col("v")), F.array(*map(F.lit, _around(b))), F.lit(ACCURACY)).alias(f"p{b.rank}") for b in wide]).first()
        tried = {b.rank: guesses[f"p{b.rank}"] for b in wide}
        counts = []
        for r, (low, high) in tried.items():
            counts += [F.count_if(F.col("v") < low).alias(f"b{r}"), F.count_if(F.col("v").between(low, high)).alias(f"i{r}")]
        told = rows.agg(*counts).first()
        for b in wide:
            low, high = tried[b.rank]
            below, inside = told[f"b{b.rank}"], told[f"i{b.rank}"]
            # what the sketch missed, if it did, is on one side
            if b.rank <= below:
                low, high, below, inside = b.low, low, b.below, None
            elif b.rank > below + inside:
                low, high, below, inside = high, b.high, None, None
            if inside is None:
                again = rows.agg(F.count_if(F.col("v") < low).alias("b"), F.count_if(F.col("v").between(low, high)).alias("i")).first()
                below, inside = again["b"], again["i"]
            elif inside == b.inside:  # ties at both ends: part them in the middle
                low, high, below, inside = _halved(rows, b, low, high)
            brackets[b.rank] = _Bracket(b.rank, low, high, below, inside)


def _around(b: _Bracket) -> list[float]:
    at, slack = (b.rank - b.below) / b.inside, 2 / ACCURACY
    return [max(0.0, at - slack), min(1.0, at + slack)]


def _halved(rows: DataFrame, b: _Bracket, low: float, high: float) -> tuple[float, float, int, int]:
    """The end that is the rank's value, or what lies between."""
    told = rows.agg(F.count_if(F.col("v") <= low).alias("low"), F.count_if(F.col("v") < high).alias("high")).first()
    if b.rank <= told["low"]:
        return low, low, b.below, told["low"] - b.below
    if b.rank > told["high"]:
        return high, high, told["high"], b.below + b.inside - told["high"]
    inner = rows.filter((F.col("v") > low) & (F.col("v") < high)).agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    return inner["low"], inner["high"], told["low"], told["high"] - told["low"]
