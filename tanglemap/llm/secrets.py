"""Secret scan with corpus-wide ownership frequency, in DataFrame operations alone.

Patterns give candidate spans. The hash of each candidate's value is aggregated over
the corpus by distinct repositories and distinct owners. A value in many repositories
of many owners is a copied example; one in many repositories of few owners is a
credential that they reuse; any other is local to few repositories. All but examples
look live. Candidates of the fixed patterns are always reported, with that verdict;
candidates of the opaque kind (long mixed strings without a telling context) only
where they look live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tanglemap.scratch import cut


@dataclass(frozen=True)
class Kind:
    """``group`` holds the value; matches of fewer than ``least`` characters there do not
    count. ``sure`` kinds are reported whatever the corpus says of the value."""

    name: str
    pattern: str
    group: int
    least: int
    sure: bool = True


KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
    Kind("opaque", r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z_+/=-]*[0-9])(?=[a-z0-9_+/=-]*[A-Z])(?=[A-Z0-9_+/=-]*[a-z])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_.=-])", 0, 24, False),
)
MAX_OWNERS = 2  # more are many
MAX_REPOS = 2


def _matches(text: Column, kind: Kind, rank: int) -> Column:
    """Array of (rank, place, length before the match since the last one, length, value hash),
    one for each leftmost non-overlapping match; null where there is none."""
    pattern = F.lit(kind.pattern)
    gaps = F.split(text, kind.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, 0)
    value = whole if kind.group == 0 else F.regexp_extract_all(text, pattern, kind.group)

    def one(match: Column, i: Column) -> Column:
        inner = F.get(value, i)
        return F.struct(
            F.lit(rank).alias("rank"),
            i.alias("i"),
            F.length(F.get(gaps, i)).alias("gap"),
            F.length(match).alias("len"),
            (F.length(inner) >= kind.least).alias("ok"),
            F.sha2(inner, 256).alias("hash"),
        )

    return F.when(text.rlike(kind.pattern), F.transform(whole, one))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", kinds: tuple[Kind, ...] = KINDS, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row a document: the id column and ``secrets``, an array of (start, rank, kind, end,
    hash, n_repos, n_owners, verdict, live) by start, then kind. Positions are code points, end
    exclusive. ``verdict``: ``example`` if more than ``max_repos`` repositories and more than
    ``max_owners`` owners have the value, ``reused`` if only the former, else ``local``;
    ``live``: not an example.

    A null or empty text has no secrets. A null repository or owner does not count as one, so
    a value seen only there has none and is local. Repeated rows each give a row. Other
    columns do not pass through. An empty table gives an empty table.

    Texts are read once, in a scan without a shuffle; only candidates move. A value that a
    third of all documents share is pre-aggregated by (value, owner) and (value, repository),
    and its verdict joins back as an ordinary equi-join that adaptive execution can split.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<rank:int,i:int,gap:int,len:int,ok:boolean,hash:string>>")
    found = [F.coalesce(_matches(text, kind, rank), none) for rank, kind in enumerate(kinds)]
    base = cut(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.col(repo_col).cast("string").alias("repo"),
            F.col(owner_col).cast("string").alias("owner"),
            F.concat(*found).alias("found"),
        )
    )
    order = Window.partitionBy("row", "m.rank").orderBy("m.i").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        base.filter(F.size("found") > 0)
        .select("row", "repo", "owner", F.explode("found").alias("m"))
        .select("row", "repo", "owner", "m", F.sum(F.col("m.gap").cast("long") + F.col("m.len")).over(order).alias("end"))
        .filter("m.ok")
        .select("row", "repo", "owner", "m.rank", "m.hash", (F.col("end") - F.col("m.len")).alias("start"), "end")
    )
    spans = cut(spans)
    sure = [rank for rank, kind in enumerate(kinds) if kind.sure]
    repos = spans.select("hash", "repo").distinct().groupBy("hash").agg(F.count("repo").alias("n_repos"))
    owners = spans.select("hash", "owner").distinct().groupBy("hash").agg(F.count("owner").alias("n_owners"))
    spread = F.col("n_repos") > max_repos
    said = F.when(spread & (F.col("n_owners") > max_owners), "example").when(spread, "reused").otherwise("local")
    verdict = repos.join(owners, "hash").select("hash", "n_repos", "n_owners", said.alias("verdict"), (said != "example").alias("live"))
    names = F.array(*[F.lit(k.name) for k in kinds])
    rated = spans.join(verdict, "hash").select(
        "row",
        F.struct("start", "rank", F.get(names, F.col("rank")).alias("kind"), "end", "hash", "n_repos", "n_owners", "verdict", "live").alias("s"),
    )
    kept = rated.filter(F.col("s.rank").isin(*sure) | F.col("s.live")).groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("all"))
    covered = lambda s, t: (t["rank"] != s["rank"]) & t["rank"].isin(*sure) & (t["start"] < s["end"]) & (s["start"] < t["end"])
    secrets = F.when(
        F.exists("all", lambda s: ~s["rank"].isin(*sure)),
        F.filter("all", lambda s: s["rank"].isin(*sure) | ~F.exists("all", lambda t: covered(s, t))),
    ).otherwise(F.col("all"))
    kept = kept.select("row", secrets.alias("secrets"))
    empty = F.array().cast(kept.schema["secrets"].dataType)
    return base.join(kept, "row", "left").select(F.col("id").alias(id_col), F.coalesce("secrets", empty).alias("secrets"))
