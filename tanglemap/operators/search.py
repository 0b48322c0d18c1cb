"""Ranked text search and vector search over node tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tanglemap.functions.paths import matches_any, path_tokens
from tanglemap.scratch import cut

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6

# Fixed values.
LOOSE_TEST_PATTERNS = ("test%", "%/test%", "%_test.%", "tests/%")

Embedder = Callable[[list[str]], list[list[float]]]


def normalised(text: Column) -> Column:
    """The text with camel case parted and symbols as blanks, then the unparted form, in lower case."""
    whole = F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")
    return F.lower(F.trim(F.concat_ws(" ", F.regexp_replace(F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2"), r"[^\p{L}\p{N}_]+", " "), whole)))


def _accented() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters without."""
    marked = [(chr(p), unicodedata.normalize("NFD", chr(p))[0]) for p in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    kept = [(c, base) for c, base in marked if base != c and base.isascii() and c.islower()]
    return "".join(c for c, _ in kept), "".join(base for _, base in kept)


def folded(text: Column) -> Column:
    """In lower case and without diacritics."""
    return F.regexp_replace(F.translate(F.lower(text), *_accented()), r"\p{Mn}", "")


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded; ``_`` parts them."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(query: str) -> list[tuple[str, ...]]:
    """Terms of a query, normalised like the texts: each word, camel case parted, then each word
    as it is, so that a plain word counts twice. A word with ``_`` is a phrase of its parts."""
    both = f"{re.sub(r'([a-z])([A-Z])', r'\1 \2', query)} {query}"
    bare = "".join(c for c in unicodedata.normalize("NFD", both.lower()) if not unicodedata.combining(c))
    phrases = [tuple(p for p in word.split("_") if p) for word in re.split(r"[^\w]+", bare)]
    return [p for p in phrases if p]


def _count(words: Column, term: tuple[str, ...]) -> Column:
    """How often a term is in an array of tokens; its last part is a prefix."""
    if len(term) == 1:
        return F.size(F.filter(words, lambda t: t.startswith(term[0])))

    def at(i: Column) -> Column:
        found = F.get(words, i + len(term) - 1).startswith(term[-1])
        for n, part in enumerate(term[:-1]):
            found = found & (F.get(words, i + n) == part)
        return found

    starts = F.when(F.size(words) >= len(term), F.sequence(F.lit(0), F.size(words) - len(term))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, at))


def bm25_search(docs: DataFrame, query: str, limit: int | None = 20, kind: str | None = None) -> DataFrame:
    """``docs(node_id, kind, name, body)`` that hold every query term, by BM25 (``score``, lower
    is better; k1 1.2, b 0.75, inverse frequency floored). A term is a prefix of a token, or
    an ordered phrase whose last part is one; see :func:`query_terms`. A name is indexed twice
    in a row (see :func:`normalised`), so a phrase may run from its end to its beginning. A
    blank query, or one of symbols alone, finds nothing.

    Each text is cut into tokens once; what is kept of it are its length and frequencies.
    Corpus statistics are one row; the best rows come from a bounded top-k, not a sort."""
    terms = query_terms(query)
    if not terms:
        return docs.select("node_id", F.lit(0.0).alias("score")).limit(0)
    distinct = sorted(set(terms))
    words = docs.select("node_id", "kind", F.coalesce(tokens(normalised(F.col("name"))), F.array()).alias("a"), F.coalesce(tokens(F.col("body")), F.array()).alias("b"))
    rows = cut(words.select("node_id", "kind", (F.size("a") + F.size("b")).alias("len"), *[(_count(F.col("a"), t) + _count(F.col("b"), t)).alias(f"f{i}") for i, t in enumerate(distinct)]))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(distinct))])
    score = F.lit(0.0)
    hits = rows if kind is None else rows.filter(F.col("kind") == kind)
    for i, term in enumerate(distinct):
        f, n = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.greatest(F.ln((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(IDF_FLOOR))
        score = score - terms.count(term) * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        hits = hits.filter(f > 0)
    out = hits.join(F.broadcast(stats)).select("node_id", score.alias("score"))  # one row
    return out if limit is None else out.orderBy("score", "node_id").limit(limit)


def rich_text(nodes: DataFrame, imports: DataFrame, calls: DataFrame, most: int = 5) -> DataFrame:
    """``qualified_name, file_path, text`` of each node, for embedding: kind, name, words of the
    path, signature, docstring, what the file imports (last parts), children (of a file what
    has no parent, of a class its methods), and the stems of at most ``most`` test files that
    call anything in the file. Lists are sorted by name."""
    own = nodes.filter("kind <> 'File'")
    named = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "qualified_name"))), lambda s: s[c]), " ")
    tops = own.filter("parent_name is null").groupBy("file_path").agg(named("name").alias("tops"))
    methods = own.filter("kind = 'Method' and parent_name is not null").groupBy("file_path", F.col("parent_name").alias("name")).agg(named("name").alias("methods"))
    brought = imports.select("file_path", F.element_at(F.split("dst", r"\."), -1).alias("part")).groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_list("part")), " ").alias("brought"))
    at = nodes.select(F.col("qualified_name").alias("dst"), F.col("file_path").alias("callee_file"))
    testers = nodes.filter(matches_any(F.col("file_path"), LOOSE_TEST_PATTERNS)).select(F.col("qualified_name").alias("src"), F.col("file_path").alias("test_file"))
    met = calls.select("src", "dst").join(testers, "src").join(at, "dst").select(F.col("callee_file").alias("file_path"), "test_file").distinct()
    first = F.row_number().over(Window.partitionBy("file_path").orderBy("test_file"))
    stems = met.withColumn("r", first).filter(F.col("r") <= most).groupBy("file_path").agg(F.array_sort(F.collect_list("test_file")).alias("test_files"))
    stems = stems.select("file_path", F.array_join(F.transform("test_files", lambda f: F.regexp_extract(f, r"([^/]*?)(?:\.[^./]*)?$", 1)), " ").alias("stems"))
    words = F.array_join(path_tokens(F.col("file_path")), " ")
    given = lambda c: F.when(F.length(c) > 0, c)
    lead = lambda word, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{word} "), c))
    out = nodes.join(tops, "file_path", "left").join(methods, ["file_path", "name"], "left").join(brought, "file_path", "left").join(stems, "file_path", "left")
    children = F.when(F.col("kind") == "File", F.col("tops")).when(F.col("kind") == "Class", F.col("methods"))
    text = F.concat_ws(" ", "kind", "name", lead("path", words), given(F.col("signature")), given(F.col("docstring")), lead("imports", F.col("brought")), given(children), lead("tested by", F.col("stems")))
    return out.select("qualified_name", "file_path", F.trim(text).alias("text"))


def like_search(nodes: DataFrame, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
    """Search without ranking: every word is part of the name or the qualified name."""
    out = nodes if kind is None else nodes.filter(F.col("kind") == kind)
    for word in query.lower().split():
        out = out.filter(F.lower("name").contains(word) | F.lower("qualified_name").contains(word))
    return out.orderBy("qualified_name").limit(limit)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def knn_l2(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "node_id") -> DataFrame:
    """The ``k`` rows nearest to one vector by Euclidean distance."""
    target = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.sqrt(squared_distance(F.col("embedding"), target)).alias("distance")).orderBy("distance", id_col).limit(k)


def hashing_embedding(text: Column, dims: int = 384) -> Column:
    """Deterministic embedding without a model: signed token counts by hash, of unit length."""
    seen = F.transform(tokens(text), lambda t: F.xxhash64(t))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(seen, lambda h: F.pmod(h, F.lit(dims)) == i), F.lit(0.0), lambda s, h: s + F.when(F.pmod(F.shiftright(h, 20), F.lit(2)) == 0, 1.0).otherwise(-1.0)))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))



def embedded(texts: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """``texts`` with ``embedding`` of their column ``text`` in its place. ``embed`` turns a list
    of texts into vectors and runs batch by batch on the executors; without one texts are
    hashed, by expressions alone."""
    rest = [c for c in texts.columns if c != "text"]
    if embed is None:
        return texts.select(*rest, hashing_embedding(F.col("text")).alias("embedding"))

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(embed(batch.fillna("").tolist()))

    return texts.select(*rest, vectors("text").alias("embedding"))


def semantic_search(vectors: DataFrame, query: str, k: int = 10, embed: Embedder | None = None, id_col: str = "qualified_name") -> DataFrame:
    """The ``k`` rows of ``vectors`` whose embedding is nearest to that of the query; ``distance``
    ascending, ties by name. Without vectors there are none."""
    target = embed([query])[0] if embed else vectors.sparkSession.range(1).select(hashing_embedding(F.lit(query)).alias("v")).first()["v"]
    return knn_l2(vectors, list(target), k, id_col)


def file_summary(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each file of ``wanted(file_path)``: ``language``, ``nodes`` (its symbols by line) and
    ``edges`` (by line). All three are null for a file that is not known."""
    known = nodes.join(wanted.distinct(), "file_path", "left_semi")
    order = lambda c: F.array_sort(F.collect_list(c))
    symbol = F.struct("line_start", "qualified_name", "kind", "name", "signature", "line_end", F.col("parent_name").alias("parent"))
    found = known.groupBy("file_path").agg(F.min("language").alias("language"), order(F.when(F.col("kind") != "File", symbol)).alias("nodes"))
    link = edges.join(wanted.distinct(), "file_path", "left_semi").groupBy("file_path").agg(order(F.struct("line", "kind", F.col("src").alias("source"), F.col("dst").alias("target"))).alias("edges"))
    out = wanted.distinct().join(found, "file_path", "left").join(link, "file_path", "left")
    none = F.array().cast(link.schema["edges"].dataType)
    return out.select("file_path", "language", "nodes", F.when(F.col("nodes").isNotNull(), F.coalesce("edges", none)).alias("edges"))
