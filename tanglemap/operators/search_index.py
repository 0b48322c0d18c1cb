"""Ranked search served from postings: only rows of the query's terms are read.

Documents are dealt to blocks of 64, by length, so that a set of documents of a block is
one bitmap. A posting is a row for a term and a block: the bitmap of the documents that
hold the term, the highest frequency and the shortest length among them, and the places of
the term. Bitmaps alone give the exact document frequencies and the blocks that can match
at all; frequency and length bound the best score of a block, so places are opened only in
blocks that can still reach the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tanglemap.operators.search import B, IDF_FLOOR, K1, normalised, query_terms, tokens
from tanglemap.scratch import cut

BLOCK_DOCS = 64  # bits of a long
SHARE_DOCS = 4096  # documents that are numbered together
PARTS = 64  # by the first character of a term
GENERATION = 1 << 44  # block numbers of one build

POSTINGS = "part int, term string, block long, docs long, most int, shortest int, held array<struct<slot:int,name:array<int>,body:array<int>>>"
BLOCKS = "block long, docs long, n long, length long, members array<struct<slot:int,node_id:string,kind:string,file_path:string,length:int>>"


@dataclass
class SearchIndex:
    """``postings`` (:data:`POSTINGS`; best stored by ``part``, sorted by term) and ``blocks``
    (:data:`BLOCKS`), one row a block. Postings of documents that are gone may remain."""

    postings: DataFrame
    blocks: DataFrame


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot)


def _blocks(members: DataFrame) -> DataFrame:
    held = F.struct("slot", "node_id", "kind", "file_path", "length")
    sums = [F.bit_or(_bit(F.col("slot"))).alias("docs"), F.count("*").alias("n"), F.sum("length").cast("long").alias("length")]
    return members.groupBy("block").agg(*sums, F.array_sort(F.collect_list(held)).alias("members"))


def build_index(docs: DataFrame, generation: int = 0) -> SearchIndex:
    """Of ``docs(node_id, kind, name, body, file_path)``. Names are normalised as for
    :func:`tanglemap.operators.search.bm25_search`; null texts have no terms; repeated rows are
    documents of their own; an empty table gives an empty index.

    Tokens are shuffled once, dealt by term range, and a group is a term in 64 documents, so a
    word that every document holds is spread over its blocks."""
    name, body = (F.coalesce(tokens(c), F.array().cast("array<string>")) for c in (normalised(F.col("name")), F.col("body")))
    rows = docs.select("node_id", "kind", F.col("file_path").cast("string").alias("file_path"), name.alias("name"), body.alias("body"))
    rows = rows.withColumn("length", F.size("name") + F.size("body"))
    shares = rows.count() // SHARE_DOCS + 1
    share = F.pmod(F.xxhash64("node_id", "file_path"), F.lit(shares))
    nth = F.row_number().over(Window.partitionBy("share").orderBy("length", "node_id", "file_path")) - 1
    placed = rows.withColumn("share", share).withColumn("nth", nth)
    block = F.lit(generation * GENERATION) + F.floor(F.col("nth") / BLOCK_DOCS) * shares + F.col("share")
    placed = cut(placed.select(block.cast("long").alias("block"), (F.col("nth") % BLOCK_DOCS).alias("slot"), "node_id", "kind", "file_path", "length", "name", "body"))

    def places_in(field: str) -> Column:
        return F.transform(field, lambda t, i: F.struct(t.alias("term"), F.lit(field == "name").alias("in_name"), i.alias("at")))

    places = [places_in("name"), places_in("body")]
    spread = placed.select("block", "slot", "length", F.explode(F.concat(*places)).alias("p")).select(part_of(F.col("p.term")).alias("part"), "p.term", "block", "slot", "length", "p.in_name", "p.at")
    spread = spread.repartitionByRange("part", "term", "block")  # clusters both groupings below
    at = lambda own: F.array_sort(F.collect_list(F.when(F.col("in_name") == own, F.col("at"))))
    by_doc = spread.groupBy("part", "term", "block", "slot").agg(F.count("*").cast("int").alias("f"), F.first("length").alias("length"), at(True).alias("name"), at(False).alias("body"))
    found = by_doc.groupBy("part", "term", "block").agg(
        F.bit_or(_bit(F.col("slot"))).alias("docs"),
        F.max("f").alias("most"),
        F.min("length").alias("shortest"),
        F.array_sort(F.collect_list(F.struct("slot", "name", "body"))).alias("held"),
    )
    return SearchIndex(found.sortWithinPartitions("part", "term", "block"), _blocks(placed))


def store_index(index: SearchIndex, folder: str) -> SearchIndex:
    """Writes the index to a new folder, postings by part, and returns it as stored."""
    spark = index.blocks.sparkSession
    index.postings.write.partitionBy("part").parquet(f"{folder}/postings")
    index.blocks.write.parquet(f"{folder}/blocks")
    return SearchIndex(spark.read.schema(index.postings.schema).parquet(f"{folder}/postings"), spark.read.schema(index.blocks.schema).parquet(f"{folder}/blocks"))


def part_of(term: Column) -> Column:
    return F.pmod(F.ascii(term), F.lit(PARTS)).cast("int")


def drop_files(blocks: DataFrame, gone: DataFrame) -> DataFrame:
    """``blocks`` without the documents of ``gone(file_path)``; postings need no change."""
    members = blocks.select("block", F.explode("members").alias("m")).select("block", "m.*")
    return _blocks(members.join(gone.select("file_path").distinct(), "file_path", "left_anti"))


def next_generation(index: SearchIndex) -> int:
    """A number whose blocks no posting knows, not even one of documents that are gone."""
    top = index.blocks.select("block").union(index.postings.select("block")).agg(F.max("block")).first()[0]
    return 0 if top is None else top // GENERATION + 1


def updated(index: SearchIndex, gone: DataFrame, docs: DataFrame, generation: int | None = None) -> tuple[SearchIndex, DataFrame]:
    """The index without the documents of ``gone(file_path)`` and with ``docs``, and the postings
    that are new, which are all that has to be stored besides the blocks."""
    fresh = build_index(docs, next_generation(index) if generation is None else generation)
    blocks = cut(drop_files(index.blocks, gone).unionByName(fresh.blocks))
    return SearchIndex(index.postings.unionByName(fresh.postings), blocks), fresh.postings


def compacted(index: SearchIndex) -> DataFrame:
    """The postings of blocks that still have documents."""
    return index.postings.join(index.blocks.select("block"), "block", "left_semi").select(*index.postings.columns)


@dataclass(frozen=True)
class _Word:
    """A token of the query: equal to a term, or a beginning of terms."""

    text: str
    whole: bool

    def meets(self) -> Column:
        term = F.col("term")
        return (F.col("part") == ord(self.text[0]) % PARTS) & (term == self.text if self.whole else term.startswith(self.text))


def _words(term: tuple[str, ...]) -> list[_Word]:
    return [*(_Word(part, True) for part in term[:-1]), _Word(term[-1], False)]


def _frequency(at: list[int]) -> Column:
    """How often the words of these numbers follow one another, in the name and in the body."""

    def in_field(field: str) -> Column:
        def follows(place: Column) -> Column:
            out = F.lit(True)
            for n, word in enumerate(at[1:], 1):
                out = out & F.array_contains(F.col(f"{field}{word}"), place + n)
            return out

        places = F.col(f"{field}{at[0]}")
        return F.size(places) if len(at) == 1 else F.size(F.filter(places, follows))

    return in_field("name") + in_field("body")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


class _Search:
    def __init__(self, index: SearchIndex, terms: list[tuple[str, ...]], kind: str | None):
        self.index, self.terms, self.kind = index, terms, kind
        self.distinct = sorted(set(terms))
        self.words = list(dict.fromkeys(w for term in self.distinct for w in _words(term)))
        self.at = [[self.words.index(w) for w in _words(term)] for term in self.distinct]
        self.postings = index.postings.filter(_any([w.meets() for w in self.words]))

    def heads(self) -> DataFrame:
        """Of each block: documents of each word, a bound of its frequency, and the shortest."""
        sums = []
        for i, word in enumerate(self.words):
            sums += [F.bit_or(F.when(word.meets(), F.col("docs"))).alias(f"d{i}"), F.sum(F.when(word.meets(), F.col("most"))).alias(f"m{i}")]
        by_block = self.postings.groupBy("block").agg(*sums, F.min("shortest").alias("shortest"))
        live = self.index.blocks.select("block", "docs", self._wanted().alias("wanted"))
        masked = [F.coalesce(F.col(f"d{i}"), F.lit(0).cast("long")).bitwiseAND(F.col("docs")).alias(f"d{i}") for i in range(len(self.words))]
        return by_block.join(live, "block").select("block", "shortest", "wanted", *masked, *[f"m{i}" for i in range(len(self.words))])

    def _wanted(self) -> Column:
        if self.kind is None:
            return F.col("docs")
        mine = F.filter("members", lambda m: m["kind"] == self.kind)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda bits, m: bits.bitwiseOR(_bit(m["slot"])))

    def all_of(self, at: list[int]) -> Column:
        out = F.col(f"d{at[0]}")
        for i in at[1:]:
            out = out.bitwiseAND(F.col(f"d{i}"))
        return out

    def opened(self, blocks: DataFrame) -> DataFrame:
        """``block, slot`` and the places of each word, of the documents of ``blocks(block, open)``
        that the bitmap ``open`` names."""
        rows = self.postings.join(blocks, "block").select("block", "open", "part", "term", F.explode("held").alias("h"))
        rows = rows.filter(F.col("open").bitwiseAND(_bit(F.col("h.slot"))) != 0)
        places = [F.flatten(F.collect_list(F.when(w.meets(), F.col(f"h.{field}")))).alias(f"{field}{i}") for i, w in enumerate(self.words) for field in ("name", "body")]
        return rows.groupBy("block", F.col("h.slot").alias("slot")).agg(*places)

    def score(self, stats: Column, frequency, length: Column) -> Column:
        """Lower is better; monotone in frequencies and length, so that bounds give bounds."""
        out = F.lit(0.0)
        for i, term in enumerate(self.distinct):
            n, f = stats[f"n{i}"], frequency(i)
            idf = F.greatest(F.ln((stats["n"] - n + 0.5) / (n + 0.5)), F.lit(IDF_FLOOR))
            out = out - self.terms.count(term) * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / stats["mean"]))
        return out

    def scored(self, blocks: DataFrame, stats: DataFrame) -> DataFrame:
        found = self.opened(blocks).select("block", "slot", *[_frequency(at).alias(f"f{i}") for i, at in enumerate(self.at)])
        found = found.filter(" and ".join(f"f{i} > 0" for i in range(len(self.at))))
        members = self.index.blocks.join(blocks.select("block"), "block", "left_semi").select("block", F.explode("members").alias("m")).select("block", "m.slot", "m.node_id", "m.length")
        return found.join(members, ["block", "slot"]).join(F.broadcast(stats)).select("node_id", self.score(F.col("s"), lambda i: F.col(f"f{i}"), F.col("length")).alias("score"))  # one row of statistics


def search_index(index: SearchIndex, query: str, limit: int | None = 20, kind: str | None = None) -> DataFrame:
    """The rows and scores of :func:`tanglemap.operators.search.bm25_search` over the documents of
    the index: ``node_id, score``, lower is better, ties by ``node_id``.

    The first step reads bitmaps and bounds of the query's terms, which give statistics and the
    blocks that can match. For a limit, as many blocks of the best bounds are opened, each of
    which holds a match of all words; the score that is then the last of the result closes all
    blocks with a worse bound. Phrases are known only from places: theirs are opened in all
    blocks that hold all their words."""
    terms = query_terms(query)
    if not terms:
        return index.blocks.select(F.get("members", F.lit(0))["node_id"].alias("node_id"), F.lit(0.0).alias("score")).limit(0)
    at = _Search(index, terms, kind)
    heads = cut(at.heads())
    counts = [F.coalesce(F.sum(F.bit_count(at.all_of(words))), F.lit(0)).alias(f"n{i}") for i, words in enumerate(at.at)]
    totals = index.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("length") / F.sum("n")).alias("mean"))
    stats = totals.join(heads.agg(*counts))  # one row each
    phrases = [i for i, words in enumerate(at.at) if len(words) > 1]
    if phrases:
        some = F.lit(0).cast("long")
        for i in phrases:
            some = some.bitwiseOR(at.all_of(at.at[i]))
        places = at.opened(heads.select("block", some.alias("open")).filter("open != 0"))
        exact = places.agg(*[F.count_if(_frequency(at.at[i]) > 0).alias(f"n{i}") for i in phrases])
        stats = stats.drop(*[f"n{i}" for i in phrases]).join(exact)
    stats = cut(stats.select(F.struct("*").alias("s")))

    every = at.all_of(range(len(at.words))).bitwiseAND(F.col("wanted"))
    bound = at.score(F.col("s"), lambda i: F.least(*[F.col(f"m{w}") for w in at.at[i]]) if len(at.at[i]) > 1 else F.col(f"m{at.at[i][0]}"), F.col("shortest"))
    blocks = heads.select("*", every.alias("open")).filter("open != 0").join(F.broadcast(stats)).select("block", "open", (bound * (1 + 1e-9)).alias("bound"))
    if limit is None:
        return at.scored(blocks.select("block", "open"), stats)
    blocks = cut(blocks)
    first = at.scored(blocks.orderBy("bound", "block").limit(limit).select("block", "open"), stats).orderBy("score", "node_id").limit(limit)
    last = first.agg(F.count("*").alias("n"), F.max("score").alias("score")).first()
    left = blocks if last["n"] < limit else blocks.filter(F.col("bound") <= last["score"])
    return at.scored(left.select("block", "open"), stats).orderBy("score", "node_id").limit(limit)
