"""Cross-tokenizer alignment by products of sparse incidence matrices.

A text under a tokenizer is a matrix of tokens by bytes, in compressed rows (CSR). The
product of one tokenizer's matrix with the transpose of the other's, by Gustavson's rows,
has an entry for each two tokens that overlap: the bytes they share. Overlapping tokens
that end together are linked; the bytes where they do cut both sequences into groups,
which give matrices of groups by tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from tanglemap.llm.bpe import file_bytes
from tanglemap.llm.common import unpacked
from tanglemap.scratch import Table

CHUNK_BYTES = 1 << 19  # texts aligned at once, and bytes of a product at once
SPACE_MARK = "\u2581"


@dataclass
class Csr:
    """A matrix of counts: row ``i`` has ``values`` in ``cols`` from ``ptr[i]`` to ``ptr[i + 1]``."""

    ptr: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    n_cols: int

    @classmethod
    def of_lengths(cls, lengths: np.ndarray) -> Csr:
        """Rows that tile the columns: each takes the next so many."""
        ptr = np.concatenate([[0], np.cumsum(lengths)])
        return cls(ptr, np.arange(ptr[-1]), np.ones(ptr[-1], dtype=np.int64), int(ptr[-1]))

    @property
    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.cols, kind="stable")
        ptr = np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.n_cols))])
        return Csr(ptr, self.rows[order], self.values[order], len(self.ptr) - 1)

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: each entry of a row brings the row of ``other`` that its column
        names, times the entry; entries of one column then add up."""
        sizes = np.diff(other.ptr)[self.cols]
        total = int(sizes.sum())
        at = np.repeat(other.ptr[self.cols] - np.cumsum(sizes) + sizes, sizes) + np.arange(total)
        row, col = np.repeat(self.rows, sizes), other.cols[at]
        value = np.repeat(self.values, sizes) * other.values[at]
        key = row * other.n_cols + col
        if total and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, dtype=np.int64)
        key, value = key[first], np.add.reduceat(value, first) if total else value
        row, col = key // max(1, other.n_cols), key % max(1, other.n_cols)
        ptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(self.ptr) - 1))])
        return Csr(ptr, col, value, other.n_cols)


def overlaps(a: np.ndarray, b: np.ndarray, block: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token of A, token of B and shared bytes of all that overlap, for tokens of these lengths
    that tile the same bytes; a block of A's rows at a time."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    row = 0
    while row < len(a):
        start = ends_a[row] - a[row]
        to = max(row + 1, int(np.searchsorted(ends_a, start + block, side="right")))
        low = int(np.searchsorted(ends_b, start, side="right"))
        high = int(np.searchsorted(ends_b, ends_a[to - 1], side="left")) + 1
        theirs = b[low:high].copy()
        theirs[0] = ends_b[low] - start
        theirs[-1] -= ends_b[high - 1] - ends_a[to - 1]
        shared = Csr.of_lengths(a[row:to]).times(Csr.of_lengths(theirs).transposed())
        yield shared.rows + row, shared.cols + low, shared.values
        row = to


@dataclass
class Alignment:
    """Links (positions of tokens that end together), and groups by tokens of A and of B."""

    n_overlaps: int
    links: tuple[np.ndarray, np.ndarray]
    groups_a: Csr
    groups_b: Csr

    def shared(self) -> np.ndarray:
        """Pairs of an A and a B token by group: the products of the groups' row sums. Their sum is
        the number of entries of :meth:`shared_links`."""
        return np.diff(self.groups_a.ptr) * np.diff(self.groups_b.ptr)

    def shared_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of an A and a B token in one group: tokens by groups of A times groups by
        tokens of B, a group's rows at a time, since a group of m and n tokens has m * n."""
        for g in range(len(self.groups_a.ptr) - 1):
            ours = self.groups_a.cols[self.groups_a.ptr[g] : self.groups_a.ptr[g + 1]]
            row = Csr(np.arange(len(ours) + 1), np.zeros(len(ours), dtype=np.int64), np.ones(len(ours), dtype=np.int64), 1)
            theirs = self.groups_b.cols[self.groups_b.ptr[g] : self.groups_b.ptr[g + 1]]
            product = row.times(Csr(np.array([0, len(theirs)]), np.arange(len(theirs)), np.ones(len(theirs), dtype=np.int64), len(theirs)))
            yield ours[product.rows], theirs[product.cols]


def align(a: np.ndarray, b: np.ndarray) -> Alignment:
    """Aligns tokens of these byte lengths, none of them 0, that tile the same bytes."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    n, linked = 0, []
    for row, col, _ in overlaps(a, b):
        n += len(row)
        together = ends_a[row] == ends_b[col]
        linked.append((row[together], col[together]))
    links = tuple(np.concatenate([part[side] for part in linked]) if linked else np.zeros(0, dtype=np.int64) for side in (0, 1))
    # a group reaches to a link; the last bytes of both are one
    return Alignment(n, links, Csr.of_lengths(np.diff(links[0], prepend=-1)), Csr.of_lengths(np.diff(links[1], prepend=-1)))


# --- tokenizers -----------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, all others are U+0100 and on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [i for i in range(256) if i not in plain]
    return {chr(i): i for i in plain} | {chr(0x100 + n): i for n, i in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary in JSON whose ids follow its merges, by a public encoder."""

    def __init__(self, raw: bytes, pattern: str):
        told, alphabet = json.loads(raw), byte_alphabet()
        special = {t["content"] for t in told["added_tokens"] if t["special"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = {i: token for token, i in ranks.items()}

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(f" {text}") for text in texts]


class Pieces:
    """A piece vocabulary with byte fallback, which puts a space before a text."""

    def __init__(self, raw: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = {i: bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace(SPACE_MARK, " ").encode() for i, name in enumerate(names)}

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self.model.encode(list(texts), num_threads=1)


class Aligner:
    """Texts to aligned tokens, many texts at a time."""

    def __init__(self, raw_a: bytes, raw_b: bytes, pattern: str):
        self.a, self.b = ByteLevel(raw_a, pattern), Pieces(raw_b)
        self.size_a, self.size_b = (np.array([len(t.tokens.get(i, b"")) for i in range(max(t.tokens) + 1)]) for t in (self.a, self.b))
        ends = {"a": (",", "|"), "b": (",", ";", "")}
        self.n_a, self.n_b = len(self.size_a), len(self.size_b)
        self.said = [f"{i}{end}" for side, n in (("a", self.n_a), ("b", self.n_b)) for end in ends[side] for i in range(n)]

    def _tokens(self, raws: Sequence[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where one does not give back the text."""
        texts = [raw.decode(errors="replace") for raw in raws]
        a, b = self.a.encode(texts), self.b.encode(texts)
        for i, raw in enumerate(raws):
            whole = b" " + raw
            if not raw or any(b"".join(map(t.tokens.get, ids)) != whole for t, ids in ((self.a, a[i]), (self.b, b[i]))):
                a[i], b[i] = [], []
        return a, b

    def rows(self, raws: Sequence[bytes]) -> Iterator[tuple]:
        """For each text: tokens of A and of B, groups, overlaps, pairs in groups, what the groups
        hold, and the linked pairs of ids with the times each is linked."""
        a, b = self._tokens(raws)
        edge_a, edge_b = (np.cumsum([0, *map(len, side)]) for side in (a, b))
        a, b = (np.fromiter((i for ids in side for i in ids), dtype=np.int64, count=n) for side, n in ((a, edge_a[-1]), (b, edge_b[-1])))
        found = align(self.size_a[a], self.size_b[b])  # texts end in links, so no group spans two
        group_edge = np.searchsorted(found.links[0], edge_a)
        # ids in the order of groups, A's before B's, each with what follows it
        after_a, after_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        after_a[found.links[0]] = after_b[found.links[1]] = 1
        after_b[edge_b[1:][np.diff(edge_b) > 0] - 1] = 2
        size_a, size_b = np.diff(found.groups_a.ptr), np.diff(found.groups_b.ptr)
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)] = a + self.n_a * after_a
        order[np.arange(len(b)) + np.repeat(np.cumsum(size_a), size_b)] = 2 * self.n_a + b + self.n_b * after_b
        text = np.repeat(np.arange(len(raws)), np.diff(group_edge))
        pair = a[found.links[0]] << 32 | b[found.links[1]]
        by_pair = np.lexsort((pair, text))
        pair, text = pair[by_pair], text[by_pair]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])])) if len(pair) else np.zeros(0, dtype=np.int64)
        times, pair, text = np.diff(np.append(first, len(pair))), pair[first], text[first]
        pair_edge = np.searchsorted(text, np.arange(len(raws) + 1))
        shared = np.concatenate([[0], np.cumsum(found.shared())])
        for i in range(len(raws)):
            low, high = group_edge[i], group_edge[i + 1]
            ids = order[edge_a[i] + edge_b[i] : edge_a[i + 1] + edge_b[i + 1]].tolist()
            at = slice(pair_edge[i], pair_edge[i + 1])
            yield int(edge_a[i + 1] - edge_a[i]), int(edge_b[i + 1] - edge_b[i]), int(high - low), int(shared[high] - shared[low]), "".join(map(self.said.__getitem__, ids)), pair[at], times[at]


@lru_cache(maxsize=2)
def _aligner(raw_a: bytes, raw_b: bytes, pattern: str) -> Aligner:
    return Aligner(raw_a, raw_b, pattern)


def _aligning(shared_a, shared_b, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared_a.value, shared_b.value, pattern)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            at = 0
            while at < len(texts):
                raws, start, size = [], at, 0
                while at < len(texts) and size < CHUNK_BYTES:
                    raws.append(texts[at].as_py() or b"")
                    size += len(raws[-1])
                    at += 1
                rows = list(aligner.rows(raws))
                pairs, times = (np.concatenate([row[i] for row in rows]) for i in (5, 6))
                links = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (pairs >> 32, pairs & 0xFFFFFFFF, times)], ["a", "b", "n"])
                ends = pa.array(np.cumsum([0, *(len(row[5]) for row in rows)], dtype=np.int32))
                counts = [pa.array([row[i] for row in rows], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), *counts, pa.array([row[4] for row in rows]), pa.ListArray.from_arrays(ends, links)], ["_row", "n_a", "n_b", "n_groups", "n_shared", "groups", "links"])

    return run


LINK = StructType().add("a", IntegerType()).add("b", IntegerType()).add("n", IntegerType())


def align_tokens(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, pattern: str, *, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The documents (columns ``keep``, or all) with the tokens of a space and the whole text under
    two tokenizers, aligned: ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links`` (pairs of
    tokens whose bytes end together), ``n_shared`` (pairs of tokens in one group), ``groups``
    (``a1,a2|b1;a3|b2``: ids of A, ids of B, by group) and ``links`` (linked pairs of ids
    ``a``, ``b`` and how often, ``n``).

    ``vocabulary_a`` is the path of a byte-level BPE vocabulary in JSON, cut by ``pattern``,
    ``vocabulary_b`` that of a piece model. Strings of special tokens are plain text. A text
    that is null or empty, or that either side does not give back byte by byte, has no tokens:
    zeros, empty columns. Repeated rows each give a row, an empty table gives none. Columns of
    the input that have one of these names give way. Texts are read where they lie, without a
    shuffle; a group may be as long as its text, so its pairs are counted and not listed.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in keep]) if keep else docs
    row = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
    rows = docs.select(row.alias("_row"), F.col(f"`{text_col}`").cast("binary").alias("_raw"))
    schema = rows.select("_row").schema
    for name in ("n_a", "n_b", "n_groups", "n_shared"):
        schema = schema.add(name, LongType())
    schema = schema.add("groups", StringType()).add("links", ArrayType(LINK))
    a, b = (file_bytes(docs.sparkSession, path) for path in (vocabulary_a, vocabulary_b))
    out = rows.mapInArrow(_aligning(a, b, pattern), schema)
    # at each byte where both end, one token of each side ends: a group has one link
    added = {"n_a": "n_a", "n_b": "n_b", "n_groups": "n_groups", "n_links": "n_groups", "n_shared": "n_shared", "groups": "groups", "links": "links"}
    return out.select(*unpacked(out, kept.columns, **{name: F.col(c) for name, c in added.items()}))


def link_counts(aligned: DataFrame) -> DataFrame:
    """Of all ``links``: ``a``, ``b``, ``n`` (links corpus-wide) and ``best`` (whether no other
    ``a`` has more with this ``b``). Of two tokens that end together one ends in the other, so
    the rows are bounded by the vocabularies, whatever the corpus."""
    counts = aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("l.n").alias("n"))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def rate_links(aligned: DataFrame) -> DataFrame:
    """:func:`align_tokens`' rows, without ``links`` and ``groups``, with ``n_best`` (links whose
    pair is its B id's most frequent one, ties included) and ``count_sum`` (the counts of the
    pairs of all links). Rows are stored once, so texts are read once; links meet the counts in
    a broadcast whose size the vocabularies bound (at most some 20 bytes for each pair of
    tokens of which one ends in the other), and a document's links combine before the shuffle."""
    numbered = aligned.drop("groups").withColumn("_id", F.monotonically_increasing_id())
    stored = Table(numbered, "aligned")
    rows = stored.read()
    counts = Table(link_counts(rows), "links")
    rated = rows.select("_id", F.explode("links").alias("l")).select("_id", "l.a", "l.b", F.col("l.n").alias("here"))
    rated = rated.join(F.broadcast(counts.read()), ["a", "b"]).groupBy("_id").agg(F.sum(F.when(F.col("best"), F.col("here")).otherwise(0)).alias("n_best"), F.sum(F.col("here") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = rows.drop("links").join(rated, "_id", "left")
    return out.withColumns({"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)}).drop("_id")
