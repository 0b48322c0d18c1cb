"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A test item gives windows of consecutive words. For windows of one length, a shift
table says for each block of words how far the search may jump; blocks that no window
holds skip all positions that would need them. Where the shift is nothing, the last
and the first block of the position name a bucket of windows, and these are compared
directly. Tables and texts are arrays of word hashes, searched many texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tanglemap.llm.common import unpacked
from tanglemap.llm.shingles import PLACE_WEIGHTS, mixed, word_hashes

BLOCK_WORDS = 3
PART_WORDS = 2_000_000  # words of test items whose tables are broadcast at once: some 50 bytes each, 200 while they are built
CHUNK_BYTES = 1 << 20  # texts searched at once

#: Words are runs of ASCII letters and digits and of all bytes above ASCII; A-Z become a-z.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


@dataclass
class Words:
    """Texts one after the other: normal bytes, where each word begins, its hash, and the
    number of the first word of each text (and of one more)."""

    raw: bytes
    begins: np.ndarray
    hashes: np.ndarray
    edges: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[bytes]) -> Words:
        raw = b" ".join([*texts, b""]).translate(WORD_BYTES)
        begins, hashes = word_hashes(np.frombuffer(raw, dtype=np.uint8))
        edges = np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        return cls(raw, begins.astype(np.int32 if len(raw) < 1 << 31 else np.int64), hashes, edges)

    def window(self, start: int, length: int) -> list[bytes]:
        stop = self.begins[start + length] if start + length < len(self.begins) else len(self.raw)
        return self.raw[self.begins[start] : stop].split()


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out += hashes[j : j + n] * PLACE_WEIGHTS[j]
    return mixed(out)


def _bucket(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mixed(last * np.uint64(3) + first)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class WindowTable:
    """Search tables for windows of ``length`` words. ``blocks`` and ``shifts`` are the shift
    table; ``buckets`` sorts the distinct windows by their last and first block, ``starts``
    says where in ``words`` each is, ``owners`` which items have it (``owned`` delimits)."""

    length: int
    words: Words
    blocks: np.ndarray
    shifts: np.ndarray
    buckets: np.ndarray
    starts: np.ndarray
    owned: np.ndarray
    owners: np.ndarray

    @classmethod
    def build(cls, length: int, texts: Sequence[bytes], items: Sequence[int]) -> WindowTable:
        """From texts of ``length`` words or more and the numbers of their items."""
        words = Words.of(texts)
        m, b, n = length, min(BLOCK_WORDS, length), len(words.hashes)
        place = np.arange(n) - np.repeat(words.edges[:-1], np.diff(words.edges))
        left = np.repeat(np.diff(words.edges), np.diff(words.edges)) - place
        gram = _grams(words.hashes, b)
        begin = np.flatnonzero(left >= b)  # blocks within one text
        shift = np.maximum(0, m - b - place[begin]).astype(np.int8)
        order = np.lexsort((shift, gram[begin]))
        begin, shift = begin[order], shift[order]
        first = np.flatnonzero(np.r_[True, gram[begin[1:]] != gram[begin[:-1]]]) if n else np.zeros(0, dtype=int)
        blocks, shifts = gram[begin[first]], shift[first]

        start = np.flatnonzero(left >= m)
        whole, bucket = _grams(words.hashes, m)[start], _bucket(gram[start + m - b], gram[start])
        item = np.repeat(np.asarray(items, dtype=np.int32), np.diff(words.edges))[start]
        order = np.lexsort((item, whole, bucket))
        start, whole, bucket, item = start[order], whole[order], bucket[order], item[order]
        once = np.r_[True, (item[1:] != item[:-1]) | (whole[1:] != whole[:-1]) | (bucket[1:] != bucket[:-1])][: len(start)]
        start, whole, bucket, item = start[once], whole[once], bucket[once], item[once]
        head = np.flatnonzero(np.r_[True, (whole[1:] != whole[:-1]) | (bucket[1:] != bucket[:-1])][: len(start)])
        return cls(m, words, blocks, shifts, bucket[head], start[head].astype(np.int32), np.append(head, len(start)).astype(np.int32), item)

    def search(self, texts: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every occurrence."""
        m, b = self.length, min(BLOCK_WORDS, self.length)
        jump = m - b + 1
        gram = _grams(texts.hashes, b)
        size = np.diff(texts.edges)
        probes = np.maximum(0, (size - m) // jump + 1)
        text = np.repeat(np.arange(len(size)), probes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(probes) - probes, probes)
        end = texts.edges[text] + m + nth * jump
        at = _find(self.blocks, gram[end - b])
        met = at >= 0  # all other probes skip ``jump`` ends
        end, text, shift = end[met], text[met], self.shifts[at[met]].astype(np.int64)
        reps = np.maximum(0, np.minimum(jump - shift, texts.edges[text + 1] - end - shift + 1))
        ends = np.repeat(end + shift, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        at = _find(self.blocks, gram[ends - b])
        ends = ends[(at >= 0) & (self.shifts[np.maximum(at, 0)] == 0)] if len(self.shifts) else ends[:0]
        start = ends - m
        bucket = _bucket(gram[ends - b], gram[start])
        low, high = np.searchsorted(self.buckets, bucket), np.searchsorted(self.buckets, bucket, side="right")
        count = high - low
        start = np.repeat(start, count)
        window = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        spread = np.arange(m)
        same = (texts.hashes[start[:, None] + spread] == self.words.hashes[self.starts[window][:, None] + spread]).all(axis=1) if len(start) else np.zeros(0, dtype=bool)
        start, window = start[same], window[same]
        same = np.fromiter((texts.window(s, m) == self.words.window(w, m) for s, w in zip(start.tolist(), self.starts[window].tolist(), strict=True)), dtype=bool, count=len(start))
        return start[same], window[same]


@dataclass
class Tables:
    """Tables for each length of window, and the names of the items."""

    names: list[str]
    by_length: list[WindowTable]


def window_tables(items: Sequence[tuple[str, bytes]], window: int) -> Tables:
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    by_length: dict[int, tuple[list[bytes], list[int]]] = {}
    for name, raw in items:
        if length := min(window, len(raw.translate(WORD_BYTES).split())):
            texts, owners = by_length.setdefault(length, ([], []))
            texts.append(raw)
            owners.append(number[name])
    return Tables(names, [WindowTable.build(length, *by_length[length]) for length in sorted(by_length)])


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _hits(tables: Tables, texts: Sequence[bytes], before: Sequence[Sequence[dict]]) -> Iterator[tuple[int, list[dict], set[str]]]:
    """Words, merged spans of hit words (with those found before), and items of each text."""
    words = Words.of(texts)
    change = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    found: list[set[str]] = [set() for _ in texts]
    for table in tables.by_length:
        start, window = table.search(words)
        np.add.at(change, start, 1)
        np.add.at(change, start + table.length, -1)
        owner = np.searchsorted(words.edges, start, side="right") - 1
        for text, w in set(zip(owner.tolist(), window.tolist(), strict=True)):
            found[text].update(tables.names[i] for i in table.owners[table.owned[w] : table.owned[w + 1]])
    for edge, spans in zip(words.edges, before, strict=False):
        for span in spans:
            change[edge + span["start"]] += 1
            change[edge + span["end"]] -= 1
    hit = np.cumsum(change[:-1]) > 0
    for i, (a, b) in enumerate(zip(words.edges[:-1], words.edges[1:], strict=True)):
        turns = np.flatnonzero(np.diff(np.r_[False, hit[a:b], False])) if hit[a:b].any() else np.zeros(0, dtype=int)
        yield int(b - a), [{"start": int(x), "end": int(y)} for x, y in turns.reshape(-1, 2)], found[i]


def _scan(tables):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [raw or b"" for raw in batch.column(1).cast(pa.large_binary()).to_pylist()]
            spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            counts, all_spans, all_items, at = [], [], [], 0
            while at < len(raws):
                to, size = at, 0
                while to < len(raws) and size < CHUNK_BYTES:
                    size += len(raws[to])
                    to += 1
                for i, (n, found, names) in enumerate(_hits(tables.value, raws[at:to], spans[at:to]), at):
                    counts.append(n)
                    all_spans.append(found)
                    all_items.append(sorted(names.union(items[i])))
                at = to
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(all_spans, pa.list_(SPAN)), pa.array(all_items, pa.list_(pa.string())), pa.array(counts, pa.int64())],
                ["_row", "_raw", "_spans", "_items", "_words"],
            )

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: Sequence[str] | None = None, part_words: int = PART_WORDS) -> DataFrame:
    """The documents (columns ``keep``, or all) with ``n_words``, ``hits`` (merged spans of
    hit words, end exclusive) and ``items`` (sorted names of the test items that occur).

    A window is ``window`` consecutive words of an item, or all words of a shorter one; an
    item without words has none. A null text has no words. An item with a null id goes by the
    empty name; items of one id count as one. Repeated documents each give a row. Empty
    documents, or an empty benchmark, give rows without hits; an empty table gives none.

    Documents are read where they lie, without a shuffle. The search tables are broadcast: of
    items of about ``part_words`` words (or one larger item), some 50 bytes a word; a larger
    benchmark is cut into so many parts, and each row goes through one search after the other.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(item_text_col).cast("binary").alias("raw")).filter("raw is not null")
    count = lambda raws: pa.array([len(r.translate(WORD_BYTES).split()) for r in raws.to_pylist()], pa.int64())
    counted = items.select("raw").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([count(b.column(0))], ["n"]) for b in batches), "n long")
    parts = -(-(counted.agg(F.sum("n")).first()[0] or 0) // part_words) or 1

    kept = docs.select(*[F.col(f"`{c}`") for c in keep or docs.columns])
    names = kept.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    rows = docs.select(row.alias("_row"), F.col(text_col).cast("binary").alias("_raw"))
    spans = F.array().cast("array<struct<start:int,end:int>>")
    rows = rows.select("_row", "_raw", spans.alias("_spans"), F.array().cast("array<string>").alias("_items"))
    schema = rows.schema.add("_words", "long")
    for part in range(parts):
        chosen = items.filter(F.pmod(F.xxhash64("name", "raw"), F.lit(parts)) == part)
        tables = window_tables([(r["name"], bytes(r["raw"])) for r in chosen.toLocalIterator()], window)
        shared = docs.sparkSession.sparkContext.broadcast(tables)
        del tables
        rows = rows.select("_row", "_raw", "_spans", "_items").mapInArrow(_scan(shared), schema)
    return rows.select(*unpacked(rows, names, n_words=F.col("_words"), hits=F.col("_spans"), items=F.col("_items")))
