"""Language identification by hyperdimensional profiles.

Each letter has a random vector of signs, drawn by its code point. A letter trigram is bound from its
letters' vectors, each permuted as often as its place says; a text bundles its
trigrams, a language the texts it was learnt from. The prediction is the language
whose prototype has the largest cosine with the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tanglemap.llm.common import unpacked
from tanglemap.llm.shingles import mixed

DIMENSIONS = 512
UNKNOWN = "und"
GAP = 0  # symbol between words; any other symbol is a letter's code point
CHUNK_CHARS = 1 << 18  # bundling takes some 60 bytes of memory a character
GRAMS_AT_ONCE = 4_096
ROWS_HELD = 2_000
FIT_ROWS_PER_LANGUAGE = 4_000
MAX_LANGUAGES = 10_000  # prototypes go to every task: 2 KB for each language
SEED = 20_011


@cache
def _letters() -> np.ndarray:
    """The code point of each letter, the gap for all else."""
    return np.fromiter((p if chr(p).isalpha() else GAP for p in range(0x110000)), dtype=np.int32, count=0x110000)


@cache
def _order() -> np.ndarray:
    return np.random.default_rng(SEED).permutation(DIMENSIONS)


def _signs(symbols: np.ndarray) -> np.ndarray:
    """The random vector of signs of each symbol; every letter of every script has its own."""
    words = symbols.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(SEED)
    bits = np.unpackbits(mixed((words + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def _bundle(codes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of the bound trigram vectors of ``n`` documents' symbols, which follow one another."""
    there = np.zeros(int(codes.max(initial=0)) + 1, dtype=bool)
    there[codes] = True
    symbols = np.flatnonzero(there)
    k = len(symbols)
    small = (np.cumsum(there, dtype=np.int64) - 1)[codes]
    whole = doc[2:] == doc[:-2]
    gram = ((small[:-2] * k + small[1:-1]) * k + small[2:])[whole]
    keys, counts = np.unique(doc[2:][whole] * k**3 + gram, return_counts=True)
    grams, at = np.unique(keys % k**3, return_inverse=True)
    table = np.zeros((n, len(grams)), dtype=np.float32)
    table[keys // k**3, at] = counts
    base = _signs(symbols)
    once = base[:, _order()]
    twice = once[:, _order()]
    out = np.zeros((n, DIMENSIONS), dtype=np.float32)
    for start in range(0, len(grams), GRAMS_AT_ONCE):
        g = grams[start : start + GRAMS_AT_ONCE]
        out += table[:, start : start + GRAMS_AT_ONCE] @ (base[g // k**2] * once[g // k % k] * twice[g % k]).astype(np.float32)
    return out


def _symbols(text: str, first: bool, last: bool) -> np.ndarray:
    """Symbols of a piece; the first and the last piece of a text bring the gap around it."""
    folded = ("\n" if first else "") + text.casefold() + ("\n" if last else "")
    return _letters()[np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """Without all but the first of gaps in a row."""
    return codes[np.r_[True, (codes[1:] != GAP) | (codes[:-1] != GAP)]] if len(codes) else codes


def profiles(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit profile of each text, and whether it has a letter. Letters are case-folded. Long
    texts go in pieces, each after the last two symbols of the one before, so that memory is
    bounded and the sum is that of the whole text."""
    out, letters = np.zeros((len(texts), DIMENSIONS), dtype=np.float64), np.zeros(len(texts), dtype=bool)
    at: list[int] = []
    pieces: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal at, pieces, size
        if pieces:
            sums = _bundle(np.concatenate(pieces), np.repeat(np.arange(len(pieces)), [len(p) for p in pieces]), len(pieces))
            np.add.at(out, at, sums)
        at, pieces, size = [], [], 0

    for i, text in enumerate(texts):
        text = text or ""
        tail = np.zeros(0, dtype=np.int64)
        for start in range(0, len(text), CHUNK_CHARS):
            piece = _squeezed(np.concatenate([tail, _symbols(text[start : start + CHUNK_CHARS], start == 0, start + CHUNK_CHARS >= len(text))]))
            letters[i] |= bool((piece != GAP).any())
            tail = piece[-2:]
            at.append(i)
            pieces.append(piece)
            size += len(piece)
            if size >= CHUNK_CHARS or len(pieces) >= 512:
                flush()
    flush()
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norms > 0, norms, 1)).astype(np.float32), letters


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``ROWS_HELD`` rows, whose profiles a worker holds at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_HELD):
            yield batch.slice(start, ROWS_HELD)


def fit(docs: DataFrame, learn: Column, *, text_col: str = "text", lang_col: str = "lang", rows_per_language: int = FIT_ROWS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their unit prototypes, from rows where ``learn`` holds and
    neither text nor language is null; more than ``MAX_LANGUAGES`` are an error. Of each language about ``rows_per_language`` rows at
    most are used, chosen by a hash of the text; this bounds the fit, not the prediction."""
    rows = docs.filter(learn).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return [], np.zeros((0, DIMENSIONS), dtype=np.float32)
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, rows_per_language / n)) for lang, n in counts.items()], "lang string, share double")
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(shares), "lang").filter(drawn < F.col("share")).select("text", "lang")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in _parts(batches):
            vectors, _ = profiles(batch.column(0).to_pylist())
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = sample.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    known = sorted(counts)
    place = {lang: i for i, lang in enumerate(known)}
    sums = np.zeros((len(known), DIMENSIONS))
    for r in parts.collect():
        sums[place[r["lang"]], r["i"]] = r["x"]
    used = np.linalg.norm(sums, axis=1) > 0
    known, sums = [lang for lang, u in zip(known, used, strict=True) if u], sums[used]
    return known, (sums / np.linalg.norm(sums, axis=1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, languages: Sequence[str], prototypes: np.ndarray, *, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The documents (columns ``keep``, or all) with ``lang_pred`` and ``score`` (the cosine,
    0 to 1). A text that is null or has no letter is ``und`` with score 0, and so is any text
    if nothing was learnt. Ties go to the language that sorts first. Repeated rows each give
    a row; an empty table gives an empty table. No shuffle; the prototypes are a few KB for
    each language."""
    names = list(keep or docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text_col).alias("_text"))
    known = list(languages)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            vectors, letters = profiles(batch.column(1).to_pylist())
            pred, best = [UNKNOWN] * len(letters), np.zeros(len(letters))
            if known and len(letters):
                cosines = vectors @ prototypes.T
                at = cosines.argmax(axis=1)
                best = np.where(letters, np.clip(cosines.max(axis=1).astype(float), 0, 1), 0)
                pred = [known[i] if ok else UNKNOWN for i, ok in zip(at, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(best, pa.float64())], ["_row", "_pred", "_score"])

    schema = rows.select("_row").schema.add("_pred", "string").add("_score", "double")
    out = rows.mapInArrow(score, schema)
    return out.select(*unpacked(out, names, lang_pred=F.col("_pred"), score=F.col("_score")))


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of documents that nothing is learnt from; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
