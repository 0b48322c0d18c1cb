"""Word shingles of texts as sorted arrays of 63-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
HOT_BIT = np.uint64(1 << 63)  # hot shingles sort after all others
CHUNK_BYTES = 1 << 20  # hashing takes some 50 bytes of memory a byte of text


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weights(n: int, seed: int) -> np.ndarray:
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


BYTE_WEIGHTS = _weights(4096, 0)
PLACE_WEIGHTS = _weights(64, 1 << 20)


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word (run of bytes that are no ASCII space) of a buffer."""
    space = SPACES[buf]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    body = buf[starts[0] :]
    lengths = np.diff(np.append(starts, len(buf)))
    offset = np.arange(len(body), dtype=np.int64) - np.repeat(starts - starts[0], lengths)
    value = BYTE_WEIGHTS[offset & 4095] * (body.astype(np.uint64) + np.uint64(1))
    value[space[starts[0] :]] = 0
    return starts, mixed(np.add.reduceat(value, starts - starts[0]))


def _sets(raws: Sequence[bytes], k: int, hot: np.ndarray | None) -> Iterator[np.ndarray]:
    joined = np.frombuffer(b"\n".join([*raws, b""]).lower(), dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    starts, words = word_hashes(joined)
    edges = np.concatenate([[0], np.searchsorted(starts, ends)])
    n = max(0, len(words) - k + 1)
    grams = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        grams += words[j : j + n] * PLACE_WEIGHTS[j]
    grams = _marked(grams, hot)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            whole = np.sum(words[a:b] * PLACE_WEIGHTS[: b - a], keepdims=True) + PLACE_WEIGHTS[64 - (b - a)]
            yield _marked(whole, hot)
        else:
            yield np.zeros(0, dtype=np.uint64)


def _marked(grams: np.ndarray, hot: np.ndarray | None) -> np.ndarray:
    grams = mixed(grams) >> np.uint64(1)
    if hot is not None and len(hot) and len(grams):
        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        grams = np.where(hot[at] == grams, grams | HOT_BIT, grams)
    return grams


def shingle_sets(raws: Sequence[bytes | None], k: int, hot: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles. Words are split at
    ASCII white space, A-Z lower-cased. Fewer than ``k`` words are one shingle; no words, or
    null, none. ``hot``: sorted hashes that are to sort last."""
    group: list[bytes] = []
    size = 0
    for raw in raws:
        group.append(raw or b"")
        size += len(group[-1])
        if size >= CHUNK_BYTES:
            yield from _sets(group, k, hot)
            group, size = [], 0
    if group:
        yield from _sets(group, k, hot)
