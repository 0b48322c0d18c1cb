"""Byte-level BPE as a finite-state transducer, and decoding as an incremental UTF-8 machine.

Two tokens may be neighbours if the merges, run over their joined bytes, give back these
two; an encoding is the one sequence of tokens in which all neighbours may be, and so are
its beginnings. So a text is read once from left to right. The nondeterministic machine
may begin any token at any byte; its determinised state is the set of token beginnings
under way, and a move says which tokens end at the byte read. Of these one may follow the
token that ended where it begins, which the machine keeps for as many bytes back as a
token is long. A token is final, and emitted, once all hypotheses under way have it before
them. States, moves and the relation of neighbours are made when first met.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tanglemap.llm.common import packed, unpacked

NEVER = 1 << 62  # a rank above all others
PARTS = -1
STATES = 100_000  # states held before the machine starts anew
PAIRS = 500_000  # pairs of tokens remembered
WORDS = 150_000  # words whose tokens are remembered, in two generations; none is longer than
WORD_CHARS = 40
LONG_CHARS = 1 << 20  # longer texts are cut word by word
BATCH_IDS = 1 << 20

#: Unicode white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where texts are cut before the pattern, so that words are met again: before each run of white
#: space, and after a word of ASCII letters before a mark. A pattern must have a match for each
#: word and none across such a cut, as the usual ones that tell letters from marks.
WORD = re.compile(f" ?[A-Za-z]+(?=[{SPACE}.,;:!?)]|$)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

#: Letters and numbers that Unicode 16 added. Which characters are letters is a
#: matter of versions; that of the public encoder is 16, that of ``unicodedata`` may be older,
#: and ``regex`` counts some that are not assigned.
ADDED = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
NO_LETTER = "\ue000"  # stands for characters that are not assigned


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of a token in base 64 and its rank, which is its id."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merges_of(raw: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
    """The merges run plainly: the pair whose union has the lowest rank first, from the left.
    What is left, and of each merge its rank and the first and last part after it."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    steps = []
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return parts, steps
        rank, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        steps.append((rank, parts[0], parts[-1]))


class Transducer:
    """Reads the bytes of one piece and emits its tokens; see the module."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [i for i in range(256) if bytes([i]) not in ranks]:
            raise ValueError(f"no token for the bytes {missing}")
        self.ranks = ranks
        self.ahead = 4 * max(map(len, ranks))  # bytes after which what is final is emitted
        self.prefixes = {token[:n] for token in ranks for n in range(1, len(token) + 1)}
        self.steps: dict[bytes, list[tuple[int, bytes, bytes]] | None] = {}
        self.follows: dict[bytes, dict[bytes, bool]] = {}
        self.pairs = 0
        self._anew()

    def _anew(self) -> None:
        self.start: dict = {PARTS: ()}  # a state: by byte the next state and what ends there; its token beginnings
        self.states = {(): self.start}

    def _steps(self, token: bytes) -> list[tuple[int, bytes, bytes]] | None:
        """The merges that make a token, or null if they do not make it. One entry a token."""
        if token not in self.steps:
            parts, steps = merges_of(token, self.ranks)
            self.steps[token] = [*steps, (NEVER, token, token)] if len(parts) == 1 else None
        return self.steps[token]

    def neighbours(self, left: bytes, right: bytes) -> bool:
        """Whether ``right`` may follow ``left`` (or begin a piece, if that is empty): of the
        merges inside either and of the pair that meets at the seam, the lowest rank is never
        that of the seam; of equal ranks the merge further left comes first."""
        ranks = self.ranks
        before, after = self._steps(left) if left else [(NEVER, left, left)], self._steps(right)
        if before is None or after is None or (left and left + right in ranks):
            return False
        i = j = 0
        a, b = left[-1:], right[:1]
        while True:
            seam = ranks.get(a + b, NEVER) if left else NEVER
            if before[i][0] <= after[j][0]:
                if seam < before[i][0]:
                    return False
                if before[i][0] == NEVER:
                    return True
                a = before[i][2]
                i += 1
            else:
                if seam <= after[j][0]:
                    return False
                b = after[j][1]
                j += 1

    def _follows(self, known: dict[bytes, bool], left: bytes, right: bytes) -> bool:
        if self.pairs >= PAIRS:
            for pairs in self.follows.values():
                pairs.clear()
            self.pairs = 0
        self.pairs += 1
        known[left] = may = self.neighbours(left, right)
        return may

    def _move(self, state: dict, code: int) -> tuple[dict, list]:
        """Makes the move of a state by a byte: the next state, and the tokens that end at the byte,
        the longest first, each with its length and what is known of tokens before it."""
        byte = bytes([code])
        after = tuple(part + byte for part in (*state[PARTS], b"") if part + byte in self.prefixes)
        found = [(part, len(part), self.follows.setdefault(part, {})) for part in after if part in self.ranks]
        if len(self.states) >= STATES:
            self._anew()  # texts under way keep the states they are in
        move = state[code] = (self.states.setdefault(after, {PARTS: after}), found)
        return move

    def _end(self, found: list[list], ends: list, n: int) -> bytes | bool:
        """The token that ends after ``n`` bytes: of those that may, the one that may follow the
        token which ends where it begins. False if all begin before what is held."""
        for token, size, follows in found[n]:
            if size <= n:
                left = ends[n - size]
                if left is None:
                    left = self._end(found, ends, n - size)
                if left is False:
                    continue
                may = follows.get(left)
                if may or (may is None and self._follows(follows, left, token)):
                    ends[n] = token  # only one encoding ends here
                    return token
        ends[n] = False
        return False

    def _back(self, found: list[list], ends: list, n: int) -> list[bytes]:
        """The tokens of the first ``n`` bytes."""
        out = []
        while n:
            out.append(ends[n] or self._end(found, ends, n))
            n -= len(out[-1])
        return out[::-1]

    def _final(self, found: list[list], ends: list, state: tuple[bytes, ...]) -> list[bytes]:
        """The tokens that all hypotheses have before them."""
        n = len(ends) - 1
        chains = [self._back(found, ends, n - len(part)) for part in (*state, b"") if len(part) <= n]
        shared = min(map(len, chains))
        while any(chain[:shared] != chains[0][:shared] for chain in chains):
            shared -= 1
        return chains[0][:shared]

    def encode(self, raw: bytes) -> list[int]:
        """The ids of one piece. A piece that is a token is that token, whatever the merges say."""
        ranks = self.ranks
        if (known := ranks.get(raw)) is not None:
            return [known]
        out: list[int] = []
        first, found = b"", [[]]  # the token before, and what may end after so many bytes
        state, ahead = self.start, self.ahead
        for byte in raw:
            state, ending = state.get(byte) or self._move(state, byte)
            found.append(ending)
            if len(found) > ahead:
                final = self._final(found, [first, *[None] * (len(found) - 1)], state[PARTS])
                if final:
                    out += [ranks[token] for token in final]
                    first = final[-1]
                    del found[1 : sum(map(len, final)) + 1]
                ahead = len(found) + self.ahead
        return out + [ranks[token] for token in self._back(found, [first, *[None] * (len(found) - 1)], len(found) - 1)]


class Encoder(dict):
    """Texts to ids. ``pattern`` cuts a text into pieces, which are encoded each by itself. As a
    dict it holds the ids of words met of late, as bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.old: dict[str, bytes] = {}

    def pieces(self, word: str) -> list[str]:
        if word.isascii():
            return self.pattern.findall(word)
        assigned = lambda c: c < "\u0100" or unicodedata.category(c) != "Cn" or any(a <= ord(c) <= b for a, b in ADDED)
        told = "".join([c if assigned(c) else NO_LETTER for c in word])
        return [word[m.start() : m.end()] for m in self.pattern.finditer(told)]

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("i", [i for piece in self.pieces(word) for i in self.machine.encode(piece.encode())]).tobytes()
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        words = WORD.findall(text) if len(text) <= LONG_CHARS else (m[0] for m in WORD.finditer(text))
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=np.int32)


# --- decoding -------------------------------------------------------------------------

REPLACEMENT = "\ufffd"
#: The well-formed sequences of UTF-8 as ranges of the first byte, of the second, and the bytes in all.
SEQUENCES = ((0x00, 0x7F, 0, 0, 1), (0xC2, 0xDF, 0x80, 0xBF, 2), (0xE0, 0xE0, 0xA0, 0xBF, 3), (0xE1, 0xEC, 0x80, 0xBF, 3), (0xED, 0xED, 0x80, 0x9F, 3), (0xEE, 0xEF, 0x80, 0xBF, 3), (0xF0, 0xF0, 0x90, 0xBF, 4), (0xF1, 0xF3, 0x80, 0xBF, 4), (0xF4, 0xF4, 0x80, 0x8F, 4))
FIRST = {first: (low, high, size) for a, b, low, high, size in SEQUENCES for first in range(a, b + 1)}


def utf8_step(held: bytes, byte: int) -> tuple[str, bytes]:
    """One move of the machine: ``held`` is an unfinished character (its state), what comes out
    is text and the new state. A sequence that cannot go on becomes U+FFFD."""
    if held:
        low, high, size = FIRST[held[0]]
        if (low <= byte <= high) if len(held) == 1 else (0x80 <= byte <= 0xBF):
            held += bytes([byte])
            return (held.decode(), b"") if len(held) == size else ("", held)
        text, held = utf8_step(b"", byte)
        return REPLACEMENT + text, held
    if byte not in FIRST:
        return REPLACEMENT, b""
    return (chr(byte), b"") if FIRST[byte][2] == 1 else ("", bytes([byte]))


class Decoder:
    """Ids to text as they come in; characters may be spread over tokens and calls."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {}
        self.whole: dict[int, str] = {}  # moves met that lead from the start back to it
        self.held = b""

    def _move(self, i: int) -> tuple[str, bytes]:
        text, held = [], self.held
        for byte in self.tokens[i]:
            more, held = utf8_step(held, byte)
            text.append(more)
        move = self.moves.setdefault(self.held, {})[i] = ("".join(text), held)
        if not self.held and not held:
            self.whole[i] = move[0]
        return move

    def push(self, ids: Sequence[int]) -> str:
        """The text that these ids complete."""
        out = list(map(self.whole.get, ids)) if not self.held else [None]
        if None not in out:  # the machine never leaves its start
            return "".join(out)
        out = []
        moves = self.moves.setdefault(self.held, {})
        for i in ids:
            text, held = moves.get(i) or self._move(i)
            if held != self.held:
                self.held = held
                if len(self.moves) > 4096:  # unfinished characters that were met
                    self.moves.clear()
                moves = self.moves.setdefault(held, {})
            out.append(text)
        return "".join(out)

    def finish(self) -> str:
        """What is left at the end of a text: an unfinished character is malformed."""
        held, self.held = self.held, b""
        return REPLACEMENT if held else ""

    def decode(self, ids: Sequence[int]) -> str:
        return self.push(ids) + self.finish()


# --- on Spark -------------------------------------------------------------------------


def file_bytes(spark: SparkSession, path: str):
    """A vocabulary file as a broadcast; its size is that of the vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=2)
def _encoder(raw: bytes, pattern: str) -> Encoder:
    return Encoder(read_ranks(raw), pattern)


@lru_cache(maxsize=2)
def _decoder(raw: bytes) -> Decoder:
    return Decoder(read_ranks(raw))


def batches_of(rows: Iterator[tuple], make, size, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``make(rows)``, of about ``most`` in sum of ``size(row)`` each."""
    held, held_size = [], 0
    for row in rows:
        held.append(row)
        held_size += size(row)
        if held_size >= most or len(held) >= 10_000:
            yield make(held)
            held, held_size = [], 0
    if held:
        yield make(held)


def id_lists(values: Sequence[np.ndarray]) -> pa.ListArray:
    """Arrays of 32-bit numbers as a list column, without a Python object for each number."""
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))


def numbers_of(column: pa.ListArray) -> Iterator[list[int] | None]:
    """The lists of a column of numbers, by way of numpy: Arrow's own way makes a scalar of each
    number first. Null lists are null, a null number fails."""
    for row in column:
        yield row.values.to_numpy().tolist() if row.is_valid else None


def _encoding(shared, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            rows = ((i, encoder.encode((texts[i].as_py() or b"").decode(errors="replace"))) for i in range(len(texts)))
            make = lambda held, of=batch: pa.RecordBatch.from_arrays([of.column(0).take(pa.array([i for i, _ in held])), id_lists([ids for _, ids in held])], ["_row", "_ids"])
            yield from batches_of(rows, make, lambda row: len(row[1]), BATCH_IDS)

    return encode


def encode_texts(docs: DataFrame, ranks: str, pattern: str, *, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The documents (columns ``keep``, or all) with ``ids``, the tokens of the whole text.

    ``ranks`` is the path of a vocabulary file on the driver, ``pattern`` cuts texts into
    pieces. Strings of special tokens are plain text. A null or empty text has no tokens;
    malformed UTF-8 is read as U+FFFD. Repeated rows each give a row, an empty table gives
    none. A column ``ids`` of the input gives way. Documents are encoded where they lie,
    one after the other, without a shuffle; a worker holds the vocabulary, a bounded part of
    the transducer, and batches of about a million tokens.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in keep]) if keep else docs
    row = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
    rows = docs.select(row.alias("_row"), F.col(f"`{text_col}`").cast("binary").alias("_raw"))
    schema = rows.select("_row").schema.add("_ids", ArrayType(IntegerType()))
    out = rows.mapInArrow(_encoding(file_bytes(docs.sparkSession, ranks), pattern), schema)
    return out.select(*unpacked(out, kept.columns, ids=F.col("_ids")))


def _decoding(shared):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared.value)
        for batch in batches:
            rows = ((i, None if ids is None else decoder.decode(ids)) for i, ids in enumerate(numbers_of(batch.column(1))))
            make = lambda held, of=batch: pa.RecordBatch.from_arrays([of.column(0).take(pa.array([i for i, _ in held])), pa.array([text for _, text in held], pa.string())], ["_row", "_decoded"])
            yield from batches_of(rows, make, lambda row: len(row[1] or ""), 4 * BATCH_IDS)

    return decode


def decode_ids(tokens: DataFrame, ranks: str, *, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of its ids. Null ids give null, no ids an empty text;
    what is not UTF-8 becomes U+FFFD. An id that the vocabulary lacks fails the job."""
    rows = packed(tokens, _ids=F.col(ids_col))
    schema = rows.select("_row").schema.add("_decoded", "string")
    out = rows.mapInArrow(_decoding(file_bytes(tokens.sparkSession, ranks)), schema)
    return out.select(*unpacked(out, tokens.columns, decoded=F.col("_decoded")))
