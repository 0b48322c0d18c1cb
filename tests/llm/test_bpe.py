import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tanglemap.llm import bpe
from tanglemap.llm.registry import op12_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(ranks, n, seed=1):
    rnd, tokens = random.Random(seed), list(ranks)
    spans = [(32, 0x2FF), (0x400, 0x6FF), (0x4E00, 0x9FFF), (0x1F300, 0x1F6FF), (0xAC00, 0xD7A3)]
    for i in range(n):
        if i % 4 == 0:
            yield "".join(rnd.choice("abcdefghij etaoin  \n\t.,'s") for _ in range(rnd.randint(0, 200)))
        elif i % 4 == 1:
            yield "".join(chr(rnd.choice([rnd.randint(*rnd.choice(spans)), 0x20, 0x3000, 0xA0, 0x1C, 0x85, 0x378])) for _ in range(rnd.randint(0, 100)))
        elif i % 4 == 2:
            yield b"".join(rnd.choice(tokens) for _ in range(rnd.randint(0, 40))).decode(errors="ignore")
        else:
            yield rnd.choice(["ab", "a", "é", "-=", "aab", "  "]) * rnd.randint(1, 500)


def test_encodes_like_the_library(ranks, library):
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for text in texts(ranks, 2000):
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_small_tables_start_anew(ranks, library, monkeypatch):
    for name, value in {"STATES": 50, "PAIRS": 100, "WORDS": 20, "LONG_CHARS": 30}.items():
        monkeypatch.setattr(bpe, name, value)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for text in texts(ranks, 200, seed=2):
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_tokens_leave_within_bounded_lookahead(ranks, library):
    machine = bpe.Transducer(ranks)
    rnd = random.Random(3)
    raw = "".join(rnd.choice("etaoinshrdlu") for _ in range(100_000)).encode()
    held = []
    final = machine._final
    machine._final = lambda found, *rest: held.append(len(found)) or final(found, *rest)
    assert machine.encode(raw) == library.encode_ordinary(raw.decode())
    assert max(held) <= 3 * machine.ahead


def test_merge_order_decides():
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"cd": 259, b"aa": 260}
    machine = bpe.Transducer(ranks)
    for text in (b"abcd", b"abab", b"aaaaab", b"aaabcdab", b"bcdabc" * 300):
        assert machine.encode(text) == [ranks[t] for t in bpe.merges_of(text, ranks)[0]]
    with pytest.raises(ValueError):
        bpe.Transducer({b"a": 0})


def test_decoder_is_a_utf8_machine(ranks):
    rnd = random.Random(4)
    for _ in range(2000):
        raw = bytes(rnd.choice([rnd.randint(0, 255), rnd.randint(0x80, 0xBF), 0xE0, 0xED, 0xF0, 0xF4]) for _ in range(rnd.randint(0, 30)))
        decoder, out = bpe.Decoder(ranks), ""
        ids = [ranks[bytes([b])] for b in raw]
        while ids:  # in portions
            n = rnd.randint(1, 5)
            out += decoder.push(ids[:n])
            ids = ids[n:]
        assert out + decoder.finish() == raw.decode(errors="replace")


def test_odd_rows(spark, library):
    long = "".join(random.Random(5).choice("ab cé日 ") for _ in range(300_000))
    rows = [(1, None, 0), (2, "", 0), (3, "<|endoftext|> a", 0), (3, "<|endoftext|> a", 0), (None, long, 0), (4, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDs int")
    out = bpe.decode_ids(bpe.encode_texts(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted(((r.doc_id or 0, r.text, list(r.ids), r.decoded) for r in out.collect()), key=repr)
    assert got == sorted(((i or 0, t, library.encode_ordinary(t or ""), t or "") for i, t, _ in rows), key=repr)
    assert bpe.encode_texts(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    broken = spark.createDataFrame([(1,)], "doc_id long").select("doc_id", F.expr("cast(unhex('61FF62') as string)").alias("text"))
    assert bpe.encode_texts(broken, PATH, public_tokenizers.PATTERN).first()["ids"] == library.encode_ordinary("a�b")
    null = bpe.decode_ids(spark.createDataFrame([(1, None)], "k int, ids array<int>"), PATH)
    assert null.first()["decoded"] is None


def test_query_against_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in op12_bpe(spark, SF).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(docs[r.doc_id]))


def test_lists_of_ids_make_no_scalar_of_each():
    column = pa.array([[9], [1, 2, 3], None, [], [4]], pa.list_(pa.int32())).slice(1)
    assert list(bpe.numbers_of(column)) == [[1, 2, 3], None, [], [4]] and all(type(i) is int for i in next(bpe.numbers_of(column)))
    with pytest.raises(pa.ArrowInvalid):
        list(bpe.numbers_of(pa.array([[1, None]], pa.list_(pa.int32()))))
    long = bpe.id_lists([np.arange(1_000_000, dtype=np.int32)])
    begun = time.process_time()
    got = list(bpe.numbers_of(long))
    between = time.process_time()
    assert got == [long[0].values.to_pylist()]
    assert 3 * (between - begun) < time.process_time() - between


def test_the_start_is_left_only_by_unfinished_characters(ranks):
    decoder = bpe.Decoder(ranks)
    ids = [ranks[b"a"], ranks[bytes([0xC3])], ranks[bytes([0xA9])], ranks[b"b"]]
    assert decoder.decode(ids) == decoder.decode(ids) == "a\u00e9b" and set(decoder.whole) == {ids[0], ids[3]}
    assert decoder.push(ids[:2]) == "a" and decoder.push([ids[3]]) == "\ufffdb" and decoder.decode([ids[3], ids[0]]) == "ba"
