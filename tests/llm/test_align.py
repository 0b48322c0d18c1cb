import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tanglemap.llm import align
from tanglemap.llm.registry import op13_token_alignment
from tokenizers import Tokenizer

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def dense(m):
    out = np.zeros((len(m.ptr) - 1, m.n_cols), dtype=int)
    np.add.at(out, (m.rows, m.cols), m.values)
    return out


def random_csr(rnd, rows, cols):
    entries = [(i, j, rnd.randint(1, 3)) for i in range(rows) for j in rnd.sample(range(cols), rnd.randint(0, cols))]
    ptr = np.cumsum([0, *(sum(e[0] == i for e in entries) for i in range(rows))])
    return align.Csr(ptr, np.array([e[1] for e in entries], dtype=np.int64), np.array([e[2] for e in entries], dtype=np.int64), cols)


def test_products_against_dense_matrices():
    rnd = random.Random(1)
    for _ in range(200):
        n, m, k = (rnd.randint(1, 6) for _ in range(3))
        x, y = random_csr(rnd, n, m), random_csr(rnd, m, k)
        assert (dense(x.transposed()) == dense(x).T).all()
        assert (dense(x.times(y)) == dense(x) @ dense(y)).all()


def test_alignment_against_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        total = rnd.randint(1, 40)
        cut = lambda: sorted({*rnd.sample(range(1, total + 1), rnd.randint(0, total)), total})  # noqa: B023, E731
        ends = cut(), cut()
        a, b = (np.diff(np.array([0, *e])) for e in ends)
        spans = [list(zip([0, *e[:-1]], e, strict=True)) for e in ends]
        want = {(i, j): min(x[1], y[1]) - max(x[0], y[0]) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if min(x[1], y[1]) > max(x[0], y[0])}
        for block in (1, 7, 1000):
            assert {(int(i), int(j)): int(v) for part in align.overlaps(a, b, block) for i, j, v in zip(*part, strict=True)} == want
        found = align.align(a, b)
        assert list(zip(*map(list, found.links), strict=True)) == [(ends[0].index(e), ends[1].index(e)) for e in ends[0] if e in ends[1]]
        assert found.n_overlaps == len(want)
        shared = [pair for rows in found.shared_links() for pair in zip(*map(list, rows), strict=True)]
        group = lambda e: sum(c < e for c in set(ends[0]) & set(ends[1]))  # noqa: B023, E731
        assert shared == [(i, j) for g in range(total) for i, x in enumerate(ends[0]) for j, y in enumerate(ends[1]) if group(x) == group(y) == g]
        assert found.shared().sum() == len(shared)


def odd_texts():
    rnd = random.Random(3)
    spans = [(32, 0x2FF), (0x400, 0x6FF), (0x4E00, 0x9FFF), (0x1F300, 0x1F6FF), (0xAC00, 0xD7A3)]
    yield from [None, "", " ", "  a  ", "a", "a▁b", "<|endoftext|> </s><s> <0x41>", "tab\tnew\n\nline 　x", "͸՘땎", "日本語" * 50]
    for i in range(60):
        yield "".join(chr(rnd.randint(*spans[i % 5])) if rnd.random() < 0.8 else " " for _ in range(rnd.randint(1, 80)))
        yield " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 40)))


def brute(texts, libraries):
    """Rows in order: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    hf, sp = libraries
    alphabet = align.byte_alphabet()
    docs, times = [], Counter()
    for text in texts:
        a = hf.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        raw_a = [bytes(alphabet[c] for c in hf.id_to_token(i)) for i in a]
        raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(raw_a) != f" {text}".encode() or b"".join(raw_b) != f" {text}".encode():
            docs.append(([], [], []))
            continue
        ends = [np.cumsum([len(t) for t in raws]).tolist() for raws in (raw_a, raw_b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in common]
        for side in (0, 1):
            for i, e in zip((a, b)[side], ends[side], strict=True):
                groups[bisect.bisect_left(common, e)][side].append(i)
        at = dict(zip(ends[1], b, strict=True))  # tokens are never empty, so one ends at a byte
        links = [(i, at[e]) for i, e in zip(a, ends[0], strict=True) if e in at]
        times.update(links)
        docs.append((groups, links, (a, b)))
    best = defaultdict(int)
    for (_, j), n in times.items():
        best[j] = max(best[j], n)
    for groups, links, ids in docs:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        yield len(ids[0]) if ids else 0, len(ids[1]) if ids else 0, len(groups), len(links), sum(times[x] == best[x[1]] for x in links), sum(times[x] for x in links), said


def test_tokens_of_every_character(libraries):
    """The public encoder cuts like the vocabulary's own library."""
    with open(A, "rb") as f:
        ours = align.ByteLevel(f.read(), public_tokenizers.PATTERN)
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"땎{c}땎1{c}1.{c} {c}" for c in chars[i : i + 50]) for i in range(0, len(chars), 50)]
    other = [e.ids for e in libraries[0].encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
    assert [t for t, x, y in zip(texts, ours.encode(texts), other, strict=True) if x != y] == []


def test_operator_against_brute_force(spark, libraries):
    texts = [*odd_texts(), "word " * 300, "word " * 300]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "x", 0)], "doc_id long, text string, Links int")
    aligned = align.align_tokens(docs, A, B, public_tokenizers.PATTERN)
    out = align.rate_links(aligned.withColumn("said", F.col("groups"))).collect()
    assert aligned.columns == ["doc_id", "text", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "links"]
    want = list(brute([*texts, "x"], libraries))
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.said) for r in out}
    assert len(out) == len(want)
    for i, row in enumerate(want[:-1]):
        assert got[i] == row, ascii(texts[i])
    assert got[None] == want[-1]
    assert align.rate_links(align.align_tokens(docs.limit(0), A, B, public_tokenizers.PATTERN)).count() == 0


def test_query_against_the_libraries(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], brute([r.text for r in docs], libraries), strict=True))
    for r in op13_token_alignment(spark, SF).collect():
        row = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == row[:6]
        assert r.groups_sha256 == (hashlib.sha256(row[6].encode()).hexdigest() if row[0] else "")
