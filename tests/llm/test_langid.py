import numpy as np
import pytest
from pyspark.sql import functions as F
from tanglemap.llm import langid

SCHEMA = "doc_id long, text string, lang string, score int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known, prototypes = langid.fit(docs, ~langid.held_out())
    out = langid.predict(docs, known, prototypes).filter(langid.held_out())
    right = out.filter(F.col("lang_pred") == F.col("lang")).count()
    assert right / out.count() > 0.97


def test_edges(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "123 !!", None, 1), (4, "the then there", "en", 1), (None, "der die das", "de", 1), (4, "the then there", "en", 1), (6, "the " * 600_000, "en", 1), (7, "ж", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known, prototypes = langid.fit(docs, F.lit(True))
    assert known == ["de", "en"]
    got = langid.predict(docs, known, prototypes).collect()
    by = [(r["doc_id"], r["lang_pred"]) for r in got]
    assert by.count((4, "en")) == 2 and (None, "de") in by and (6, "en") in by
    assert {(1, "und"), (2, "und"), (3, "und")} <= set(by)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert [f.name for f in langid.predict(docs, known, prototypes).schema] == ["doc_id", "text", "lang", "lang_pred", "score"]


def test_nothing_learnt_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc", None, 1)], SCHEMA)
    known, prototypes = langid.fit(docs, F.lit(True))
    assert langid.predict(docs, known, prototypes).first()["lang_pred"] == "und"
    assert langid.predict(docs.limit(0), known, prototypes).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 400])
def test_pieces_equal_whole(monkeypatch, size):
    text = "Some words -- that are  long\n\nenough, ÄÖ ж to be... cut in İ pieces! " * 20
    whole, _ = langid.profiles([text, "short", None, text[:30]])
    monkeypatch.setattr(langid, "CHUNK_CHARS", size)
    cut, letters = langid.profiles([text, "short", None, text[:30]])
    assert np.allclose(whole, cut, atol=1e-6) and letters.tolist() == [True, True, False, True]


def test_profile_against_brute_force():
    """Trigrams bound letter by letter."""
    order = langid._order()
    vector = lambda c: langid._signs(np.array([ord(c) if c.isalpha() else 0]))[0].astype(float)
    for text in ["Hi there", "a", "жук и Жук", "x  y"]:
        symbols = "".join(c if c.isalpha() else " " for c in f" {text.casefold()} ")
        symbols = " ".join(symbols.split())
        symbols = f" {symbols} "
        total = sum(vector(a) * vector(b)[order] * vector(c)[order][order] for a, b, c in zip(symbols, symbols[1:], symbols[2:]))
        assert np.allclose(langid.profiles([text])[0][0], total / np.linalg.norm(total), atol=1e-6)


def test_every_letter_has_its_own_vector():
    signs = langid._signs(np.array([ord(c) for c in "abzéжשあ漢"])).astype(int)
    assert (np.abs(signs @ signs.T - langid.DIMENSIONS * np.eye(len(signs))) < 0.25 * langid.DIMENSIONS).all()


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same words here", "b", 1), (2, "same words here", "a", 1)], SCHEMA)
    known, prototypes = langid.fit(docs, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, known, prototypes).collect()} == {"a"}
