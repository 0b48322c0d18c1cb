import random

from pyspark.sql import functions as F
from tanglemap.llm import lines

SCHEMA = "doc_id long, text string, dropped string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def mutated(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text) + 1)
        text = rng.choice([text[:at] + rng.choice("abé") + text[at:], text[:at] + text[at + 1 :], text[:at] + rng.choice("abé") + text[at + 1 :]])
    return text


def test_distance_against_brute_force(spark):
    rng = random.Random(5)
    pairs = []
    for n in [0, 1, 2, 3, 5, 8, 30, 90]:
        for _ in range(25):
            a = "".join(rng.choice("abé") for _ in range(n))
            pairs.append((a, mutated(rng, a, rng.randint(0, 5))))
    frame = spark.createDataFrame(pairs, "x string, y string")
    for tau in (0, 1, 2, 3):
        got = frame.select("x", "y", lines.within_edits(F.col("x"), F.col("y"), tau).alias("near")).collect()
        for r in got:
            assert r["near"] == (distance(r["x"], r["y"]) <= tau), (r, tau)


def test_pairs_lose_nothing(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.choice([0, 2, 5, 6, 7, 11, 12, 13, 25, 40]))) for _ in range(60)]
    texts = sorted({mutated(rng, b, rng.randint(0, 3)) for b in base for _ in range(6)} | {"prefix that all of these share " + str(i) * 5 for i in range(150)})
    frame = spark.createDataFrame([(t,) for t in texts], "line string").select(F.xxhash64("line").alias("h"), "line")
    names = {r["h"]: r["line"] for r in frame.collect()}
    for tau in (1, 2):
        got = {frozenset((names[r["src"]], names[r["dst"]])) for r in lines.near_line_pairs(frame, tau).collect()}
        want = {frozenset((a, b)) for i, a in enumerate(texts) for b in texts[:i] if abs(len(a) - len(b)) <= tau and distance(a, b) <= min(tau, min(len(a), len(b)) // lines.PER_EDIT)}
        assert got == want


def test_documents(spark):
    a, near, far = "a line that is long enough to compare", "a line that is long enough to compere", "some other line that is also long"
    rows = [(1, f"{a}\nshort\n\n{far}", "z"), (2, f"{near}\nshort\nshorx\n  \n{a}", "z"), (3, None, "z"), (4, "", "z"), (None, f"{far}\nx", "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: (r["n_lines"], r["n_exact"], r["n_near"], r["dropped"]) for r in lines.duplicate_lines(docs).collect()}
    assert got == {1: (4, 1, 0, [3]), 2: (5, 2, 1, [0, 1, 4]), 3: (0, 0, 0, []), 4: (1, 0, 0, []), None: (2, 0, 0, [])}
    texts = {r["doc_id"]: r["text"] for r in lines.deduplicate_lines(docs).collect()}
    assert texts == {1: f"{a}\nshort\n", 2: "shorx\n  ", 3: None, 4: "", None: f"{far}\nx"}
    assert lines.duplicate_lines(docs.limit(0)).count() == 0


def test_repeated_rows_ties_and_a_very_long_line(spark):
    long = "word " * 60_000
    rows = [(7, f"{long}x", "z"), (7, f"{long}x", "z"), (8, f"{long}y\n{long}", "z"), (5, "same line here", "z"), (5, "same line here", "z")]
    got = sorted((r["doc_id"], r["n_lines"], r["n_exact"], r["n_near"], r["dropped"]) for r in lines.duplicate_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(5, 2, 0, 0, []), (7, 2, 0, 0, []), (8, 2, 0, 2, [0, 1])]
