import random

from tanglemap.llm import decontam

DOCS, ITEMS = "doc_id long, text string, hits string", "item_id long, text string"


def brute(docs, items, window):
    wins = {}
    for name, text in items:
        w = tuple((text or "").encode().translate(decontam.WORD_BYTES).split())
        m = min(window, len(w))
        for i in range(len(w) - m + 1) if m else ():
            wins.setdefault(w[i : i + m], set()).add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        w, hit, names = tuple((text or "").encode().translate(decontam.WORD_BYTES).split()), set(), set()
        for win, owners in wins.items():
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    names |= owners
        out.append((doc, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


def run(spark, docs, items, window, **more):
    out = decontam.find_contamination(spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame(items, ITEMS), window=window, **more).collect()
    return sorted([(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["hits"]), r["items"]) for r in out], key=repr)


def test_random_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "c", "D", "é"])
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    items = [(i, ", ".join(word() for _ in range(rng.randint(0, 8)))) for i in range(12)]
    for window in (1, 4, 6):
        assert run(spark, docs, items, window) == brute(docs, items, window)
        assert run(spark, docs, items, window, part_words=5) == brute(docs, items, window)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "One TWO three"), (3, "One TWO three"), (None, "two"), (4, "x " * 200_000 + "one two")]
    items = [(7, "one two"), (8, None), (9, "!!"), (None, "three"), (7, "three")]
    assert run(spark, docs, items, 10) == brute(docs, items, 10)
    assert all(r[2] == 0 for r in run(spark, docs, [], 10))
    assert run(spark, [], items, 10) == []
