import random
import re

import numpy as np
import pytest
from tanglemap.llm import jaccard
from tanglemap.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, component_id string"


def brute(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids and sets[i] else doc))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    out = jaccard.jaccard_components(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), **more).collect()
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out], key=repr)


def near(rng, words, share):
    return [w if rng.random() > share else f"n{rng.randrange(9999)}" for w in words]


@pytest.mark.parametrize("seed", [512, 4])
def test_random_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for group in range(12):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 10, 60, 150]))]
        rows += [" ".join(near(rng, words, rng.choice([0, 0.01, 0.03, 0.06]))) for _ in range(rng.choice([1, 4, 12]))]
    line = " ".join(f"c{i}" for i in range(40))
    rows += [line + " " + " ".join(f"u{rng.randrange(9999)}" for _ in range(rng.randint(1, 12))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(rows)]
    assert run(spark, rows, k=4, num=85, den=100) == brute(rows, 4, 85, 100)
    assert run(spark, rows, k=5, num=80, den=100) == brute(rows, 5, 80, 100)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (3, "one  TWO"), (9, "one"), (9, "one"), (None, "one"), (1, "a b c d e"), (2, "A b c d e"), (4, "É b c d e f g"), (10, "é b c d e f g"), (11, "x " * 100_000), (12, "x " * 90_000)]
    assert run(spark, rows) == brute(rows, 4, 85, 100)
    assert run(spark, []) == []


def family(size, seed):
    """Near copies of one text of which no two begin alike; words replaced, dropped or added."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(size):
        own = [f"only{i}", *words]
        for _ in range(rng.choice([0, 1, 2, 3])):
            at = rng.randrange(1, len(own))
            own[at : at + rng.choice([0, 1, 1, 4])] = rng.choice([[], [f"e{rng.randrange(40)}"], [f"o{rng.randrange(9999)}", "and"]])
        texts.append(" ".join(own))
    return texts


def components_by_matrix(texts, k, num, den):
    sets = [{t[i : i + k] for i in range(len(t) - k + 1)} for t in (tuple(x.split()) for x in texts)]
    place = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(place)), dtype=np.float32)
    for i, s in enumerate(sets):
        m[i, [place[g] for g in s]] = 1
    both, n = m @ m.T, m.sum(axis=1)
    linked = den * both >= num * (n[:, None] + n[None, :] - both)
    label = np.arange(len(sets))
    while True:
        least = np.array([label[row].min() for row in linked])
        if (least == label).all():
            return label
        label = least


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_large_family_is_exact_and_visits_few_groups(spark, monkeypatch, k, num):
    seen = []
    visits = jaccard._visits

    def counted(*args):
        out = visits(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_visits", counted)
    texts = family(2_000, num)
    rows = list(enumerate(texts))
    got = {d: c for d, _, c in run(spark, rows, k=k, num=num, den=100)}
    want = components_by_matrix(texts, k, num, 100)
    assert got == {i: int(c) for i, c in enumerate(want)}
    assert 1 < len(set(got.values())) < len(rows)
    assert seen[0] <= len(rows)


def test_the_middle_is_found_without_a_join_of_differences(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    common, keys, join = list(range(100, 110)), [], DataFrame.join
    rows = [(0, c, True, 50, 50, common + ([1000 + c] if c != 5 else []), 11 if c != 5 else 10) for c in range(1, 21)]
    entries = spark.createDataFrame([*rows, (9, 30, True, 50, 50, [1, 2], 2)], "grp long, cls long, home boolean, n long, ln long, diff array<long>, d long")
    monkeypatch.setattr(DataFrame, "join", lambda self, other, on=None, how=None: (keys.append(on), join(self, other, on, how))[1])
    got = {r["cls"]: (r["leader"], sorted(r["diff"]), r["d"]) for r in jaccard._recentred(entries).collect()}
    assert got == {c: (5, [1000 + c] if c != 5 else [], int(c != 5)) for c in range(1, 21)} | {30: (9, [1, 2], 2)}
    assert keys and not any("token" in on for on in keys)


def test_a_common_passage_is_hot_wherever_its_hashes_fall(spark):
    rng = random.Random(9)
    hashes = lambda text: next(shingle_sets([text.encode()], 4))
    tried = [f"p7 p8 p9 low{i}" for i in range(20_000)]
    low = tried[np.argmin([s[0] for s in shingle_sets([t.encode() for t in tried], 4)])]  # among the first of any text
    passage = " ".join([*(f"p{i}" for i in range(7)), low, *(f"p{i}" for i in range(10, 20))])
    holders = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(100)) + " " + passage for _ in range(60)]
    words = [f"f{i}" for i in range(120)]
    copies = [" ".join(near(rng, words, 0.02)) for _ in range(60)]
    texts = spark.createDataFrame([(t,) for t in holders + copies], "text string").coalesce(1)
    hot = set(jaccard.hot_shingles(texts, 4).tolist())
    assert set(hashes(passage).tolist()) <= hot
    assert hot.isdisjoint(hashes(" ".join(words)).tolist())
