import numpy as np
import pytest
from pyspark.sql import functions as F
from tanglemap.llm import mixing

DOCS, LABELS = "doc_id long, text string, rate int", "doc_id long, domain string"


def corpus(spark, n=240):
    words = {"a": "alpha apple arrow amber", "b": "beta bread brick bronze", "c": "cobalt crown cedar cliff"}
    names = ["a" if i % 10 < 6 else "b" if i % 10 < 9 else "c" for i in range(n)]
    docs = [(i, " ".join([words[d]] * (1 + i % 5)) + f" common words w{i}", 7) for i, d in enumerate(names)]
    labels = [(i, d) for i, d in enumerate(names) if i % 2]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), names


def test_targets_are_met(spark):
    docs, labels, names = corpus(spark)
    rows = mixing.mix(docs, labels, {"a": 0.5, "b": 0.5}).collect()
    totals = {k: sum(r["rate"] * r["n_tokens"] * r[f"p_{k}"] for r in rows) for k in "abc"}
    assert abs(totals["a"] / (totals["a"] + totals["b"]) - 0.5) < 0.02 and totals["c"] < 0.03 * totals["a"]
    assert all(r["rate"] >= 0 for r in rows)
    guess = ["abc"[int(np.argmax([r["p_a"], r["p_b"], r["p_c"]]))] for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert np.mean([g == n for g, n in zip(guess, names, strict=True)]) > 0.95
    copies = sum(r["copies"] for r in rows if r["p_b"] > 0.5) / sum(r["rate"] for r in rows if r["p_b"] > 0.5)
    assert 0.8 < copies < 1.2 and all(r["copies"] == 0 for r in rows if r["p_c"] > 0.9)


def scored_rows(spark, n, seed):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.3, 0.3, 0.3], n)
    tokens = rng.integers(1, 100, n).astype(float)
    return p, tokens, spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(tokens, p, strict=True)], "n_tokens long, posterior array<double>")


def test_rates_meet_targets_within_reach(spark):
    p, tokens, scored = scored_rows(spark, 500, 1)
    rates = mixing.fit_rates(scored, ["x", "y", "z"], {"x": 0.3, "y": 0.4, "z": 0.3}, total=40_000, sure=2)
    assert np.allclose((rates.of(p) * tokens) @ p, [12_000, 16_000, 12_000], rtol=1e-3)
    assert np.allclose(list(rates.reached.values()), (rates.of(p) * tokens) @ p) and list(rates.target.values()) == [12_000, 16_000, 12_000]


@pytest.mark.parametrize("sure", [0.5, 2.0])
def test_rates_solve_bounded_least_squares(spark, sure):
    """Against cyclic coordinate descent on the same bounded least squares."""
    p, tokens, scored = scored_rows(spark, 60, 2)
    rates = mixing.fit_rates(scored, ["x", "y", "z"], {"x": 0.9, "y": 0.1}, sure=sure)
    target = np.array(list(rates.target.values()))
    a = p * tokens[:, None]
    metric = np.linalg.inv(a.T @ p)
    floor = np.where(p[:, :2].sum(axis=1) >= sure, 1.0, 0.0)
    rate = np.ones(len(p))
    for _ in range(3_000):
        for i in range(len(rate)):
            rate[i] = max(floor[i], rate[i] - a[i] @ metric @ (rate @ a - target) / (a[i] @ metric @ a[i]))
    loss = lambda r: (r @ a - target) @ metric @ (r @ a - target)
    assert (rates.of(p) >= floor).all()
    assert loss(rates.of(p)) - loss(rate) <= 3e-4 * (loss(np.ones(len(p))) - loss(rate))


def test_copies_follow_rates_and_wanted_documents_stay(spark):
    docs, labels, _ = corpus(spark, 1_500)
    rows = mixing.mix(docs, labels, {"a": 0.5, "b": 0.5}).collect()
    wanted = [r for r in rows if r["p_a"] + r["p_b"] >= 0.5]
    assert all(r["copies"] >= 1 for r in wanted) and all(np.floor(r["rate"]) <= r["copies"] <= np.ceil(r["rate"]) for r in rows)
    tokens = lambda field: sum(r[field] * r["n_tokens"] for r in rows)
    assert abs(tokens("copies") / tokens("rate") - 1) < 0.02


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "alpha apple " * 200_000, 0), (2, "beta bread " * 3, 0)], DOCS)
    rows = {r["doc_id"]: r for r in mixing.mix(docs, spark.createDataFrame([(1, "a"), (2, "b")], LABELS), {"a": 1.0, "b": 1.0}).collect()}
    assert rows[1]["n_tokens"] == 400_000 and rows[2]["n_tokens"] == 6


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "x y", 0), (2, "", 0), (3, "a b c", 0), (3, "a b c", 0)], DOCS)
    none = spark.createDataFrame([], LABELS)
    rows = mixing.mix(docs, none, {"a": 1.0}).collect()
    assert len(rows) == 5 and all(r["rate"] == 1.0 and r["copies"] == 1 for r in rows)
    odd = spark.createDataFrame([(1, "a"), (None, "b"), (3, "b"), (99, "a"), (2, None)], LABELS)
    assert mixing.mix(docs, odd, {"a": 1.0, "missing": 1.0}).count() == 5
    assert mixing.mix(docs.limit(0), odd, {"a": 1.0}).count() == 0
    assert mixing.quality_domains(spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 0, None), (4, None, None)], "doc_id long, quality int, toxic int")).filter(F.col("domain").isNull()).count() == 1


def test_texts_are_scored_once(spark, monkeypatch):
    docs, labels, _ = corpus(spark)
    passes, score = [], mixing.domain_posteriors
    monkeypatch.setattr(mixing, "domain_posteriors", lambda *a, **kw: (passes.append(1), score(*a, **kw))[1])
    once = sorted(map(tuple, mixing.mix(docs, labels, {"a": 0.5, "b": 0.5}, keep=["doc_id"]).collect()))
    assert len(passes) == 1
    whole = mixing.mix(docs, labels, {"a": 0.5, "b": 0.5}, keep=["doc_id", "text"]).drop("text")
    assert np.allclose(np.array(once), np.array(sorted(map(tuple, whole.collect()))), rtol=1e-6)
    assert mixing.mix(docs, labels.limit(0), {"a": 1.0}, keep=["doc_id"]).filter("rate = 1 and copies = 1").count() == 240
