"""Metrics kept by signed changes, and order statistics, against full computation."""

import random

import pytest
from pyspark.sql import functions as F
from tanglemap.operators import coupling, incremental, order_stats

EDGES = "src string, dst string, kind string"


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("file_path", "fan_in", "fan_out", "instability").collect())


def test_changes_equal_full_computation(spark):
    rnd = random.Random(1)
    names = [f"f{i}" for i in range(25)]
    kinds = ["IMPORTS_FROM", "USES_TYPE", "CALLS"]
    now = {n: [(n, rnd.choice(names), rnd.choice(kinds)) for _ in range(rnd.randint(0, 6))] for n in names[:20]}
    frame = lambda graph: spark.createDataFrame([e for edges in graph.values() for e in edges], EDGES)
    files = lambda graph: spark.createDataFrame([(n,) for n in graph], "file_path string")
    state = incremental.metric_state(files(now), frame(now))
    for step in range(2):
        before = dict(now)
        removed = rnd.sample(sorted(now), 2)
        added = rnd.sample([n for n in names if n not in now], 2)
        for n in removed:
            del now[n]
        changed = [*rnd.sample(sorted(now), 3), *added]
        for n in changed:
            now[n] = [(n, rnd.choice(names), rnd.choice(kinds)) for _ in range(rnd.randint(0, 6))]
        of = lambda listed: spark.createDataFrame([(n,) for n in listed], "file_path string")
        changes = incremental.edge_changes(frame(before), frame(now), of([*changed, *removed]))
        state = incremental.apply_changes(state, changes, of(added), of(removed))
        full = coupling.module_metrics(files(now), frame(now))
        assert rows_of(state.metrics()) == rows_of(full)
        assert rows_of(incremental.god_modules(state)) == rows_of(coupling.god_modules(full))
    nothing = incremental.edge_changes(frame(now), frame(now), of(names))
    assert nothing.count() == 0 and rows_of(incremental.apply_changes(state, nothing).metrics()) == rows_of(full)


def test_imports_that_mean_another_file(spark):
    files = ["pkg/a.py", "pkg/b.py", "pkg/__init__.py", "pkg/sub/c.py", "top.py"]
    after = ["pkg/a.py", "pkg/b/__init__.py", "pkg/sub/c.py", "top.py", "new.py"]
    targets = ["pkg.b", ".b", ".", "..a", "b", "new", "os", "pkg/b.py", "top", "pkg.sub.c"]
    edges = spark.createDataFrame([(f, t, "IMPORTS_FROM") for f in ["pkg/a.py", "pkg/sub/c.py", "top.py"] for t in targets], EDGES)
    of = lambda names: spark.createDataFrame([(n,) for n in names], "file_path string")
    got = incremental.resolution_changes(edges, of(files), of(sorted(set(after) - set(files))), of(sorted(set(files) - set(after))))
    resolved = lambda known: coupling.resolve_imports(edges, of(known)).select("src", F.col("resolved").alias("target"), "kind")
    sides = resolved(files).withColumn("sign", F.lit(-1)).unionByName(resolved(after).withColumn("sign", F.lit(1)))
    want = sides.groupBy("src", "target", "kind").agg(F.sum("sign").alias("sign")).filter("sign <> 0")
    told = lambda frame: sorted(map(repr, frame.select("src", "target", "kind", "sign").collect()))
    assert told(got) == told(want) and want.count() > 5


@pytest.mark.parametrize("kind", ["spread", "ties", "one value", "two values"])
def test_order_statistics(spark, monkeypatch, kind):
    monkeypatch.setattr(order_stats, "FEW", 5)
    monkeypatch.setattr(order_stats, "ACCURACY", 50)
    rnd = random.Random(2)
    draw = {"spread": rnd.random, "ties": lambda: rnd.randint(0, 9), "one value": lambda: 4, "two values": lambda: rnd.choice([1, 2])}[kind]
    values = [float(draw()) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    ranks = [1, 2, 250, 499, 500, 501, 0]
    assert order_stats.order_statistics(frame, "x", ranks) == [*(sorted(values)[r - 1] for r in ranks[:5]), None, None]
    assert order_stats.order_statistics(frame.limit(0), "x", [1]) == [None]
    plan = coupling.god_modules(frame.selectExpr("'f' as file_path", "x as fan_in", "x as fan_out", "x as instability"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
