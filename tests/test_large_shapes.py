"""Graphs of long paths and commits of many files, against plain references."""

import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from tanglemap.operators import graph, history


def components(edges):
    """Kosaraju's two walks."""
    out, back = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    order, seen = [], set()

    def walk(start, links, found):
        stack = [(start, iter(links.get(start, ())))]
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            step = next((n for n in rest if n not in seen), None)
            if step is None:
                found.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(links.get(step, ()))))

    for node in {n for e in edges for n in e}:
        if node not in seen:
            walk(node, out, order)
    seen.clear()
    for node in reversed(order):
        if node not in seen:
            found = []
            walk(node, back, found)
            if len(found) > 1:
                yield tuple(sorted(found))


def found_in(spark, edges):
    rows = graph.scc_cycles(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert all(r.component == r.members[0] for r in rows)
    return sorted(tuple(r.members) for r in rows)


@pytest.mark.parametrize("seed", [1])
def test_components_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = []
    for part in range(9):  # sparse and dense parts, rings that share nodes, ladders, tails
        nodes = [part * 1000 + i for i in range(rnd.randint(2, 30))]
        edges += [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(int(len(nodes) * rnd.choice([0.8, 1.2, 2])))]
        ring = rnd.sample(nodes, rnd.randint(2, len(nodes)))
        edges += zip(ring, [*ring[1:], ring[0]], strict=True)
        tail = [part * 1000 + 500 + i for i in range(9)]
        edges += [*zip(tail, tail[1:], strict=False), (tail[-1], nodes[0])]
        if part % 3 == 0:
            edges += [(nodes[0], part * 1000 + 999), (part * 1000 + 999, ((part + 3) % 9) * 1000)]
    assert found_in(spark, edges) == sorted(components(edges))


def test_rounds_go_with_the_logarithm_of_the_path(spark, monkeypatch):
    cuts = []
    plain = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or plain(df))
    n = 10_000
    nodes = list(range(n))
    random.Random(3).shuffle(nodes)
    edges = [*zip(nodes, [*nodes[1:], nodes[0]], strict=True)]
    edges += [(n + i, n + i + 1) for i in range(2_000)] + [(n + 2_000, 5)]  # a tail in
    edges += [(7, 20_000)] + [(20_000 + i, 20_001 + i) for i in range(2_000)]  # and one out
    assert found_in(spark, edges) == [tuple(range(n))]
    assert len(cuts) < 60  # rounds store once or twice


def test_graphs_without_cycles(spark):
    assert found_in(spark, [(1, 2), (2, 3), (1, 3), (4, 4)]) == []
    assert graph.scc_cycles(spark.createDataFrame([], "src string, dst string")).count() == 0
    ladder = [(2 * i + a, 2 * i + 2 + b) for i in range(30) for a in (0, 1) for b in (0, 1)]
    assert found_in(spark, ladder) == []


def coupled(rows, min_shared, min_ratio, jaccard):
    commits = {}
    for commit, file in rows:
        commits.setdefault(commit, set()).add(file)
    n = Counter(f for files in commits.values() for f in files)
    shared = Counter(p for files in commits.values() for p in combinations(sorted(files), 2))
    for (a, b), k in shared.items():
        ratio = k / (n[a] + n[b] - k if jaccard else min(n[a], n[b]))
        if k >= min_shared and ratio >= min_ratio:
            yield a, b, k


@pytest.mark.parametrize(("min_shared", "min_ratio", "jaccard"), [(2, 0.3, False), (3, 0.6, False), (2, 0.4, True)])
def test_heavy_commits(spark, monkeypatch, min_shared, min_ratio, jaccard):
    monkeypatch.setattr(history, "BLOCK_FILES", 4)
    rnd = random.Random(4)
    files = [f"f{i:02d}" for i in range(40)]
    rows = [(f"c{c:02d}", f) for c in range(50) for f in rnd.sample(files, rnd.choice([1, 2, 3, 4, 12, 25]))]
    rows += rows[:20]
    frame = spark.createDataFrame(rows, "commit_id string, file_path string")
    got = history.temporal_coupling(frame, min_shared, min_ratio, jaccard=jaccard, heavy_files=5)
    want = sorted(coupled(rows, min_shared, min_ratio, jaccard))
    assert sorted((r.file_a, r.file_b, r.shared_commits) for r in got.collect()) == want and want


def test_one_commit_of_very_many_files_makes_no_pairs(spark):
    bulk = spark.range(20_000).selectExpr("'bulk' as commit_id", "concat('f', id) as file_path")
    small = spark.range(12).selectExpr("concat('c', id div 2) as commit_id", "concat('f', id % 2) as file_path")
    often = spark.range(15_000).selectExpr("concat('s', id % 5) as commit_id", "concat('f', id div 5) as file_path")
    got = history.temporal_coupling(bulk.union(small).union(often.filter("commit_id <> 's0'")), 5, 0.9, heavy_files=100)
    assert {(r.file_a, r.file_b) for r in got.filter("file_a in ('f0', 'f1') and file_b in ('f0', 'f1')").collect()} == {("f0", "f1")}


def test_commits_of_any_window(spark):
    rnd = random.Random(6)
    start = datetime(2024, 1, 1)
    moments = {f"c{i}": start + timedelta(minutes=rnd.randint(0, 60 * 24 * 120)) for i in range(400)}
    rows = [(c, t, f"{rnd.choice('abc')}/{rnd.randint(0, 5)}") for c, t in moments.items() for _ in range(rnd.randint(1, 4))]
    rows += [(None, start, "a/1"), ("none", None, "a/1"), *rows[:50]]
    frame = spark.createDataFrame(rows, "commit_id string, ts timestamp, file_path string")
    numbers = history.commit_numbers(frame).cache()
    bitmaps = history.commit_bitmaps(frame, numbers).cache()
    for since, until in (("2024-01-10 05:00:00", "2024-04-02 10:00:00"), ("2024-02-03 00:00:00", "2024-02-05 12:00:00"), ("2024-01-01 00:00:00", "2024-03-01 00:00:00"), ("2025-01-01 00:00:00", "2025-02-01 00:00:00")):
        low, high = map(datetime.fromisoformat, (since, until))
        want = {}
        for c, t, f in rows:
            if c and t and low <= t < high:
                want.setdefault(f[0], set()).add(c)
        got = history.commits_between(bitmaps, numbers, F.substring("file_path", 1, 1), since, until)
        assert {r.name: r.commits for r in got.collect()} == {k: len(v) for k, v in want.items()}
