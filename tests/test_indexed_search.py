"""Search from postings against the plain scan of all texts."""

import random

import pytest
from pyspark.sql import functions as F
from tanglemap.operators import search, search_index
from tanglemap.sources.catalog import Catalog
from tanglemap.sources.files import scan_files

SCHEMA = "node_id string, kind string, name string, body string, file_path string"
QUERIES = ["parse", "parse tree", "tree_walk", "user_create", "par", "p", "parseTree node", "ärger", "日", "missing", "", "?!", "node node", "walk_tree parse", "q9"]


def corpus(n, seed):
    rnd = random.Random(seed)
    words = ["parse", "Parser", "tree", "walk", "node", "create_user", "parseTree", "tree_walk", "Ärger", "日本", "x", "q9z", "partial"]
    for i in range(n):
        body = " ".join(rnd.choices(words, [20, 5, 9, 9, 30, 2, 3, 3, 1, 1, 40, 1, 5], k=rnd.randint(0, 40)))
        yield f"n{i:04d}", rnd.choice(["Class", "Method", None]), rnd.choice([*words, None, ""]), rnd.choice([body, body, None]), f"f{i % 17}.py"


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(corpus(700, 1))
    return spark.createDataFrame([*rows, *rows[:5], ("long", "Class", "deep", "tree " * 30_000 + "parse", "f0.py")], SCHEMA).cache()


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    return search_index.store_index(search_index.build_index(docs), str(tmp_path_factory.mktemp("index")))


def rows_of(frame):
    return sorted((r.node_id, round(r.score, 9)) for r in frame.collect())


@pytest.mark.parametrize("query", QUERIES)
def test_all_rows_and_scores(docs, stored, query):
    assert rows_of(search_index.search_index(stored, query, None)) == rows_of(search.bm25_search(docs, query, None))


def test_top_rows_and_kinds(docs, stored):
    for query, limit, kind in (("parse tree", 3, None), ("node", 10, "Class"), ("tree_walk", 5, "Method"), ("parse", 5000, "Class")):
        got, want = (frame.collect() for frame in (search_index.search_index(stored, query, limit, kind), search.bm25_search(docs, query, limit, kind)))
        assert [(r.node_id, round(r.score, 9)) for r in got] == [(r.node_id, round(r.score, 9)) for r in want]


def test_only_rows_of_the_query_are_read(stored):
    at = search_index._Search(stored, search.query_terms("parse tree"), None)
    plan = at.heads()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((part" in plan.replace("isnotnull(part", "((part") and "held" not in plan
    assert at.postings.select("part").distinct().count() <= 2


def test_blocks_below_the_result_stay_closed(spark, stored, monkeypatch):
    opened = []
    plain = search_index._Search.scored

    def scored(self, blocks, stats):
        opened.append(blocks.count())
        return plain(self, blocks, stats)

    monkeypatch.setattr(search_index._Search, "scored", scored)
    search_index.search_index(stored, "q9", 1).collect()
    assert opened[0] == 1 and opened[1] < stored.blocks.count()


def test_updates_by_file(spark, docs, stored, tmp_path):
    gone = spark.createDataFrame([("f3.py",), ("f4.py",), ("new.py",)], "file_path string")
    fresh = spark.createDataFrame([("fresh1", "Class", "parseTree", "walk the tree", "f3.py"), ("fresh2", "Class", "other", None, "new.py")], SCHEMA)
    index, postings = search_index.updated(stored, gone, fresh)
    assert postings.count() < stored.postings.count() / 10
    index = search_index.store_index(index, str(tmp_path))
    now = docs.join(gone, "file_path", "left_anti").select(docs.columns).unionByName(fresh)
    for query in ("parse", "tree_walk", "walk tree", "x"):
        assert rows_of(search_index.search_index(index, query, None)) == rows_of(search.bm25_search(now, query, None))
    left = search_index.SearchIndex(search_index.compacted(index), index.blocks)
    assert left.postings.count() <= index.postings.count()
    assert rows_of(search_index.search_index(left, "parse", None)) == rows_of(search.bm25_search(now, "parse", None))


def test_empty_index(spark, docs):
    index = search_index.build_index(docs.limit(0))
    assert index.blocks.count() == 0 and search_index.search_index(index, "parse").count() == 0
    index, _ = search_index.updated(index, docs.select("file_path").limit(0), docs.filter("node_id = 'n0001'"))
    assert search_index.next_generation(index) == 1
    assert docs.filter(F.col("node_id") == "n0001").count() == index.blocks.agg(F.sum("n")).first()[0]


def test_the_catalog_keeps_its_index_by_file(spark, tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    for name in ("alpha", "beta", "gamma"):
        (root / f"{name}.py").write_text(f"def {name}_handler(): ...\n\n\ndef shared_{name}(): ...\n")
    catalog = Catalog(spark, str(tmp_path / "store"))
    catalog.index(scan_files(spark, str(root)))

    def same(query):
        nodes = catalog.read("nodes")
        docs = nodes.select(F.col("qualified_name").alias("node_id"), "kind", "name", F.concat_ws(" ", "qualified_name", "signature", "docstring").alias("body"))
        found = rows_of(search_index.search_index(catalog.search_index(), query))
        assert found == rows_of(search.bm25_search(docs, query))
        return {node for node, _ in found}

    assert same("shared") == {f"{n}.py::shared_{n}" for n in ("alpha", "beta", "gamma")}
    first = catalog.folders("postings")
    (root / "beta.py").write_text("def shared_other(): ...\n")
    (root / "gamma.py").unlink()
    catalog.index(scan_files(spark, str(root)))
    assert same("shared") == {"alpha.py::shared_alpha", "beta.py::shared_other"} and same("beta_handler") == set()
    assert catalog.folders("postings")[:1] == first and len(catalog.folders("postings")) == 2
    catalog.remove(spark.createDataFrame([("beta.py",)], "file_path string"))
    assert same("shared") == {"alpha.py::shared_alpha"} and catalog.folders("postings")[:1] == first
