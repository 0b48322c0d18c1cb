"""Every library query with an oracle gives what DuckDB gives, and the same on more partitions."""

import os
import time

import duckdb
import pytest
from tanglemap.operators import coverage
from tanglemap.plans import adapters
from tanglemap.plans.adapters import TABLES, view
from tanglemap.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    told = duck.execute(ORACLES[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(frame.columns)
    at = [names.index(c) for c in frame.columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in told.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in frame.collect()) == want


@pytest.mark.parametrize("name", ["churn", "bus_factor", "god_modules", "temporal_coupling", "scc_cycles"])
def test_partition_count_does_not_matter(spark, name):
    few = sorted(map(repr, QUERIES[name](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert sorted(map(repr, QUERIES[name](spark, SF).collect())) == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_cover_edges_keep_a_part_of_the_joins_on_disk(spark, monkeypatch):
    """Against the view as one query, whose shuffle files all lie on disk until it ends."""
    sf, dirs = "/root/testdata/sf0.01", list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def size():
        return sum(os.lstat(f"{d}/{n}").st_size for top in dirs for d, _, names in os.walk(top) for n in names if n.startswith("shuffle_"))

    def made(frame, most):
        """Rows, and bytes of shuffle files that are left of them; files go in the background."""
        before, rows = start, sorted(map(tuple, frame.collect()))
        for _ in range(20):
            if size() - before > most:
                time.sleep(0.25)
        return rows, size() - before

    start = size()
    plain, whole = made(coverage.derive_covers(view(spark, sf, "test_calls"), view(spark, sf, "symbols")), 1 << 40)
    monkeypatch.setattr(adapters, "PART_ROWS", 20_000)
    start = size()
    rows, left = made(QUERIES["cover_edges"](spark, sf), whole // 2)
    assert rows == plain and len(rows) == 21_656
    assert left < whole / 2
