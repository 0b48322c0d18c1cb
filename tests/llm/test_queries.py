"""Every numbered query, and its SQL where there is one, over a whole small table."""

import duckdb
import pytest
from tanglemap.llm.registry import ORACLES, QUERIES
from tanglemap.plans.adapters import TABLES

SF = "/root/testdata/sf0.001"
KEYS = {"op1_chat_format": ("conversations", "conv_id"), "op3_secret_scan": ("documents", "doc_id"), "op8_html_text": ("pages", "page_id")}


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, SF)
    rows = frame.collect()
    if name == "op4_nearest_neighbours":
        vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
        assert len(rows) == 10 * vectors.filter("vec_id % 100 = 0").count()
        return
    table, key = KEYS.get(name, ("documents", "doc_id"))
    if name != "op11_spelling_variants":  # which has a row a word
        ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
        assert {r[key] for r in rows} == ids | ({-1} if name == "op1_chat_format" else set())
    if name in ORACLES:
        duck = duckdb.connect()
        for t in TABLES:
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        told = duck.execute(ORACLES[name])
        names = [c[0] for c in told.description]
        assert sorted(names) == sorted(frame.columns)
        at = [names.index(c) for c in frame.columns]
        assert sorted(repr(tuple(map(plain, r))) for r in rows) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in told.fetchall())
