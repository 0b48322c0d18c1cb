"""Views hand all rows of their tables to the queries."""

import datetime

from tanglemap.plans.registry import QUERIES


def test_cycle_that_a_late_event_closes(spark, tmp_path):
    types = [*"abcdefg", "a"]
    rows = [(i, datetime.datetime(2024, 1, 1, 0, i), 17, t) for i, t in enumerate(types)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    nodes = [f"17/{t}" for t in "abcdefg"]
    assert [r["members"] for r in QUERIES["scc_cycles"](spark, str(tmp_path)).collect()] == [nodes]
    assert [r["members"] for r in QUERIES["baseline_new_cycles"](spark, str(tmp_path)).collect()] == [nodes]
    assert QUERIES["induced_edges"](spark, str(tmp_path)).count() == 7
    assert QUERIES["cycle_pivots"](spark, str(tmp_path)).count() == 1
