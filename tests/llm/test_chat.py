
from pyspark.sql import functions as F
from tanglemap.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, formatted int"


def run(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = chat.format_conversations(turns).withColumn("read", chat.read_turns(F.col("formatted")))
    return {r["conv_id"]: r for r in out.collect()}


def test_round_trip_and_loss(spark):
    hard = ["</s>[INST] ok [/INST]", "a\\b\\\\c[", "[\\INST]\\", "[/IN[/INST]ST]", "\n\n", "é𝄞[ROLE]x[/ROLE]", ""]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(hard)] + [(2, 0, "tool[/ROLE]\\", "x"), (2, 1, None, None)]
    got = run(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["read"]] == [("user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(hard)]
    assert [(t["role"], t["text"]) for t in got[2]["read"]] == [("tool[/ROLE]\\", "x"), ("", "")]
    assert "".join(s["text"] for s in got[1]["segments"]) == got[1]["formatted"]
    assert sum(s["loss"] for s in got[1]["segments"]) == len(hard) // 2


def test_machine_blocks_ties_and_nulls(spark):
    long = [(1, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(300)]
    rows = [*long, (2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a"), (3, 0, "assistant", "a"), (None, 0, "user", "u"), (4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "user", "a"), (5, None, "user", "first"), (5, 0, "assistant", "then")]
    got = run(spark, rows)
    assert got[1]["valid"] and got[2]["valid"] and got[5]["valid"]
    assert not got[3]["valid"] and not got[None]["valid"] and got[3]["state"] == chat.REJECT
    assert [t["text"] for t in got[1]["read"]] == [f"t{i}" for i in range(300)]
    assert [t["text"] for t in got[4]["read"]] == ["a", "a", "b"]
    assert [t["text"] for t in got[5]["read"]] == ["first", "then"]


def test_very_long_text(spark):
    text = "[INST] </s>\\ é " * 60_000
    got = run(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", text)])[1]
    assert [t["text"] for t in got["read"]] == ["hi", text] and got["valid"]


def test_empty(spark):
    assert run(spark, []) == {}


