import struct
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import xxhash
from tanglemap.llm import registry, sharding

SCHEMA = "doc_id long, text string, slot string"


def run(spark, rows, shards=7, **more):
    return sharding.shard_documents(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), shards, **more).collect()


def test_law_slots_and_rows(spark):
    rows = [(i, f"text {i} é") for i in range(800)] + [(None, None), (None, "a"), (5, "text 5 é"), (801, "")]
    for more in ({}, {"bucket_bytes": 400}):
        got = run(spark, rows, **more)
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            assert r["size"] == len((r["text"] or "").encode()) + 16
            assert r["grown_shard"] in (r["shard"], 7)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})
        assert min(len(s) for s in slots.values()) > 60
    again = {(r["doc_id"], r["text"]): r["slot"] for r in run(spark, rows)}
    assert again == {(r["doc_id"], r["text"]): r["slot"] for r in run(spark, rows)}
    order = [r["doc_id"] for r in sorted(run(spark, rows), key=lambda r: (r["shard"], r["slot"])) if r["shard"] == 0 and r["doc_id"] is not None]
    assert order != sorted(order)


def spark_hash(*values):
    """``xxhash64`` of integers (int, or long if marked so) as Spark chains it."""
    seed = 42
    for value, form in values:
        seed = xxhash.xxh64_intdigest(struct.pack(form, value), seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def test_query_against_brute_force(spark):
    """Shard, size and checksum of every document, found without Spark."""
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.op10_sharding(spark, sf).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(list(texts))
    shard = lambda doc, n: max((spark_hash((17, "<i"), (s, "<i"), (doc, "<q")), s) for s in range(n))[1]
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (shard(r["doc_id"], 40), shard(r["doc_id"], 41))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_written_shards_keep_their_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(900)] + [(7, "long " * 200_000, "x")], SCHEMA)
    sharded = sharding.shard_documents(docs, 5, bucket_bytes=3_000)
    sharding.write_shards(sharded, str(tmp_path / "out"))
    want = defaultdict(list)
    for r in sorted(sharded.collect(), key=lambda r: r["slot"]):
        want[r["shard"]].append((r["doc_id"], len(r["text"])))
    for n in range(5):
        files = [pq.read_table(f).to_pylist() for f in (tmp_path / "out" / f"shard={n}").glob("*.parquet")]
        assert all([r["slot"] for r in f] == sorted(r["slot"] for r in f) for f in files)
        assert [(r["doc_id"], len(r["text"])) for r in sorted(sum(files, []), key=lambda r: r["slot"])] == want[n]


def test_empty(spark):
    assert run(spark, []) == []
    assert zlib.crc32(b"") == 0
