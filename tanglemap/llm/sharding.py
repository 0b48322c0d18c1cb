"""Two-pass external shuffle into shards, in DataFrame operations alone.

Pass one scatters records into memory-sized buckets by seeded hashes; pass two
permutes each bucket (Fisher-Yates, the ``shuffle`` function) and numbers its
records, so that a shard is its buckets one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from tanglemap.llm.common import hashable, packed, unpacked
from tanglemap.scratch import cut

ROW_OVERHEAD = 16  # bytes counted for a record besides its text
BUCKET_BYTES = 32 << 20  # a bucket is held by one task while it is permuted
FINE = 65_536  # finest split of a shard into buckets


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """Shard with the highest seeded hash of (key, shard). With one more shard, a key
    stays or moves to the new one."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_max(F.array(*scores))["s"]


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes the rows of :func:`shard_documents` below ``path``: a folder ``shard=N`` for each
    shard, in it files of whole buckets, whose records are in the order of their slots. A task
    writes the buckets that it permuted, so nothing moves again."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Adds ``size`` (UTF-8 bytes of the text, 16 more), ``shard``, ``slot`` (position in
    the shard, gapless from 0) and ``grown_shard`` (the shard with one shard more).

    The id and the number of shards decide the shard. A null text counts no bytes; a null
    id is a key like any other. Repeated rows keep a slot each. Rows of one bucket are put
    in a fixed order (id, hash of the row) before they are permuted, so a task that runs
    again gives the same slots. Rows that share one id stay in one shard but spread over
    its buckets by the hash of the whole row. An empty table gives an empty table.
    """
    names = docs.columns
    row_hash = F.xxhash64(F.lit(seed + 1), *hashable(docs))
    rows = packed(
        docs,
        _id=F.col(id_col),
        _size=F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_OVERHEAD,
        _shard=rendezvous(F.col(id_col), shards, seed),
        _hash=row_hash,
    ).withColumn("_fine", F.pmod("_hash", F.lit(FINE)).cast("int"))

    fine = cut(rows.groupBy("_shard", "_fine").agg(F.count("*").alias("n"), F.sum("_size").alias("bytes")))
    total = fine.agg(F.sum("bytes")).first()[0] or 0
    per_shard = 1
    while per_shard < FINE and total > bucket_bytes * shards * per_shard:
        per_shard *= 2
    part = F.floor(F.col("_fine") / F.lit(FINE // per_shard)).cast("int")
    bucket = (F.col("_shard") * per_shard + part).cast("int")
    order = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fine.groupBy("_shard", bucket.alias("_bucket"))
        .agg(F.sum("n").alias("n"))
        .select("_bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_offset"))
    )

    scattered = rows.withColumn("_bucket", bucket).repartitionById(shards * per_shard, F.col("_bucket"))
    permuted = (
        scattered.sortWithinPartitions("_bucket", "_id", "_hash")
        .groupBy("_bucket")
        .agg(F.shuffle(F.collect_list(F.struct("_row", "_id", "_size", "_shard")), seed).alias("_rows"))
        .join(offsets, "_bucket")
        .select("_offset", F.posexplode("_rows").alias("_pos", "_rec"))
        .select("_offset", "_pos", "_rec.*")
    )
    return permuted.select(
        *unpacked(
            permuted,
            names,
            size=F.col("_size"),
            shard=F.col("_shard"),
            slot=F.col("_offset") + F.col("_pos"),
            grown_shard=rendezvous(F.col("_id"), shards + 1, seed),
        )
    )
