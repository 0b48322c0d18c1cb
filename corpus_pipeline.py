"""A corpus pipeline: language ID, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tanglemap.llm import decontam, jaccard, langid, mixing, sharding
from tanglemap.llm.common import table
from tanglemap.scratch import Table

LANGUAGE_LENGTHS = (32, 64, 128)  # characters from which a score must reach what clean beginnings of that length reach
LANGUAGE_QUANTILE = 0.01
MIX_WEIGHTS = {"high": 0.9, "low": 0.1}
SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that resemble no learnt language. A document
    must score what all but ``LANGUAGE_QUANTILE`` of the learnt documents' beginnings do, cut to
    the largest of ``LANGUAGE_LENGTHS`` that it reaches; under the smallest of them noise and
    clean text score alike, so there a letter is enough."""
    known, prototypes = langid.fit(docs, F.lit(True))
    cuts = F.explode(F.array(*map(F.lit, LANGUAGE_LENGTHS))).alias("_cut")
    begun = docs.filter("text is not null and lang is not null").select("text", cuts).filter(F.length("text") >= F.col("_cut")).select("_cut", F.expr("substring(text, 1, _cut)").alias("text"))
    reached = langid.predict(begun, known, prototypes).groupBy("_cut").agg(F.percentile_approx("score", F.lit(LANGUAGE_QUANTILE), F.lit(10_000)).alias("least"))
    least = F.lit(0.0)
    for r in sorted(reached.collect()):
        least = F.when(F.length("text") >= r["_cut"], F.greatest(least, F.lit(r["least"]))).otherwise(least)
    out = langid.predict(docs, known, prototypes, keep=None)
    good = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)
    return out.filter(good).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a Jaccard similarity
    of 0.8 or more: the one of smallest id. Rows of equal id and text are one; a document
    with a null id stays."""
    found = jaccard.jaccard_components(docs, k=5, num=80, den=100)
    stays = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(stays, "doc_id", "left_semi").withColumn("_text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_hash"])
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a test item, or a whole shorter one."""
    out = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    return out.filter(F.size("hits") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that token shares approach ``MIX_WEIGHTS``; toxic text has
    no share, and no domain that has one loses tokens."""
    labels = mixing.quality_domains(table(spark, sf_dir, "labels"))
    out = mixing.mix(docs, labels, MIX_WEIGHTS)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return out.filter("copies > 0").select(*docs.columns, times.alias("_copy")).drop("_copy")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage keeps is stored once and read by the
    next, so no stage runs again for a later one."""
    docs = table(spark, sf_dir, "documents")
    stored = None
    for name, stage in STAGES[:-1]:
        following = Table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if stored is not None:
            stored.drop()
        stored, docs = following, following.read()
    return STAGES[-1][1](spark, docs, sf_dir)
