import base64
import random
import re

import corpus_pipeline
from pyspark.sql import functions as F
from tanglemap.llm import jaccard, langid


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10_000, "123 ...", "en", "s", 7), (10_001, None, "en", "s", 0)], docs.schema)
    at = docs.unionByName(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, sf).write.parquet(str(tmp_path / name))
        before, at = at, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, at)
        if name != "shard":
            assert at.columns == docs.columns
    before, after = seen["language"]
    assert {r[0] for r in before.select("doc_id").subtract(after.select("doc_id")).collect()} == {10_000, 10_001}
    before, after = seen["near_duplicates"]
    left = jaccard.jaccard_components(before, k=5, num=80, den=100)
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in left.select("component_id").distinct().collect()}
    before, after = seen["mix"]
    assert after.join(before, "doc_id", "left_anti").count() == 0
    before, after = seen["shard"]
    assert after.count() == before.count() and after.select(F.max("shard")).first()[0] < 40
    assert langid.UNKNOWN == "und"


def test_language_drops_what_resembles_no_learnt_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = random.Random(4)

    def letters(alphabet, size):
        return " ".join("".join(draw.choices(alphabet, k=draw.randint(2, 9))) for _ in range(size // 6))[:size]

    junk = []
    for size in (200, 1_000, 5_000):
        for _ in range(10):
            junk += [letters("abcdefghijklmnopqrstuvwxyz", size), letters("абвгдежзийклмнопрстуфхцчшщъыьэюя", size), base64.b64encode(draw.randbytes(size)).decode()]
    extra = spark.createDataFrame([(1_000_000 + i, t, None, "s", len(t)) for i, t in enumerate(junk)], docs.schema)
    left = {r[0] for r in corpus_pipeline.language(spark, docs.unionByName(extra), "").select("doc_id").collect()}
    assert sum(i >= 1_000_000 for i in left) <= 0.02 * len(junk)
    assert sum(i < 1_000_000 for i in left) >= 0.985 * docs.count()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, _row string, shard string, TEXT_hash int"


def clean_texts(n):
    rng = random.Random(9)
    words = "the of and to in is that for it as was with be by on not he his are this from at which but have an had they you were".split()
    return [" ".join(rng.choice(words) for _ in range(60)) + f" number{i} ends here" for i in range(n)]


def small_tables(spark, tmp_path):
    spark.createDataFrame([(7, "a passage that the benchmark holds and that must never be trained on at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, i % 2, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))


def test_nulls_repeated_rows_and_clashing_columns(spark, tmp_path):
    small_tables(spark, tmp_path)
    texts = clean_texts(40)
    rows = [(i, t, "en", "s", len(t), "r", "s", 1) for i, t in enumerate(texts)]
    rows += [(None, texts[0] + " more", "en", None, None, None, None, None), (50, None, None, None, None, "r", "s", 1), (51, "", "en", "s", 0, "r", "s", 1)]
    rows += [rows[3], rows[3], (60, texts[5] + " so it is a passage that the benchmark holds and that must never be trained on at all", "en", "s", 1, "r", "s", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r["doc_id"] for r in at.select("doc_id").collect()]
        if name != "shard":
            assert at.columns == docs.columns
    assert 50 not in kept["language"] and 51 not in kept["language"] and kept["language"].count(3) == 3 and None in kept["language"]
    assert kept["near_duplicates"].count(3) == 1 and None in kept["near_duplicates"]
    assert 60 not in kept["decontaminate"] and set(range(40)) <= set(kept["decontaminate"])
    assert set(range(40)) <= set(kept["mix"]) and len(kept["shard"]) == len(kept["mix"])


def test_empty_tables(spark, tmp_path):
    small_tables(spark, tmp_path)
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_one_large_group_of_near_copies_leaves_one_document(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([f"only{i}", *words[:-1], f"last{i}"]), "en", "s", 1) for i in range(400)] + [(1_000, " ".join(words[::-1]), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 1_000]


def test_run_against_plain_python(spark, tmp_path):
    """The stages that decide by rules, on real rows: near duplicates and passages by brute force."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    group = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and group[i] != group[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {d: low if g == high else g for d, g in group.items()}
    stay = {i for i in texts if group[i] == i}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == stay
    word = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = word(r["text"] or "")
        n = min(10, len(w))
        windows |= {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    clean = {i for i, t in texts.items() if not any(tuple(word(t)[j : j + n]) in windows for n in sizes for j in range(len(word(t)) - n + 1))}
    assert {r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, sf).collect()} == clean
