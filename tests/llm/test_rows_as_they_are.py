"""Groups, mixes and kept rows don't depend on how rows came, on their ids or on what their other columns are called."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from terrace.llm import exact_dedup, language_id, mixing, near_dedup

random.seed(11)
_WORDS = ["".join(random.choice("etaoinshr") for _ in range(6)) for _ in range(700)]


@pytest.mark.parametrize("how", ["scan", "repartition", "join", "limit"])
def test_long_texts_are_grouped_however_they_come(spark, tmp_path, how):
    """Twenty pairs and one large group of texts above a chunk, some without an id, behind a scan, a shuffle, a join and a limit."""
    text = lambda k: f"{k} " + "word " * 15000 + str(k)
    rows = [(i if i % 7 else None, text(i // 2)) for i in range(40)] + [(100 + i, text("many")) for i in range(30)] + [(200, "short"), (201, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    df = {"scan": lambda: df, "repartition": lambda: df.repartition(4), "join": lambda: df.join(spark.range(300).withColumnRenamed("id", "x"), F.coalesce("doc_id", F.lit(0)) == F.col("x")).drop("x"), "limit": lambda: df.limit(72)}[how]()
    got = exact_dedup.exact_dedup(df).collect()
    sizes = Counter(t for _, t in rows)
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in sizes}
    assert Counter(r.text_sha256 for r in got) == {sha[t]: n for t, n in sizes.items()}
    groups = defaultdict(list)
    for r in got:
        groups[r.text_sha256].append(r)
    for t, n in sizes.items():
        of = groups[sha[t]]
        ids = [i for i, x in rows if x == t and i is not None]
        assert {r.group_size for r in of} == {n} and sum(r.kept for r in of) == 1 and {r.keep_id for r in of} == {min(ids) if ids else None}


@pytest.mark.parametrize("ids", ["null", "repeated", "own"])
def test_the_mix_meets_its_targets_whatever_the_ids(spark, ids):
    rows = [({"null": None, "repeated": i % 5, "own": i}[ids], f"w{i} " * 10, "abc"[i % 3], i, "x", 3) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken string, `mix_key` int")
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    words = {r.source: r.n for r in got.groupBy("source").agg((F.count(F.lit(1)) * 10).alias("n")).collect()}
    assert words == {"a": 1000, "b": 2000, "c": 3000}
    assert {(r["size"], r.taken, r.mix_key) for r in got.collect()} <= {(i, "x", 3) for i in range(600)}


def test_columns_of_any_name_come_through_every_stage(spark, tmp_path):
    base = " ".join(random.sample(_WORDS, 90))
    names = ["__id", "__t1", "__t2", "__no_id", "__n", "__nth", "__in", "__size_key", "__letter", "letter", "predicted", "sure", "runs", "lines", "__runs", "__units", "carried", "copies", "copy", "a.b", "__salt", "part"]
    texts = [base, base + " tail", *[" ".join(random.sample(_WORDS, 90)) for _ in range(12)], None, ""]
    rows = [(i if i % 4 else None, t, "en" if i % 2 else "fr", "s", 1, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    kept = docs.select(*[f"`{n}`" for n in names]).collect()
    assert kept
    for r in kept:
        assert len({v.removeprefix(n) for n, v in zip(names, r)}) == 1


def test_kept_rows_and_labels_with_names_in_use(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 7, True), (None, "one two three four five six", 8, False), (3, None, 9, None)], "doc_id long, text string, __id int, __letter boolean")
    assert sorted(near_dedup.near_dedup(docs).select("__id", "__letter").collect(), key=str) == sorted([r for r in docs.select("__id", "__letter").collect() if r[0] != 8], key=str)
    out = language_id.annotate(docs.withColumn("lang", F.lit("en")))
    assert sorted(r["__letter"] is None for r in out.collect()) == [False, False, True]
