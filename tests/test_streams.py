"""Slices kept from a stream: replays, late rows, break-offs; layers from candidates and priors."""

import pytest
from pyspark.sql import functions as F

from terrace.operators import layers
from terrace.streaming.slices import SliceStream

SCHEMA = "day date, k string, n long, top int"


def _partial(rows):
    return rows.groupBy("day", "k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))


def _merge(rows):
    return rows.groupBy("day", "k").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def _rows(spark, *rows):
    return spark.createDataFrame(rows, "day string, k string, v int").withColumn("day", F.to_date("day"))


def _state(frame):
    return sorted((str(r.day), str(r.k), r.n, r.top) for r in frame.collect())


def test_replayed_and_late_batches_equal_one_run(spark, tmp_path):
    batches = [_rows(spark, ("2024-01-01", "a", 1), ("2024-01-01", "a", 5), (None, "a", 2)), _rows(spark, ("2024-02-01", "0042", 1), (None, "a", None)), _rows(spark), _rows(spark, ("2024-01-01", "a", 9), ("2024-01-30", "b", None), (None, None, 3))]
    of = SliceStream(str(tmp_path / "t"), SCHEMA, "day", _partial, _merge)
    assert of.read(spark).count() == 0
    for i, rows in enumerate(batches):
        for _ in range(1 + i % 2):
            of.take(rows, i)
    of.take(batches[3], 3)
    whole = batches[0].unionByName(batches[1]).unionByName(batches[3])
    assert _state(of.read(spark)) == _state(_partial(whole)) and ("2024-02-01", "0042", 1, 1) in _state(of.read(spark))
    assert [(str(r.day), r.batch, str(r.latest)) for r in of.reopened(spark, 7).collect()] == [("2024-01-01", 3, "2024-02-01")]


@pytest.mark.parametrize("step", ["partial", "merge"])
def test_a_stream_broken_off_goes_on(spark, tmp_path, step):
    landing, broken = str(tmp_path / "in"), []

    def once(rows):
        if step == "merge" and not broken:
            broken.append(1)
            raise RuntimeError("lost")
        return _merge(rows)

    def first(rows):
        if step == "partial" and not broken:
            broken.append(1)
            raise RuntimeError("lost")
        return _partial(rows)

    of = SliceStream(str(tmp_path / "t"), SCHEMA, "day", first, once)
    a, b = _rows(spark, ("2024-01-01", "a", 1), ("2024-01-02", "a", 2)), _rows(spark, ("2024-01-01", "a", 7))
    a.write.parquet(landing)
    start = lambda: of.start(spark.readStream.schema(a.schema).parquet(landing))
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    b.write.mode("append").parquet(landing)
    for _ in range(2):
        start().awaitTermination()
    assert _state(of.read(spark)) == _state(_partial(a.unionByName(b)))


def test_layers_of_candidates(spark):
    kind = "name string, declared_layer string, declared_type string, fallback_layer string, fallback_type string, fixed_layer string, candidate struct<layer:string,table_type:string,confidence:double>, source string"
    rows = [
        ("low", "DWD", "fact", None, None, None, ("DIM", "dimension", 0.01), "z"), ("edge", "DWD", "fact", None, None, None, ("dws", "", 0.5), "z"), ("dimension", "DWD", "fact", None, None, None, ("DWD", "Dimension", 0.9), "z"),
        ("fixed", None, None, "ODS", "other", "ods", ("DIM", "dimension", 0.9), "z"), ("none", None, None, None, None, None, None, "z"), ("outside", "ADS", "fact", None, None, None, None, "z"),
        ("nan", "DWD", "fact", None, None, None, ("DWS", "fact", float("nan")), "z"), ("above", "DWD", "fact", None, None, None, ("DWS", "fact", 1.5), "z"), ("nulls", "DWD", "fact", None, None, None, (None, None, None), "z"),
    ]
    got = {r.name: (r.inferred_layer, r.applied_layer, r.table_type, r.source, r.strength, tuple(r.warnings)) for r in layers.resolve(spark.createDataFrame(rows, kind)).collect()}
    unusable = ("candidate_unusable",)
    assert got == {
        "low": ("DIM", "DWD", "fact", "declared", "strong", unusable), "edge": ("DWS", "DWS", "fact", "candidate", "strong", ()), "dimension": ("DWD", "DIM", "dimension", "candidate", "strong", ()),
        "fixed": ("DIM", "ODS", "other", "fixed_boundary", "fixed", ()), "none": ("OTHER", "OTHER", "other", "declared", "strong", ()), "outside": ("ADS", "ADS", "fact", "declared", "strong", ("outside_candidates",)),
        "nan": ("DWS", "DWD", "fact", "declared", "strong", unusable), "above": ("DWS", "DWD", "fact", "declared", "strong", unusable), "nulls": ("OTHER", "DWD", "fact", "declared", "strong", unusable),
    }
    assert layers.resolve(spark.createDataFrame([], kind)).count() == 0
