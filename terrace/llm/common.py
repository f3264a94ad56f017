"""Input tables, word patterns, folds and bounded training samples."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import materialise, new_path, session_dir, shared_dir  # noqa: F401

#: One white-space byte, as the word patterns of all operators see it.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the fixed folds; null ids are in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % mod, F.lit(0))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Within it, Arrow batches have ``rows`` rows at most: with long texts the default of 10,000 makes batches of 100 MB,
    held by the JVM and by the Python worker of every running task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it what no column of ``df`` is called, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash() -> Column:
    """A hash of doc_id and text; equal for copies of a row alone."""
    return F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("text"))


def bounded_sample(df: DataFrame, label: str, rows: int, balance: float = 0.5, key: Column | None = None) -> DataFrame:
    """About ``rows`` different rows of ``df`` with a non-null ``label``, chosen by the hash ``key``, which is added as ``sample_key``.

    The bound is split over the label values: an equal share each, mixed with a
    proportional share by ``balance`` (1: equal). One small aggregate, then a
    filter that each task applies alone; the same rows on every run. Copies of a
    row share a key and are one row of the sample, so however often an id or a
    row is repeated, the sample is a binomial draw of ``rows`` keys at most.
    """
    counts = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    total, scale = sum(counts.values()), 1 << 30
    df = df.withColumn("sample_key", row_hash() if key is None else key)
    if not counts:
        return df.where(F.lit(False))
    unit = F.shiftrightunsigned("sample_key", 34)
    keep = F.lit(False)
    for value, n in counts.items():
        share = rows * (balance / len(counts) + (1 - balance) * n / total)
        keep = F.when(F.col(label) == F.lit(value), unit < F.lit(min(scale, int(scale * share / n)))).otherwise(keep)
    return df.where(F.col(label).isNotNull() & keep).dropDuplicates([label, "sample_key"])


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, balance: float = 0.5) -> DataFrame:
    """doc_id, text, ``label`` and sample_key of about ``rows`` different labelled documents at most.

    The ids are sampled first, so what is broadcast is bounded by ``rows``; then
    the documents are, as an id may have any number of them.
    """
    ids = bounded_sample(labels.select("doc_id", label), label, rows, balance, F.xxhash64(F.lit("sample"), F.col("doc_id"))).drop("sample_key")
    return bounded_sample(documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), label, rows, balance)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], outer: bool = False, parts: int = 512, salts: int = 64) -> DataFrame:
    """``big`` joined with ``small``, which has each key once and in ``n`` how many rows of ``big`` have it.

    A key with more than a ``parts``-th of the rows is hot. There are fewer than ``parts`` of those, so they are
    broadcast, and their rows are dealt over ``salts`` tasks each. With ``outer`` rows without a partner stay.
    """
    most = F.lit(max(1000, big.count() // parts))
    hot = small.where(F.col("n") > most).select(*keys, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.monotonically_increasing_id() % salts).otherwise(F.lit(0).cast("long"))
    left = big.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__hot")
    of = F.when(F.col("n") > most, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = small.select("*", F.explode(of).alias("__salt"))
    return left.join(right, [*keys, "__salt"], "left" if outer else "inner").drop("__salt")
