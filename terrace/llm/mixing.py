"""Mixing sources to target weights, with DataFrame functions alone.

Every document gets a hash-random key. The key's leading bits cut each source
into equal ranges of key space (the range sort's partitions: uniform whatever
the source's share of the rows, the same on every run, and no sampling pass),
a window sums the sizes inside a range, and a small table of range totals gives
each range its start, so no task ever holds a whole source. A source is cut at
its exact budget: whole epochs first, then the keys in order up to the budget.

Defined results: a null text has size 0; a null source is a source of its own,
last in the order of weights; repeated rows count each time; a source without
words has target 0; the target is cut down to whole words. Documents of size 0
are never taken. Rows without an id get their key from their text. Extra columns are ignored by ``mix`` and kept by
``mixed_documents``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: weights repeat in the order of names.

    Closed form of the repeated resharing: with sources ordered by the level at
    which they fill up (most * size / weight), the first j are full and the rest
    share what is left in proportion, for the least j at which that fits.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    s = s.withColumn("total", F.sum("source_size").over(every) * share)
    s = s.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # the first source that isn't full sets the level of the water for itself and all after it
    level = F.col("rest") / F.col("open")
    s = s.withColumn("water", F.max(F.when(level <= F.col("level"), level)).over(every))
    target = F.least(F.col("cap"), F.coalesce(F.col("water"), F.col("level")) * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def mix(documents: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST_EPOCHS, ranges: int = 1024, seed: str = "mix-1") -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) of every row.

    ``ranges``: into how many ranges of key space each source is cut, a power of
    16; raise it with the table (4096 keeps a range of 3e9 documents below 1e6 rows).
    """
    return _cut(_sized(documents, ranges, seed), weights, share, most)


def _sized(documents: DataFrame, ranges: int, seed: str, *carried: Column) -> DataFrame:
    digits = max(1, (ranges.bit_length() + 2) // 4)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    key = F.md5(F.concat_ws("|", F.lit(seed), name).cast("binary"))
    return documents.select("doc_id", "source", size.alias("size"), key.alias("mix_key"), *carried).withColumn("part", F.substring("mix_key", 1, digits))


def _cut(sized: DataFrame, weights, share, most) -> DataFrame:
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part")
    parts = parts.withColumn("part_start", F.sum("part_size").over(earlier) - F.col("part_size"))
    sources = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, most)
    # null sources meet too: the pair below never equals that of a named source
    name = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key")]
    sources = sources.select(*name, "source_size", "target")
    starts = parts.select(*name, "part", "part_start").join(sources, ["no_source", "source_key"])
    on = ["no_source", "source_key", "part"]
    rows = sized.select("*", *name).join(starts, on)
    within = Window.partitionBy(*on).orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.col("part_start") + F.sum("size").over(within) - F.col("size"))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    over = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("start")))
    return rows.select(*[c for c in sized.columns if c != "part"], "source_size", "target", (epochs * F.col("size") + over).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST_EPOCHS, ranges: int = 1024, seed: str = "mix-1") -> DataFrame:
    """The rows of ``documents`` as often as the mix takes them: once for each whole epoch, and
    once more where at least half of the document lies within the budget; texts stay whole.

    The rows themselves go through the cut, so null and repeated ids are rows like others, and each source ends within
    half a document of its target. Their columns travel as one, so that their names can't meet those used here.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("carried")
    rows = _cut(_sized(documents, ranges, seed, carried), weights, share, most).where("size > 0")
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    out = rows.select("carried", copies.alias("copies")).where("copies > 0").select("carried", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select(*[F.col("carried")[c].alias(c) for c in documents.columns])
