"""Sharding by longest processing time: groups of equal texts, largest first, each to the shard with the least bytes.

The rule is a heap of shards; what differs is where it runs. Groups that hold a ``heads``-th of all bytes or more are at
most ``heads``, and are dealt one by one on the driver. All smaller ones are put into buckets of about equal size (an
eighth of an octave wide, cut by a hash of the text into as many buckets as the class's share of the groups): a task deals
the groups of a bucket, sorted by size, to as many bins as there are shards, through a heap; then the driver deals the bins,
bucket by bucket from the largest sizes down, the fullest bin to the emptiest shard. Bins of a bucket differ by one of its
groups at most, and putting the fuller bin on the emptier shard never lets loads differ by more than either did before. So
once the groups dealt on the driver are even, the shards end within one group of the tail, less than a ``heads``-th of all.
The driver holds ``heads`` groups and the sums of (buckets + classes) * shards bins, whatever the table's size.

Rows of a shard are numbered by ranges of a hash; repeated rows are one row with a count until the end.

Defined results: a null text is an empty one, and both are one group; size is the UTF-8 bytes plus 1; a null doc_id is an
id like others; repeated rows have a slot each. A group of more bytes than a shard's share fills a shard by itself, the others stay
even. Extra columns are ignored, an empty table gives no rows. Reruns give the same shards and slots.
"""

from __future__ import annotations

import math
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, salted_join

SHARDS = 8
HEADS = 1 << 15
BUCKETS = 1 << 12
#: What names a text: 128 bits of hash, its size and its crc32.
TEXT = ["t1", "t2", "size", "text_crc32"]
CLASSES_AN_OCTAVE = 8
#: Copies of a row that one task makes at most.
COPIES = 4096


def lpt(weights: list[int], shards: int) -> list[int]:
    """The shard of each weight, given in descending order: always the one with the least so far."""
    loads = [(0, s) for s in range(shards)]
    out = []
    for w in weights:
        load, shard = loads[0]
        out.append(shard)
        heapreplace(loads, (load + w, shard))
    return out


def _groups(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(different rows with their number of copies, different texts with n, how many of those rows they have, and all their bytes)."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    once = materialise(rows.groupBy("doc_id", *TEXT).agg(F.count(F.lit(1)).alias("copies")), "shard-rows")
    groups = once.groupBy(*TEXT).agg(F.count(F.lit(1)).alias("n"), (F.sum("copies") * F.col("size")).alias("weight"))
    return once, materialise(groups, "shard-groups")


def _bins(tail: DataFrame, shards: int, buckets: int) -> DataFrame:
    """``tail`` with its class, bucket and bin."""
    tail = tail.withColumn("class", F.floor(F.log2("weight") * CLASSES_AN_OCTAVE).cast("int"))
    counts = {r[0]: r[1] for r in tail.groupBy("class").count().collect()}  # at most 64 octaves
    every = sum(counts.values())
    of: Column = F.lit(1)
    if counts:
        of = F.element_at(F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, max(1, math.ceil(buckets * n / every)))]), F.col("class"))
    tail = tail.withColumn("bucket", F.pmod(F.col("t2"), of.cast("long")).cast("int"))

    def packed(table: pa.Table) -> pa.Table:
        weight, t1, t2 = (table.column(c).to_numpy() for c in ("weight", "t1", "t2"))
        order = np.lexsort((t2, t1, -weight))
        bins = np.empty(len(order), np.int32)
        bins[order] = lpt(weight[order].tolist(), shards)
        return table.append_column("bin", pa.array(bins))

    kept = tail.select(*TEXT, "n", "weight", "class", "bucket")
    return kept.groupBy("class", "bucket").applyInArrow(packed, "t1 long, t2 long, size long, text_crc32 long, n long, weight long, class int, bucket int, bin int")


def assign(documents: DataFrame, shards: int = SHARDS, heads: int = HEADS, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(different rows with copies, TEXT with n and shard of each different text)."""
    spark = documents.sparkSession
    once, groups = _groups(documents)
    bound = F.lit(max(1, math.ceil((groups.agg(F.sum("weight")).first()[0] or 0) / heads)))
    large = sorted(groups.where(F.col("weight") >= bound).collect(), key=lambda r: (-r.weight, r.t1, r.t2))
    shard_of = lpt([r.weight for r in large], shards)
    loads = [0] * shards
    for r, s in zip(large, shard_of):
        loads[s] += r.weight
    bins = materialise(_bins(groups.where(F.col("weight") < bound), shards, buckets), "shard-bins")
    sums: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in bins.groupBy("class", "bucket", "bin").agg(F.sum("weight").alias("w")).collect():
        sums.setdefault((-r["class"], r.bucket), []).append((-r.w, r.bin))
    queue, where = [(load, s) for s, load in enumerate(loads)], []
    heapify(queue)
    for (c, bucket), of in sorted(sums.items()):
        least = [heappop(queue) for _ in of]
        for (w, b), (load, s) in zip(sorted(of), least):
            where.append((-c, bucket, b, s))
            heappush(queue, (load - w, s))
    where = spark.createDataFrame(where, "class int, bucket int, bin int, shard int")
    placed = bins.join(F.broadcast(where), ["class", "bucket", "bin"]).select(*TEXT, "n", "shard")
    first = spark.createDataFrame([(r.t1, r.t2, r.size, r.text_crc32, r.n, s) for r, s in zip(large, shard_of)], "t1 long, t2 long, size long, text_crc32 long, n long, shard int")
    return once, placed.unionByName(first)


def shard(documents: DataFrame, shards: int = SHARDS, ranges: int = 1024, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``documents``.

    ``ranges``: into how many ranges of a hash each shard is cut to be numbered; raise it with the table.
    """
    once, placed = assign(documents, shards, **options)
    rows = salted_join(once, placed, TEXT).drop("n").withColumn("part", F.pmod(F.xxhash64("doc_id", "t1"), F.lit(ranges)).cast("int"))
    rows = materialise(rows, "shard-placed")
    parts = rows.groupBy("shard", "part").agg(F.sum("copies").alias("rows"))
    starts = parts.select("shard", "part", (F.sum("rows").over(Window.partitionBy("shard").orderBy("part")) - F.col("rows")).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", *TEXT).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("till", F.sum("copies").over(within)).join(F.broadcast(starts), ["shard", "part"])  # shards * ranges rows
    rows = rows.withColumn("slot", F.col("start") + F.col("till") - F.col("copies"))
    few = rows.where(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    many = rows.where(F.col("copies") > COPIES).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))).repartition("doc_id", "t1", "from")
    many = many.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + COPIES, F.col("copies")) - 1))).drop("from")
    out = few.unionByName(many)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("copy")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
