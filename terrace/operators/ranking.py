"""Exact positions and tiles of a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``df`` with each row's place, from 1, in ascending ``order`` (nulls first).

    One range shuffle: the rows are sorted inside each range and written, and a
    range starts after the rows of those before it. Rows with equal ``order`` are in
    one range, so end it with a unique column where one value is frequent.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = materialise(ranged, "positions").withColumn("__range", F.shiftright("__id", 33))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, place).drop("__id", "__range", "__before")


def tile(position: Column, rows: int, tiles: int) -> Column:
    """The tile of a position from 1: the first ``rows % tiles`` tiles have one row more than the others."""
    small, wide = divmod(rows, tiles)
    edge = wide * (small + 1)
    above = F.floor((position - 1) / (small + 1)) + 1
    return (F.when(position <= edge, above).otherwise(wide + F.floor((position - edge - 1) / max(small, 1)) + 1)).cast("int")


def ntile_of(df: DataFrame, tiles: int, scores: dict[str, str], key: str) -> DataFrame:
    """``df`` with ntile(tiles) over (value, key) in a column for each of ``scores`` (name: value); null values come first.

    ``key`` is unique, so a value that most rows share is spread over the ranges. Each score is one range shuffle of rows
    that were written before, whatever it took to make ``df``.
    """
    rows = None
    for name, value in scores.items():
        df = with_position(df, [value, key], "__place")
        rows = df.count() if rows is None else rows
        df = df.withColumn(name, tile(F.col("__place"), rows, tiles)).drop("__place")
    return df
