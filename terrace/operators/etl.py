"""Layered-warehouse ETL: versions, slices, several writers, ranking, growth and shares as DataFrame functions.

None of these collects rows; each says which shuffle it costs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import materialise


def latest_version(df: DataFrame, keys: list[str], version: list[str], until: Column | None = None) -> DataFrame:
    """The last row of each key by the ``version`` columns (make the last one unique), of rows where ``until`` holds.

    max_by over a struct combines before the one shuffle on the keys, so a key with
    very many versions doesn't meet in one task as it would under a window.
    """
    rows = df if until is None else df.where(until)
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__last"))
    return last.select(*keys, *[F.col("__last")[c].alias(c) for c in rest]).select(*df.columns)


def top_ranked(df: DataFrame, by: list[str], order: list[Column], most: int, name: str = "rank_num") -> DataFrame:
    """Rows of rank ``most`` or better within ``by``, ties kept; Catalyst cuts each task's groups first."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)


def overwrite_slices(df: DataFrame, path: str, date_col: str) -> None:
    """Replaces just the date slices that ``df`` has rows of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)


def merge_owned(target: DataFrame, fresh: DataFrame, owned: Column) -> DataFrame:
    """The target after one of its writers replaced the rows that it owns."""
    return target.where(~F.coalesce(owned, F.lit(False))).unionByName(fresh.where(owned))


def with_share(df: DataFrame, value: str, name: str = "share_pct", digits: int = 2) -> DataFrame:
    """Each row's share of the total; the total is one row, added by a join that broadcasts just that."""
    total = df.agg(F.sum(value).alias("__total"))
    return df.join(F.broadcast(total)).withColumn(name, F.round(F.col(value) * 100.0 / F.nullif(F.col("__total"), F.lit(0)), digits)).drop("__total")


def with_growth(df: DataFrame, order: str, value: str, name: str, digits: int = 2) -> DataFrame:
    """Percent growth over the previous row of an aggregate that has one row a period; null without one."""
    before = F.lag(value).over(Window.orderBy(order))
    return df.withColumn(name, F.round((F.col(value) - before) * 100.0 / F.nullif(before, F.lit(0)), digits))


def append_aligned(df: DataFrame, path: str, schema: StructType | str | None = None) -> None:
    """Appends ``df`` under the target's columns, matched by name whatever the order or case, in the target's types; those it
    lacks are null, and a column that the target lacks is an error.

    ``schema``: the target's, needed for the first rows; later it is read from the table, and another one is an error.
    """
    spark = df.sparkSession
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    kept = spark.read.parquet(path).schema if file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file) else None
    if schema is None and kept is None:
        raise ValueError(f"{path} has no rows yet: say its schema")
    given = spark.createDataFrame([], schema).schema if schema is not None else kept
    if kept is not None and [(f.name, f.dataType) for f in given] != [(f.name, f.dataType) for f in kept]:
        raise ValueError(f"the table is {kept.simpleString()}, not {given.simpleString()}")
    have = {c.lower(): c for c in df.columns}
    unknown = sorted(set(have) - {f.name.lower() for f in given})
    if unknown:
        raise ValueError(f"no target columns: {unknown}")
    of = lambda f: F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)
    df.select(*[of(f).cast(f.dataType).alias(f.name) for f in given]).write.mode("append").parquet(path)


def full_refresh(df: DataFrame, path: str, date_col: str | None = None) -> None:
    """Replaces all of a stored table in place. ``df`` may be computed from the table itself: it is written aside before.
    Readers can meet a part of it, and a driver lost on the way leaves one: ``stored.StoredTable`` swaps."""
    done = materialise(df, "refresh")
    writer = done.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(date_col) if date_col else writer).parquet(path)


def refresh(df: DataFrame, path: str, date_col: str, full: bool) -> None:
    """One task, two ways: all of the table, or only the slices that ``df`` has rows of."""
    full_refresh(df, path, date_col) if full else overwrite_slices(df, path, date_col)


def rewrite_owned(spark: SparkSession, path: str, fresh: DataFrame, owned: Column) -> None:
    """The stored table after one of its writers replaced the rows that it owns; others' rows stay, but are all read and
    written again: where each writer has rows of its own, ``stored.StoredTable`` leaves them alone."""
    full_refresh(merge_owned(spark.read.parquet(path), fresh, owned), path)


def prefill(source: DataFrame, path: str, scope: Column | None = None) -> None:
    """A scratch copy of a table, or of the rows in ``scope``, to run changed tasks against."""
    (source if scope is None else source.where(scope)).write.mode("overwrite").parquet(path)


def with_dimension(facts: DataFrame, dim: DataFrame, on: dict[str, str], columns: list[str], day: tuple[str, str] | None = None, prefix: str = "") -> DataFrame:
    """``facts`` with ``columns`` of a dimension, null where it has no row; ``on``: fact column to dimension column.

    ``day`` (fact date, snapshot date) picks the dimension's row of that day. ``prefix`` lets one dimension be joined in
    several roles. A key that the dimension has twice raises an error instead of multiplying facts.
    """
    pairs = {**on, **({day[0]: day[1]} if day else {})}
    value = F.struct(*columns)
    once = dim.groupBy(*[F.col(d).alias(f"__k{i}") for i, d in enumerate(pairs.values())]).agg(
        F.max(value).alias("__dim"), F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("the dimension has a key twice")).cast("int")).alias("__twice"))
    test = [F.col(f) == F.col(f"__k{i}") for i, f in enumerate(pairs)]
    joined = facts.join(once, test, "left").where("__twice is null")
    return joined.select(*[F.col(c) for c in facts.columns], *[F.col("__dim")[c].alias(prefix + c) for c in columns])


def first_child(parents: DataFrame, children: DataFrame, key: str, child_key: str, value: str, name: str) -> DataFrame:
    """``parents`` with the least ``value`` of their children, null without any; the children are reduced before the join."""
    least = children.groupBy(F.col(child_key).alias("__key")).agg(F.min(value).alias(name))
    return parents.join(least, F.col(key) == F.col("__key"), "left").drop("__key")


def one_per_key(df: DataFrame, keys: list[str], largest: list[str]) -> DataFrame:
    """Group-by as de-duplication: a row for each key with the greatest value of each other column, nulls aside."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in largest])


def date_spine(days: DataFrame, day: str = "day") -> DataFrame:
    """One row for each day from the first to the last of ``days`` with calendar fields."""
    ends = days.agg(F.min(F.to_date(day)).alias("a"), F.max(F.to_date(day)).alias("b")).where("a is not null")
    d = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    return d.select(
        "day",
        F.year("day").alias("year"),
        F.quarter("day").alias("quarter"),
        F.month("day").alias("month"),
        F.weekofyear("day").alias("week"),
        F.dayofyear("day").alias("day_of_year"),
        F.dayofweek("day").alias("day_of_week"),
        F.date_format("day", "EEEE").alias("day_name"),
        F.date_format("day", "MMMM").alias("month_name"),
        F.dayofweek("day").isin(1, 7).alias("is_weekend"),
        F.trunc("day", "month").alias("month_start"),
        F.last_day("day").alias("month_end"),
        F.date_add(F.make_date(F.year("day"), F.lit(1), F.lit(1)), F.dayofyear("day") - 1).alias("made_date"),
    )
