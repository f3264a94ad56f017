"""Rules as data over one frame: each says what offends it in a row, and all of them are asked in a single scan.

A rule's ``offenders`` is an array of texts, empty where a row keeps to it, so rules about nested columns and entities are
expressions like those about the row itself. ``applies`` says of which rows it is asked at all. The problems
of a row are one array, made without a join or a scan of their own, and exploded at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "array<string>"


@dataclass(frozen=True)
class Rule:
    rule: str
    dimension: str
    severity: str
    offenders: Column
    applies: Column | None = None


def when(bad: Column, what: Column | str) -> Column:
    """``what`` as the only offender where ``bad`` holds (null counts as not)."""
    one = F.array(F.lit(what) if isinstance(what, str) else what.cast("string"))
    return F.when(F.coalesce(bad, F.lit(False)), one).otherwise(F.array().cast(NONE))


def those(items: Column, bad, name) -> Column:
    """The names of the ``items`` (an array) that are ``bad``; a null array has none."""
    found = F.transform(F.filter(items, lambda x: F.coalesce(bad(x), F.lit(False))), lambda x: F.coalesce(name(x).cast("string"), F.lit("?")))
    return F.coalesce(found, F.array().cast(NONE))


def repeated(names: Column) -> Column:
    """The texts of an array that stand in it twice or more, whatever their case, once each."""
    low = F.transform(F.filter(names, lambda x: x.isNotNull()), lambda x: F.lower(x))
    return F.coalesce(F.array_distinct(F.filter(low, lambda x: F.size(F.filter(low, lambda y: y == x)) > 1)), F.array().cast(NONE))


def _found(rules: list[Rule]) -> Column:
    one = lambda r: F.transform(F.when(F.coalesce(r.applies, F.lit(False)), r.offenders).otherwise(F.array().cast(NONE)) if r.applies is not None else r.offenders, lambda x: F.struct(
        F.lit(r.rule).alias("rule"), F.lit(r.dimension).alias("dimension"), F.lit(r.severity).alias("severity"), x.alias("item")))
    return F.concat(*[one(r) for r in rules])


def violations(rows: DataFrame, target: str, rules: list[Rule]) -> DataFrame:
    """target, rule, dimension, severity and item of everything that offends ``rules`` in ``rows``, in one scan."""
    return rows.select(F.col(target).alias("target"), F.explode(_found(rules)).alias("__p")).select("target", "__p.*")


def checks(rows: DataFrame, target: str, rules: list[Rule]) -> DataFrame:
    """target, rule, dimension, severity, passed and items (sorted) of every rule asked of every row, in one scan: what the
    scores are made from."""
    asked = F.concat(*[F.when(F.coalesce(r.applies, F.lit(False)) if r.applies is not None else F.lit(True), F.array(F.struct(
        F.lit(r.rule).alias("rule"), F.lit(r.dimension).alias("dimension"), F.lit(r.severity).alias("severity"), (F.size(r.offenders) == 0).alias("passed"), F.array_sort(r.offenders).alias("items")))).otherwise(
            F.array().cast("array<struct<rule:string,dimension:string,severity:string,passed:boolean,items:array<string>>>")) for r in rules])
    return rows.select(F.col(target).alias("target"), F.explode(asked).alias("__p")).select("target", "__p.*")


def status(found: DataFrame) -> DataFrame:
    """status (blocked or passed) and error_count of a candidate, one row."""
    return found.agg(F.count(F.lit(1)).alias("error_count")).select(F.when(F.col("error_count") > 0, "blocked").otherwise("passed").alias("status"), "error_count")
