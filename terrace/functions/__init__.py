"""Column helpers for warehouse tasks: money, ratios, keys and calendar fields, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column | str, scale: int = 2) -> Column:
    """An amount as an exact decimal, so sums don't depend on the order of rows."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")


def safe_ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded, null where b is null or 0."""
    return F.round(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), digits)


def surrogate_key(*keys: str) -> Column:
    """md5 of the keys as text, a null key counting as a value of its own."""
    return F.md5(F.concat_ws("||", *[F.coalesce(F.col(k).cast("string"), F.lit("_null_")) for k in keys]))


def hashed(c: str) -> Column:
    """sha256 of a personal value; null stays null."""
    return F.when(F.col(c).isNotNull(), F.sha2(F.col(c).cast("string"), 256))


def month_key(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM")


def whole_months(start: Column, end: Column) -> Column:
    """Completed calendar months from start to end, for end >= start."""
    return (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start)) - (F.dayofmonth(end) < F.dayofmonth(start)).cast("int")


def in_month(c: Column, month: str) -> Column:
    """date_format(c, 'yyyy-MM') = month, as a half-open range that reaches the scan as a filter."""
    first = F.lit(f"{month}-01").cast("date")
    return (c >= first) & (c < F.add_months(first, 1))
