"""Data-quality gates and comparison of two versions of a table, as joins and aggregates.

A gate returns the offending rows, none if the data are clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .ranking import with_position
from .shared import materialise

#: Rows of a side that are aggregated and compared in one task.
ROWS_A_TASK = 250_000


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose non-null key has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def unbalanced(df: DataFrame, keys: list[str], debit: Column, credit: Column, tolerance: float = 1e-6) -> DataFrame:
    """Keys whose debits and credits differ by more than ``tolerance`` or are null."""
    sums = df.groupBy(*keys).agg(F.sum(debit).alias("debit"), F.sum(credit).alias("credit"))
    return sums.where(F.col("debit").isNull() | F.col("credit").isNull() | (F.abs(F.col("debit") - F.col("credit")) > tolerance))


def aggregate_mismatch(kept: DataFrame, again: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.01) -> DataFrame:
    """Rows of the stored aggregate that have no recomputed row or differ from it."""
    other = again.select(*keys, *[F.col(v).alias(f"{v}_again") for v in values], F.lit(True).alias("__found"))
    off = [~F.col(v).eqNullSafe(F.col(f"{v}_again")) & F.coalesce(F.abs(F.col(v) - F.col(f"{v}_again")) > tolerance, F.lit(True)) for v in values]
    return kept.join(other, keys, "left").where(F.col("__found").isNull() | reduce(Column.__or__, off)).drop("__found")


def _differs(a: Column, b: Column, kind, tolerance: float | None) -> Column:
    equal = a.eqNullSafe(b)
    if isinstance(kind, (DoubleType, FloatType)) and tolerance:
        equal = equal | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    return ~equal


def _aligned(left: DataFrame, right: DataFrame, exclude: list[str], mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the left's names, without the excluded columns (whatever their case)."""
    out = {c.lower() for c in exclude}
    names = [c for c in left.columns if c.lower() not in out]
    if not names:
        raise ValueError("no columns to compare")
    return left.select(*names), right.select(*[F.col(mapping.get(c, c)).alias(c) for c in names])


def compare_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_count, right_count and equal, one row."""
    both = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.lit(0).alias("l"), F.lit(1).alias("r")))
    n = both.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("left_count"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_count"))
    return n.withColumn("equal", F.col("left_count") == F.col("right_count"))


def compare_multisets(left: DataFrame, right: DataFrame, exclude: tuple | list = (), mapping: dict | None = None) -> DataFrame:
    """Rows that one side has more often, with ``extra`` (positive: left). One aggregate over both, combined before its shuffle."""
    a, b = _aligned(left, right, list(exclude), mapping or {})
    both = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("__n").alias("extra")).where("extra <> 0")


def dealt_alike(left: DataFrame, right: DataFrame, keys: list[str], rows: int = ROWS_A_TASK) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt by ``keys`` to as many partitions as give a task about ``rows`` rows of a side, however large they are.

    Aggregates of each side by these keys and ``compare_keyed`` of them need no other shuffle.
    """
    parts = max(left.count(), right.count()) // rows + 1
    return left.repartition(parts, *keys), right.repartition(parts, *keys)


def compare_keyed(left: DataFrame, right: DataFrame, keys: list[str], exclude: tuple | list = (), mapping: dict | None = None, tolerance: float | None = 0.01) -> DataFrame:
    """keys, side and the sorted names of the columns that differ, for each key that mismatches.

    side: left or right (the other has no such key; its columns are those with a value), both (values differ) or repeated
    (a side has the key several times and the rows aren't the same on both; no columns). A null key is a key. One aggregate over both sides, combined before its
    shuffle, so no key multiplies rows. Rows of a repeated key that aren't equal are paired in order (``_unpaired``), so that
    the tolerance holds for them too.
    """
    a, b = _aligned(left, right, list(exclude), mapping or {})
    values = [c for c in a.columns if c not in keys]
    kinds = {f.name: f.dataType for f in a.schema}
    row = F.struct(F.lit(0).alias("__row"), *values)
    side = lambda df, own: df.select(*keys, row.alias("__row"), F.lit(own).alias("__left"), F.xxhash64(F.lit(0), *values).cast("decimal(20,0)").alias("__hash"))  # noqa: E731  decimals, so that sums can't overflow
    of = lambda own, c: F.when(F.col("__left") == own, F.col(c))
    both = side(a, True).unionByName(side(b, False)).groupBy(*keys).agg(
        F.count(of(True, "__hash")).alias("nl"), F.count(of(False, "__hash")).alias("nr"), F.sum(of(True, "__hash")).alias("hl"), F.sum(of(False, "__hash")).alias("hr"),
        F.max(of(True, "__row")).alias("l"), F.max(of(False, "__row")).alias("r"))
    several = (F.col("nl") > 1) | (F.col("nr") > 1)
    off = [F.when(_differs(F.col("l")[c], F.col("r")[c], kinds[c], tolerance), F.lit(c)) for c in values]
    name = F.when(F.col("nr") == 0, "left").when(F.col("nl") == 0, "right").when(several, "repeated").otherwise("both")
    differ = F.when(name != "repeated", F.array_sort(F.filter(F.array(*off), lambda x: x.isNotNull()))).otherwise(F.array().cast("array<string>"))
    same = several & (F.col("nl") == F.col("nr")) & (F.col("hl") == F.col("hr"))
    rows = both.where(~same).select(*keys, name.alias("side"), differ.alias("columns"))
    floats = [c for c in values if isinstance(kinds[c], (DoubleType, FloatType))]
    if not (tolerance and floats):
        return rows.where((F.col("side") != "both") | (F.size("columns") > 0))
    rows = materialise(rows, "compare")
    again = rows.where("side = 'repeated'").select(*keys)
    if again.isEmpty():
        return rows.where((F.col("side") != "both") | (F.size("columns") > 0))
    bad = _unpaired(a, b, again, keys, [c for c in values if c not in floats], floats, tolerance)
    once = rows.where("side <> 'repeated' and (side <> 'both' or size(columns) > 0)")
    return once.unionByName(rows.where("side = 'repeated'").join(_renamed(bad, keys), _same(keys), "left_semi"))


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])


def _same(keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])


def _unpaired(a: DataFrame, b: DataFrame, only: DataFrame, keys: list[str], exact: list[str], floats: list[str], tolerance: float) -> DataFrame:
    """The ``only`` keys with a row that has no partner on the other side: equal but for its floats, which are within the tolerance.

    Rows that agree in key and exact columns are sorted by their floats on each side, and the n-th are partners: no row
    meets more than one. For one float column no other pairing is better; several are sorted in their order.
    """
    rows = a.select("*", F.lit(True).alias("__left")).unionByName(b.select("*", F.lit(False).alias("__left")))
    rows = rows.join(_renamed(only, keys), _same(keys), "left_semi")
    nth = F.row_number().over(Window.partitionBy(*keys, *exact, "__left").orderBy(*floats))
    of = lambda own, c: F.max(F.when(F.col("__left") == own, F.col(c)))
    pairs = rows.withColumn("__nth", nth).groupBy(*keys, *exact, "__nth").agg(F.count(F.lit(1)).alias("__n"), *[of(own, c).alias(f"{p}{i}") for own, p in ((True, "__l"), (False, "__r")) for i, c in enumerate(floats)])
    off = reduce(Column.__or__, [_differs(F.col(f"__l{i}"), F.col(f"__r{i}"), DoubleType(), tolerance) for i in range(len(floats))])
    return pairs.where((F.col("__n") < 2) | off).select(*keys).distinct()


def compare_positions(left: DataFrame, right: DataFrame, order: list[str], exclude: tuple | list = (), tolerance: float | None = 0.01) -> DataFrame:
    """Mismatches of the i-th rows of both sides in the given order, by range-sorted positions."""
    a, b = _aligned(left, right, list(exclude), {})
    return compare_keyed(with_position(a, order), with_position(b, order), ["position"], tolerance=tolerance)


def column_counts(mismatches: DataFrame) -> DataFrame:
    """column and mismatches: in how many of the compared rows each column differs."""
    return mismatches.select(F.explode("columns").alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("mismatches"))


def formatted(df: DataFrame) -> DataFrame:
    """All columns as the text of a report: null as NULL, floats with six decimals."""
    as_text = lambda f: F.format_string("%.6f", f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name).cast("string")
    return df.select(*[F.coalesce(F.when(F.col(f.name).isNotNull(), as_text(f)), F.lit("NULL")).alias(f.name) for f in df.schema])


def details(mismatches: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """The first ``most`` mismatches by key, for a report."""
    return mismatches.orderBy(*keys).limit(most)


def sampled(df: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows in the order of all columns: the same sample on both sides of a comparison."""
    return df.orderBy(*df.columns).limit(most)


def flat_checks(groups: DataFrame) -> DataFrame:
    """One row for each check of a group; groups: name and ``checks`` (an array of structs)."""
    return groups.select("name", F.posexplode("checks").alias("nth", "check")).select("name", F.col("nth").cast("long").alias("nth"), "check.*")


def verdict(checks: DataFrame) -> DataFrame:
    """One status from check rows (required, ran, passed, sampled), the first that holds: blocked if a required
    check didn't run, failed, inconclusive if any didn't run, passed_with_warnings if sampled or optional ones failed, passed."""
    any_of = lambda c: F.coalesce(F.max(c), F.lit(False))
    ran, ok = F.col("ran"), F.coalesce(F.col("passed"), F.lit(False))
    s = checks.agg(
        any_of(F.col("required") & ~ran).alias("blocked"),
        any_of(F.col("required") & ran & ~ok).alias("failed"),
        any_of(~ran).alias("open"),
        any_of(F.col("sampled") | (~F.col("required") & ran & ~ok)).alias("warned"),
    )
    status = F.when(F.col("blocked"), "blocked").when(F.col("failed"), "failed").when(F.col("open"), "inconclusive").when(F.col("warned"), "passed_with_warnings").otherwise("passed")
    return s.select(status.alias("status"))
