"""One JSON text for a value: keys sorted, strings escaped, nulls written, no spaces; equal texts mean equal values.

The text is made by Spark's own JSON writer from a value whose keys have been put in order, so it stays one
expression. What that writer would shorten is turned into text before: times keep their microseconds, intervals and binary
their every part. Two values of one type never share a text (null, the text "null" and an absent array entry differ).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DateType, DayTimeIntervalType, DecimalType, MapType, NullType, StructType, TimestampNTZType, TimestampType, YearMonthIntervalType

_AS_TEXT = (DateType, TimestampType, TimestampNTZType, DayTimeIntervalType, YearMonthIntervalType, DecimalType, NullType)


def _ordered(c: Column, kind: DataType) -> Column:
    """``c`` with the keys of all its structs and maps in order."""
    if isinstance(kind, StructType):
        names = sorted(f.name for f in kind)
        if not names:
            return F.when(c.isNotNull(), F.create_map().cast("map<string,string>"))
        return F.when(c.isNotNull(), F.struct(*[_ordered(c.getField(n), kind[n].dataType).alias(n) for n in names]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, MapType):
        # a map's keys are texts in JSON; those of other types are written as JSON themselves
        own = (lambda k: k) if kind.keyType.simpleString() == "string" else (lambda k: canonical_json(k, kind.keyType))
        pairs = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.struct(own(k).alias("key"), _ordered(F.element_at(c, k), kind.valueType).alias("value")))
        return F.map_from_entries(pairs)
    if isinstance(kind, BinaryType):
        return F.hex(c)
    if isinstance(kind, _AS_TEXT):
        return c.cast("string")
    return c


def canonical_json(c: Column, kind: DataType) -> Column:
    """The JSON text of ``c``, whose type is ``kind``; null is the text null."""
    whole = F.to_json(F.struct(_ordered(c, kind).alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)  # what stands between {"v": and }


def row_json(schema: StructType) -> Column:
    """The JSON text of a whole row of a frame with ``schema``."""
    return canonical_json(F.struct(*[F.col(f"`{f.name}`") for f in schema]), schema)


def fingerprint(c: Column, kind: DataType) -> Column:
    """sha256: and the SHA-256 of the value's JSON text in UTF-8."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(c, kind).cast("binary"), 256))
