"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks; each chunk's hash is a polynomial in a fixed base
modulo each of two primes, and the hash of a concatenation follows from its
parts alone, ``h(a+b) = h(a) * base**len(b) + h(b)``. The chunks of a long text
become rows, are dealt over the tasks, hashed there and combined by one small
aggregate. Rows with equal fingerprints are candidates only: their texts are then
compared chunk by chunk with the text of the group's first row, and rows that
differ start a new group.

Defined results: a null text is the empty text. White-space runs count as one
space. A null doc_id sorts after all others. One row of a group is kept, however
often its doc_id or the whole row is repeated; a group of null ids alone has a
null keep_id. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WS, materialise, salted_join

#: Two primes below 2**31 and a base for each, so that products fit in a long.
MODULI = ((2147483647, 1103515245), (2147483629, 1664525013))
CHUNK_BYTES = 1 << 16


def normalise(text: bytes) -> bytes:
    """Every run of ASCII white space as one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    space = b" \t\n\r\x0b\x0c"
    return (b" " if text[0] in space else b"") + b" ".join(words) + (b" " if text[-1] in space else b"")


def chunk_hash(chunk: bytes, moduli=MODULI) -> list[tuple[int, int]]:
    """(hash, shift) of a chunk for each modulus; shift is base**len."""
    out = []
    values = np.frombuffer(chunk, np.uint8).astype(np.int64) + 1
    for k, (prime, base) in enumerate(moduli):
        powers = _table(k, prime, base)
        h, done = 0, 0
        while done < len(values):  # 4096 products below 2**39 add up below 2**51
            part = values[done : done + 4096]
            h = (h * int(powers[len(part)]) + int(part @ powers[len(part) - 1 :: -1][: len(part)])) % prime
            done += len(part)
        out.append((h, pow(base, len(values), prime)))
    return out


_TABLES: dict[tuple[int, int, int], np.ndarray] = {}


def _table(k: int, prime: int, base: int) -> np.ndarray:
    if (k, prime, base) not in _TABLES:
        t = np.ones(4097, np.int64)
        for i in range(1, 4097):
            t[i] = t[i - 1] * base % prime
        _TABLES[k, prime, base] = t
    return _TABLES[k, prime, base]


def combine(parts: list[tuple[int, int]], prime: int) -> int:
    """Hash of a concatenation from (hash, shift) of its parts, in order."""
    h = 0
    for part, shift in parts:
        h = (h * shift + part) % prime
    return h


def _normal() -> Column:
    return F.coalesce(F.regexp_replace("text", WS + "+", " "), F.lit("")).cast("binary")


ROW = "row long, doc_id long, n_bytes long, f1 long, f2 long, text_sha256 string"


def fingerprints(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES, moduli=MODULI) -> DataFrame:
    """row (a number for each), doc_id, n_bytes, f1, f2 and text_sha256 of each row's normalised text.

    Texts that may be longer than a chunk leave as rows of one chunk each, so no worker holds or hashes all of one.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                norm = normalise(text or b"")
                (h1, _), (h2, _) = chunk_hash(norm, moduli)
                out.append((len(norm), h1, h2, hashlib.sha256(norm).hexdigest()))
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], ["row", "doc_id", "n_bytes", "f1", "f2", "text_sha256"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sum(chunk_hash(chunk, moduli), ()) for chunk in batch.column(2).to_pylist()]
            cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], ["text_sha256", "part", "h1", "s1", "h2", "s2"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk_bytes
    short = rows.where(~is_long).select((F.monotonically_increasing_id() * 2).alias("row"), "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(whole, ROW)

    # a long text's chunks are named by its content, not by its row: rows are numbered in one branch alone, so that it
    # doesn't matter in which order a shuffle, or a second try of one, brings them
    norm = rows.where(is_long).select("doc_id", _normal().alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    known = norm.select((F.monotonically_increasing_id() * 2 + 1).alias("row"), "doc_id", F.octet_length("norm").cast("long").alias("n_bytes"), "text_sha256")
    cut = f"transform(sequence(0, greatest(octet_length(norm) - 1, 0), {chunk_bytes}), o -> substring(norm, o + 1, {chunk_bytes}))"
    parts = norm.select("text_sha256", F.monotonically_increasing_id().alias("deal"), F.posexplode(F.expr(cut)).alias("part", "chunk"))
    # chunks of copies are dealt over tasks like others, and are one again once they are hashed
    parts = parts.repartition("text_sha256", "part", "deal").select("text_sha256", "part", "chunk").mapInArrow(hashed, "text_sha256 string, part int, h1 long, s1 long, h2 long, s2 long")
    one = parts.groupBy("text_sha256", "part").agg(F.min(F.struct("h1", "s1", "h2", "s2")).alias("h")).select("text_sha256", "part", "h.*")
    fold = "aggregate(parts, 0L, (a, x) -> (a * x.s{0} + x.h{0}) % {1}L)"
    whole_hash = one.groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("part", "h1", "s1", "h2", "s2"))).alias("parts"))
    whole_hash = whole_hash.select("text_sha256", F.expr(fold.format(1, moduli[0][0])).alias("f1"), F.expr(fold.format(2, moduli[1][0])).alias("f2"))
    known = materialise(known, "exact-long")
    n = known.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"))
    long_rows = salted_join(known, whole_hash.join(n, "text_sha256"), ["text_sha256"])
    return short.unionByName(long_rows.select("row", "doc_id", "n_bytes", "f1", "f2", "text_sha256"))


KEY = ["n_bytes", "f1", "f2"]
#: What names a row's text and id; the id of null ids is 0.
NAME = ["no_id", "id", "text_sha256"]


def _named(df: DataFrame) -> DataFrame:
    return df.withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0))})


def _groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """The first row of each group, by id (nulls last), text and row, and its size as n."""
    return rows.groupBy(*key).agg(F.min(F.struct(*NAME, "row")).alias("lead"), F.count(F.lit(1)).alias("n"))


def _unequal(documents: DataFrame, members: DataFrame, chunk_bytes: int) -> DataFrame:
    """NAME and KEY of the rows of ``members`` whose text isn't their leader's, compared chunk by chunk.

    ``members``: NAME, KEY, lead (a struct) and n (rows of the group). A fingerprint of very many copies is dealt over
    many tasks, each with the leader's text.
    """
    texts = _named(documents.select(F.col("doc_id").cast("long").alias("doc_id"), _normal().alias("norm")))
    texts = texts.withColumn("text_sha256", F.sha2("norm", 256)).drop("doc_id")
    once = members.dropDuplicates([*NAME, *KEY])  # copies of a row meet it, not each other
    rows = materialise(texts.join(once.select(*NAME, *KEY, "lead", "n"), NAME), "exact-candidates")
    leads_it = reduce(Column.__and__, [F.col(c) == F.col("lead")[c] for c in NAME])
    leads = rows.where(leads_it).dropDuplicates(KEY).select(*KEY, "n", F.col("norm").alias("lead_norm"))
    schema = StructType([rows.schema[c] for c in (*KEY, *NAME)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            different = []
            for a, b in zip(batch.column("norm"), batch.column("lead_norm")):
                a, b = memoryview(a.as_buffer()), memoryview(b.as_buffer())
                equal = len(a) == len(b) and all(a[i : i + chunk_bytes] == b[i : i + chunk_bytes] for i in range(0, len(a), chunk_bytes))
                different.append(not equal)
            yield batch.select([*KEY, *NAME]).filter(pa.array(different, pa.bool_()))

    both = salted_join(rows.where(~leads_it).select(*KEY, *NAME, "norm"), leads, KEY)
    return both.select(*KEY, *NAME, "norm", "lead_norm").mapInArrow(compare, schema).distinct()


def exact_dedup(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES, moduli=MODULI) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``documents``."""
    rows = _named(materialise(fingerprints(documents, chunk_bytes, moduli), "exact-fingerprints"))
    groups = materialise(_groups(rows, KEY), "exact-groups")
    several = salted_join(rows, groups.where("n > 1"), KEY)
    left, tags = materialise(_unequal(documents, several, chunk_bytes), "exact-unequal"), None
    turn = 0
    while not left.isEmpty():  # fingerprints of different texts were equal: these rows form groups of their own
        turn += 1
        tag = left.withColumn("turn", F.lit(turn))
        tags = tag if tags is None else tags.unionByName(tag)
        again = left.groupBy(*KEY).agg(F.min(F.struct(*NAME)).alias("lead"), F.count(F.lit(1)).alias("n"))
        left = materialise(_unequal(documents, left.join(again, KEY), chunk_bytes), "exact-unequal")
    key = KEY
    if tags is not None:
        last = tags.groupBy(*NAME, *KEY).agg(F.max("turn").alias("turn"))
        rows = materialise(rows.join(last, [*NAME, *KEY], "left").withColumn("turn", F.coalesce("turn", F.lit(0))), "exact-turns")
        key = [*KEY, "turn"]
        groups = materialise(_groups(rows, key), "exact-groups")
    out = salted_join(rows, groups, key)
    keep = F.when(~F.col("lead.no_id"), F.col("lead.id"))
    return out.select("doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("lead.row")).alias("kept"), "text_sha256")
