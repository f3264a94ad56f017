"""Phrase collocations by hierarchical naming of pairs, exact on any amount of text.

Texts are cut into blocks of some million words of one language, at ends of pieces; a block is written as the numbers of its
words in a dictionary of its own, with the counts. So what is shuffled to be counted and named is a block's dictionary,
not its words. Words that are frequent overall get an id; each block learns the ids of its words and rewrites its
sequence as pairs of neighbours that both have one; a block's different pairs are counted over all blocks and get ids in
turn, in one shuffle, and two overlapping frequent pairs are a phrase of three words, and so on. A phrase is two ids, its parents: all but its last and all but its first
word. The frequencies of all first and last parts come from the parents, for the cuts, and a phrase's longer
candidates are those that name it as a parent: frequencies never grow with length, so no longer one needs to be asked.

Counts are exact: a phrase that is frequent enough has only frequent parts. Scores are decimals of up to 38 digits,
for counts below 10**15.

Defined results: a null text is empty, a null lang is ``und``; repeated rows count each time; ids play no part; pieces
without a word, and texts without one, add nothing. Ties in score and count are put in the order of the phrase's bytes.
Extra columns are ignored, an empty table gives no rows. A piece is never cut, so a block can be as long as the
longest piece.
"""

from __future__ import annotations

import itertools
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

LEAST = 10
LONGEST = 3
TOP = 2000
SUBSUMED_PERCENT = 50
BLOCK_WORDS = 1 << 20
#: A-Z in lower case, tabs as spaces, and every end of a piece as a line feed.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def word_blocks(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """block, lang, seq (the words by number as 32 bits each, -1 between pieces; its length, then zstd), words and counts."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = itertools.count(TaskContext.get().partitionId() << 32)
        fresh = lambda: (defaultdict(itertools.count().__next__), array("i"))
        of, held = defaultdict(fresh), 0

        def flush() -> pa.RecordBatch:
            rows = []
            for lang, (words, seq) in of.items():
                places = np.frombuffer(seq, np.int32)
                counts = np.bincount(places[places >= 0], minlength=len(words))
                rows.append((next(ids), lang, places.nbytes.to_bytes(4, "little") + pa.compress(places, "zstd", asbytes=True), [w.decode("utf-8", "replace") for w in words], counts))
            of.clear()
            types = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["block", "lang", "seq", "words", "counts"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for piece in (text or b"").translate(_FOLD).split(b"\n"):
                    words = piece.split()
                    if words:
                        number, seq = of[lang]
                        seq.extend(map(number.__getitem__, words))
                        seq.append(-1)
                        held += len(words)
                        if held >= block_words:
                            yield flush()
                            held = 0
        if of:
            yield flush()

    rows = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(encoded, "block long, lang string, seq binary, words array<string>, counts array<long>")


def _places(seq: bytes, names: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stands at each place of a block: its word (as numbered there), the rank of its phrase of k - 1 words among the
    block's frequent ones (-1: none), and the ids by rank.

    A phrase is named in its block by the pair of what it is made of: two words, or two ranks of one word less.
    """
    words = np.frombuffer(pa.decompress(seq[4:], int.from_bytes(seq[:4], "little"), "zstd"), np.int32).astype(np.int64)
    level, code, ids = (names.column(c).to_numpy() for c in ("level", "code", "id"))
    at = words
    for here in range(1 if k == 2 else 2, k):
        mine = np.flatnonzero(level == here)
        mine = mine[np.argsort(code[mine])]
        asked = at if here == 1 else np.where((at[:-1] >= 0) & (at[1:] >= 0), at[:-1] << 32 | at[1:], -1)
        known = np.append(code[mine], -2)
        rank = np.searchsorted(known[:-1], asked)
        at = np.where(known[rank] == asked, rank, -1)
        own = ids[mine]
    return words, at, own


def _pairs(blocks: DataFrame, names: DataFrame, k: int, last: bool) -> DataFrame:
    """left, right and n of the phrases of ``k`` words in each block that are two overlapping named ones; except for the ``last``
    length also the block and their name in it (code). names: block, level, code, id."""

    def paired(block: pa.Table, names: pa.Table) -> pa.Table:
        out = []
        for number, seq in zip(block.column("block").to_pylist(), block.column("seq").to_pylist()):
            words, at, ids = _places(seq, names, k)
            both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
            of = words if k == 2 else at
            code, first, n = np.unique(of[both] << 32 | of[both + 1], return_index=True, return_counts=True)
            row = {"left": ids[at[both[first]]], "right": ids[at[both[first] + 1]], "n": n}
            out.append(pa.table(row if last else {"block": np.full(len(code), number), "code": code, **row}))
        return pa.concat_tables(out) if out else none

    schema = "left long, right long, n long" if last else "block long, code long, left long, right long, n long"
    none = pa.table({c.split()[0]: pa.array([], pa.int64()) for c in schema.split(", ")})
    names = names.select(F.col("block").alias("of_block"), "level", "code", "id")
    return blocks.select("block", "seq").groupBy("block").cogroup(names.groupBy("of_block")).applyInArrow(paired, schema)


def _frequent(entries: DataFrame, key: list[str], least: int) -> DataFrame:
    """``entries`` whose ``key`` has a sum of n of ``least`` or more, with that (f), an id of the key and whether the row is the key's first.

    One shuffle does for counting and naming; a key has a row for each block at most.
    """
    rows = entries.repartition(*key).withColumn("row", F.monotonically_increasing_id())
    of = Window.partitionBy(*key)
    rows = rows.withColumn("f", F.sum("n").over(of)).withColumn("id", F.min("row").over(of)).where(F.col("f") >= least)
    return rows.withColumn("first", F.col("row") == F.col("id")).drop("row", "n")


def phrases(blocks: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """For each length from 1 to ``longest`` a table of the phrases with ``least`` occurrences or more: id, lang, phrase, f, left and right (ids of
    the parents, null for words), last (its last word), firsts and rests (the frequencies of its first and last 1, 2, ... words)."""
    entries = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "e"))
    entries = entries.select("block", F.col("code").cast("long").alias("code"), "lang", F.col("e.words").alias("phrase"), F.col("e.counts").alias("n"))
    named = materialise(_frequent(entries, ["lang", "phrase"], least), "phrase-names-1")
    none = lambda kind: F.lit(None).cast(kind)
    words = named.where("first").select("id", "lang", "phrase", "f", none("long").alias("left"), none("long").alias("right"), F.col("phrase").alias("last"), F.array().cast("array<long>").alias("firsts"), F.array().cast("array<long>").alias("rests"))
    levels, names = [words], named.select("block", F.lit(1).alias("level"), "code", "id")
    for k in range(2, longest + 1):
        entries = _pairs(blocks, names, k, k == longest)
        if k == longest:
            found = entries.groupBy("left", "right").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("id", none("long"))
            found = materialise(found, f"phrase-names-{k}")
        else:
            named = materialise(_frequent(entries, ["left", "right"], least), f"phrase-names-{k}")
            found, here = named.where("first"), named.select("block", F.lit(k).alias("level"), "code", "id")
            names = here if k == 2 else names.unionByName(here)
        up = levels[-1]
        a = up.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("a_phrase"), F.concat("firsts", F.array("f")).alias("firsts"))
        b = up.select(F.col("id").alias("right"), "last", F.concat("rests", F.array("f")).alias("rests"))
        full = found.join(a, "left").join(b, "right").withColumn("phrase", F.concat_ws(" ", "a_phrase", "last"))
        levels.append(materialise(full.select("id", "lang", "phrase", "f", "left", "right", "last", "firsts", "rests"), f"phrase-{k}"))
    return levels


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10**15."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, subsumed: int = SUBSUMED_PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases of 2 to ``longest`` words."""
    with small_batches(documents.sparkSession):  # all that runs in Python is written inside
        blocks = materialise(word_blocks(documents, block_words), "phrase-blocks")
        levels = phrases(blocks, least, longest)
    parts = []
    for k in range(2, longest + 1):
        here = levels[k - 1]
        if k < longest:
            above = levels[k]
            of = above.select(F.col("left").alias("id"), "f").unionByName(above.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("longer"))
            here = here.join(of, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < subsumed * F.col("f")))
        cuts = [F.struct(score(F.col("f"), F.col("firsts")[j - 1], F.col("rests")[k - j - 1]).alias("score"), F.lit(j).alias("k"), F.col("firsts")[j - 1].alias("l"), F.col("rests")[k - j - 1].alias("r")) for j in range(1, k)]
        parts.append(here.select("lang", "phrase", F.col("f").alias("a"), F.array_min(F.array(*cuts)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    found = reduce(DataFrame.unionByName, parts)
    # each task keeps its own first rows of a language before they meet
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = found.withColumn("rank", nth).where(F.col("rank") <= top)
    n = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
