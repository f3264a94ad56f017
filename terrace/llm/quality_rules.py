"""Quality rules: counts of the whole text, then a calibrated logistic regression.

The regression works on hashed n-grams, of one and two words and of three
characters (code points), as square roots of their shares. It is fitted on the
driver from about ``sample_rows`` different labelled rows (a documented bound,
however often an id is repeated), calibrated by Platt scaling on a fold it wasn't
fitted on, and applied in Arrow batches: a document is kept
if it passes the base rules and its probability of good quality reaches
``threshold``.

Defined results: a null text has no words and fails the base rules; label rows
without a document or with a null quality are left out, and if one of the two
labels is missing the verdict is that of the base rules alone. Where labels
repeat for an id, each counts. Extra columns don't matter, empty tables give no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample
from .linear import logistic, logistic_regression, platt
from .textbytes import U64, Block, blocks, mix, repeats

SAMPLE_ROWS = 2000
THRESHOLD = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
WINDOW = 3
WORD_BITS, CHAR_BITS = 13, 13
DIMS = (1 << WORD_BITS) + (1 << CHAR_BITS)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_TRAIL = (np.arange(256) & 0xC0) == 0x80


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    start, end = block.words()
    first = np.searchsorted(start, block.off)
    out = {"n_words": np.diff(first)}
    chars = block.counts(~_TRAIL[block.data], start, end)
    total = np.concatenate([[0], np.cumsum(chars)])
    out["word_chars"] = total[first[1:]] - total[first[:-1]]
    out["n_symbols"] = block.counts(_SYMBOL[block.data], block.off[:-1], block.off[1:])

    line_start, line_end, line_doc = block.lines()
    full = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    _, earlier = repeats(block.hashes(line_start, line_end), line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[earlier], minlength=block.n)

    word, doc = block.hashes(start, end), np.repeat(np.arange(block.n), out["n_words"])
    covered = np.zeros(len(word), bool)
    if len(word) >= WINDOW:
        key = word[: len(word) - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            key = mix(key) + word[k : len(word) - WINDOW + 1 + k]
        inside = doc[: len(key)] == doc[WINDOW - 1 :]
        again, _ = repeats(key[inside], doc[: len(key)][inside])
        at = np.flatnonzero(inside)[again]
        for k in range(WINDOW):
            covered[at + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=block.n)
    return out


def features(block: Block) -> np.ndarray:
    """One row of square-rooted n-gram shares for each text, words and characters half each."""
    start, end = block.words()
    word, doc = block.hashes(start, end), block.of(start)
    rows = [doc]
    slots = [word >> U64(64 - WORD_BITS)]
    if len(word) > 1:
        pair = mix(word[:-1] + U64(1)) + word[1:]
        same = doc[:-1] == doc[1:]
        rows.append(doc[:-1][same])
        slots.append((mix(pair) >> U64(64 - WORD_BITS))[same])
    where = np.concatenate([r * (1 << WORD_BITS) + s.astype(np.int64) for r, s in zip(rows, slots)])
    words = np.bincount(where, minlength=block.n << WORD_BITS).reshape(block.n, -1)
    spaced = Block(np.where((block.data > 8) & (block.data < 14), np.uint8(32), block.data), block.off)
    char = np.flatnonzero(~_TRAIL[spaced.data])
    of = spaced.of(char)
    inside = np.flatnonzero(of[: max(len(char) - 2, 0)] == of[2:])  # no n-gram runs over two texts
    end = np.append(char, len(spaced.data))[inside + 3]
    where = (of[inside] << CHAR_BITS) + (spaced.hashes(char[inside], end) >> U64(64 - CHAR_BITS)).astype(np.int64)
    grams = np.bincount(where, minlength=block.n << CHAR_BITS).reshape(block.n, -1)
    halves = [np.sqrt(h.astype(np.float32) / np.maximum(h.sum(1, keepdims=True), 1).astype(np.float32)) for h in (words, grams)]
    return np.hstack(halves)


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    shift: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.slope * (x @ self.weights[:-1] + self.weights[-1]) + self.shift)


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The calibrated model; None if a label is missing. The sample crosses as one Arrow table of half-precision rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column(0)):
                x = features(block).astype(np.float16)
                part = batch.slice(at, block.n)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([r.tobytes() for r in x], pa.binary())], ["quality", "fold", "sample_key", "x"])

    marked = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    fold = F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")) % 4
    sample = labelled_sample(documents, marked, "quality", sample_rows, 0.7)
    got = sample.select("text", "quality", fold.cast("int").alias("fold"), "sample_key").mapInArrow(rows, "quality int, fold int, sample_key long, x binary").toArrow()
    got = got.sort_by([("quality", "ascending"), ("sample_key", "ascending")])
    y, held = got.column("quality").to_numpy().astype(np.float32), got.column("fold").to_numpy() == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return None
    x = np.frombuffer(got.column("x").combine_chunks().buffers()[2], np.float16).reshape(len(y), DIMS)
    w = logistic_regression(x[~held], y[~held])
    slope, shift = platt(x[held].astype(np.float64) @ w[:-1] + w[-1], y[held])
    return Model(w.astype(np.float32), slope, shift)


def apply_rules(documents: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, probability and kept of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column(1)):
                counts = base_counts(block)
                failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
                p = shared.value.probability(features(block)) if shared.value else np.ones(block.n)
                cols = [batch.column(0).slice(at, block.n), *[pa.array(counts[k].astype(np.int64)) for k in names]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(failed), pa.array(p.astype(np.float64)), pa.array(~failed & (p >= threshold))], ["doc_id", *names, "base_failed", "probability", "kept"])

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, probability double, kept boolean"
    return documents.select("doc_id", "text").mapInArrow(score, schema)


def quality_rules(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    return apply_rules(documents, fit(documents, labels, sample_rows), threshold)
