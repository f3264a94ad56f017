"""Language identification in two levels.

A linear model first tells the language families apart; within the family a
linear support vector machine for each pair of its languages votes. Features
are hashed n-grams of one to three bytes of the whole text, case-folded, as
square roots of their shares.

The models are fitted on the driver from about ``sample_rows`` different labelled
rows (a documented bound, whatever the table's size and however often a row or an
id is repeated); every text is scored in Arrow batches in the tasks.

Defined results: ``und`` with score 0 where the text is null or has no letter;
a language that FAMILIES doesn't list is a family of its own; with no labelled
row at all every text is ``und``. Repeated rows, extra columns and empty tables
need no care: each row is scored alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_sample, id_bucket
from .linear import gram, linear_svm, logistic, weigh
from .textbytes import Block, blocks

#: Families of closely related languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "ug", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "iranian": ("fa", "ku", "ps"),
    "semitic": ("am", "ar", "he", "mt"),
    "malayic": ("id", "jv", "ms", "su"),
}
SAMPLE_ROWS = 2000
BITS2, BITS3 = 12, 12
DIMS = 256 + (1 << BITS2) + (1 << BITS3)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_FOLD[48:58] = 48


def features(block: Block) -> np.ndarray:
    """One row of square-rooted n-gram shares for each text of the block."""
    b = _FOLD[block.data]
    if len(b) > 1:  # capital letters of Latin-1 behind their lead byte
        up = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
        b[1:][up] += 32
    doc = np.repeat(np.arange(block.n, dtype=np.int64) * DIMS, np.diff(block.off))
    wide = b.astype(np.uint32)
    pair = (wide[:-1] << np.uint32(8)) | wide[1:]
    two = (pair * np.uint32(2654435761)) >> np.uint32(32 - BITS2)
    three = (((pair[:-1] << np.uint32(8)) | wide[2:]) * np.uint32(2246822519)) >> np.uint32(32 - BITS3) if len(b) > 2 else np.zeros(0, np.uint32)
    out = np.zeros(block.n * DIMS, np.int64)
    for gram, n, base in ((b, 1, 0), (two, 2, 256), (three, 3, 256 + (1 << BITS2))):
        count = max(0, len(b) - n + 1)
        same = doc[:count] == doc[n - 1 :][:count]  # no n-gram runs over two texts
        out += np.bincount((doc[:count] + gram[:count].astype(np.int64) + base)[same], minlength=len(out))
    out = out.reshape(block.n, DIMS).astype(np.float32)
    total = out.sum(1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


@dataclass
class Model:
    families: list[list[str]]
    #: A row of weights (bias last) for each family, then one for each pair within a family.
    weights: np.ndarray
    pairs: list[tuple[int, int, int]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each row of ``features``."""
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        n = len(self.families)
        top = margin[:, :n].argmax(1)
        e = np.exp(4 * (margin[:, :n] - margin[:, :n].max(1, keepdims=True)))
        p_family = e[np.arange(len(x)), top] / e.sum(1)
        lang, score = np.empty(len(x), object), np.zeros(len(x))
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(top == f)
            votes, sure = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for k, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    m = margin[rows, n + k]
                    votes[:, a] += m >= 0
                    votes[:, b] += m < 0
                    sure[:, a] += logistic(4 * m)
                    sure[:, b] += logistic(-4 * m)
            best = (votes + sure / (len(members) + 1)).argmax(1) if len(rows) else rows
            lang[rows] = np.array(members, object)[best]
            score[rows] = p_family[rows] * (sure[np.arange(len(rows)), best] / (len(members) - 1) if len(members) > 1 else 1)
        return lang, np.clip(score, 0, 1)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, families: dict = FAMILIES) -> Model | None:
    """The model of ``labelled`` (doc_id, text, lang); None without a labelled row.

    The sample crosses to the driver as one Arrow table of compressed rows, which
    become half-precision ones of 2 * DIMS bytes each there (34 MB for 2000), and
    all machines are fitted on the rows' inner products, so the driver holds one
    copy of it and never a wider one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column(0)):
                x = features(block).astype(np.float16)
                part = batch.slice(at, block.n)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary())], ["lang", "sample_key", "x"])

    sample = bounded_sample(labelled.where(F.col("text").rlike(r"\p{L}")), "lang", sample_rows, 0.7)
    got = sample.select("text", "lang", "sample_key").mapInArrow(rows, "lang string, sample_key long, x binary").toArrow()
    if not got.num_rows:
        return None
    order = pc.sort_indices(got.select(["lang", "sample_key"]), [("lang", "ascending"), ("sample_key", "ascending")]).to_numpy()
    lang = np.array(got.column("lang").to_pylist(), object)[order]
    # rows are copied once, to their places; Arrow's copy goes, and its pool gives the memory back, before the fit
    x, place = np.empty((len(lang), DIMS), np.float16), np.empty(len(lang), np.int64)
    place[order] = np.arange(len(lang))
    for at, row in zip(place, got.column("x"), strict=True):
        x[at] = np.frombuffer(zlib.decompress(row.as_buffer()), np.float16)
    del got, row
    pa.default_memory_pool().release_unused()
    products = gram(x)
    home = {code: name for name, codes in families.items() for code in codes}
    by_family: dict[str, list[str]] = {}
    for code in sorted(set(lang)):
        by_family.setdefault(home.get(code, code), []).append(code)
    groups, weights, pairs = list(by_family.values()), [], []
    for members in groups:
        y = np.where(np.isin(lang, members), 1.0, -1.0)
        weights.append(weigh(x, linear_svm(products, y)) if len(groups) > 1 else np.zeros(DIMS + 1))
    for f, members in enumerate(groups):
        for i in range(len(members)):
            for j in range(i + 1, len(members)):
                at = np.flatnonzero((lang == members[i]) | (lang == members[j]))
                parts = linear_svm(products[np.ix_(at, at)], np.where(lang[at] == members[i], 1.0, -1.0))
                weights.append(weigh(x[at], parts))
                pairs.append((f, i, j))
    return Model(groups, np.array(weights, np.float32), pairs)


def annotate(documents: DataFrame, model: Model | None = None, sample_rows: int = SAMPLE_ROWS, to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``documents`` with the predicted language and its score in the columns ``to``, which replace columns of those
    names; without ``model`` one is fitted on its own labelled rows, as ``identify`` does."""
    if model is None:
        model = fit(documents.where((id_bucket("doc_id", 4) != 2) & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), sample_rows)
    rows = documents.drop(*to)
    if model is None:
        return rows.withColumns({to[0]: F.lit("und"), to[1]: F.lit(0.0)})
    # columns go by number while they are in Python, so that any name will do
    names, place = rows.columns, [c.lower() for c in rows.columns].index("text")
    rows = rows.toDF(*[f"c{i}" for i in range(len(names))])
    kinds = rows.schema
    rows = rows.withColumn("letter", F.coalesce(F.col(f"c{place}").rlike(r"\p{L}"), F.lit(False)))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column(place)):
                part = batch.slice(at, block.n)
                lang, sure = shared.value.predict(features(block))
                none = ~np.asarray(part.column(part.num_columns - 1).to_numpy(zero_copy_only=False), bool)
                lang[none], sure[none] = "und", 0
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(sure)], [*part.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(score, StructType([*kinds.fields]).add("lang_pred", "string").add("score", "double")).toDF(*names, *to)


def identify(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from the rows whose id isn't in fold 2 of 4."""
    out = annotate(documents.select("doc_id", "text", "lang"), None, sample_rows)
    return out.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
