"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character classes, word
shapes and repetitions of the line itself and of the lines before and after it;
two neighbouring lines share a transition weight. Forward-backward gives each
line's probability of being good, and the mean over the lines, weighted by their
lengths, is the document's quality, which Platt scaling turns into the score.

Labels are of documents, so the labels of lines are hidden in training: a
document's label is a noisy report on each of its lines, wrong for a share of
them (``BAD_IN_GOOD``, ``GOOD_IN_BAD``). The likelihood of the reports is climbed
by its gradient, expected features given reports and text minus expected features
given the text alone, each from one forward-backward pass. So a good document may
hold bad lines, and the transitions are learned from how lines change.

The model is fitted on the driver from about ``sample_rows`` different labelled
documents of ``sample_bytes`` in all at most, documented bounds, with whole
texts; scoring covers every line of every text, in Arrow batches. The chains of a
batch are multiplied up in parallel, by doubling, so a text of a million lines
takes twenty steps.

Defined results: a null or empty text is one empty line and gets the score of
that; without both labels in the sample every score is the share of good ones
(0.5 without any). Label rows without a document are left out; repeated rows are
scored alike; extra columns don't matter and empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, labelled_sample
from .linear import logistic, platt
from .textbytes import U64, Block, blocks, repeats

SAMPLE_ROWS, SAMPLE_BYTES = 1500, 64 << 20
#: How often a line of a good document is bad, and the other way round, as training supposes.
BAD_IN_GOOD, GOOD_IN_BAD = 0.1, 0.3
#: Shrinkage of the weights of a line's own features, of its neighbours' and of transitions.
L2 = (2e-5, 3e-2, 1e-1)


def _flags(*members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    for m in members:
        out[list(m)] = True
    return out


_CLASSES = (
    _flags(bytes(range(65, 91))),  # capitals
    _flags(bytes(range(97, 123)), bytes(range(128, 256))),  # small letters and all beyond ASCII
    _flags(bytes(range(48, 58))),
    _flags(b"#*$%&<>=_~^@\\/{}[]"),
    _flags(b"|"),
    _flags(b"!?"),
    _flags(b".,;:"),
)
#: Edges that cut a share into steps, and a length (in words) into steps.
_SHARES = (0.001, 0.02, 0.06, 0.15, 0.35, 0.6)
_LENGTHS = (1, 3, 6, 12, 25, 50, 100, 400)
#: One slot for each step of each measure: seven class shares, distinct words, repeated pairs, mean length, words.
_STEPS = [len(_SHARES) + 1] * 9 + [len(_LENGTHS) + 1] * 2
OWN = sum(_STEPS) + 1
DIMS = 3 * OWN


def line_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, length in bytes, slots) of each line; the slots are its own active features."""
    start, end, doc = block.lines()
    size = np.maximum(end - start, 1)
    w_start, w_end = block.words()
    line = np.searchsorted(start, w_start, "right") - 1
    # empty lines share a start with nothing: a word's line is the last one that starts at or before it
    n_words = np.bincount(line, minlength=len(start))
    measures = [block.counts(c[block.data], start, end) / size for c in _CLASSES]
    word = block.hashes(w_start, w_end)
    _, earlier = repeats(word, line)
    measures.append(np.bincount(line[earlier], minlength=len(start)) / np.maximum(n_words, 1))
    pair = word[:-1] * U64(0x9E3779B97F4A7C15) + word[1:] if len(word) > 1 else np.zeros(0, U64)
    same = line[:-1] == line[1:] if len(word) > 1 else np.zeros(0, bool)
    _, earlier = repeats(pair[same], line[:-1][same] if len(word) > 1 else np.zeros(0, np.int64))
    of = line[:-1][same][earlier] if len(word) > 1 else np.zeros(0, np.int64)
    measures.append(np.bincount(of, minlength=len(start)) / np.maximum(n_words, 1))
    mean = np.bincount(line, w_end - w_start, len(start)) / np.maximum(n_words, 1)
    slots, base = np.empty((len(start), len(_STEPS) + 1), np.int64), 0
    for k, m in enumerate([*measures, mean, n_words]):
        slots[:, k] = base + np.searchsorted(_SHARES if k < 9 else _LENGTHS, m, "right")
        base += _STEPS[k]
    heard, _ = repeats(block.hashes(start, end), doc)
    slots[:, -1] = np.where(heard & (n_words > 0), base, slots[:, 0])  # a line of which the text has another copy
    return doc, end - start, slots


def _emissions(slots: np.ndarray, first: np.ndarray, last: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-odds of good for each line, from itself and its neighbours in the text."""
    own, before, after = (w[k * OWN : (k + 1) * OWN][slots].sum(1) for k in range(3))
    out = own.copy()
    out[1:] += np.where(first[1:], 0, before[:-1])
    out[:-1] += np.where(last[:-1], 0, after[1:])
    return out


def _products(m: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Running products of the 2 x 2 matrices from the last open place on, each scaled to a greatest entry of 1."""
    out, step = m / m.max((1, 2), keepdims=True), 1
    since = np.arange(len(m)) - np.maximum.accumulate(np.where(opens, np.arange(len(m)), 0))
    while True:
        at = np.flatnonzero(since >= step)
        if not len(at):
            return out
        new = np.einsum("nij,njk->nik", out[at - step], out[at])
        out[at] = new / new.max((1, 2), keepdims=True)
        step *= 2


def chains(first: np.ndarray, last: np.ndarray, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and P(previous, this) as 2 x 2 for each line (of no meaning for first lines).

    emit: log-odds of good; trans: 2 x 2 weights, bad first; first, last: the ends of each text.
    """
    weight = np.exp(np.stack([-np.maximum(emit, 0), np.minimum(emit, 0)], 1).clip(-60, 0))  # of bad and good
    move = np.exp(trans - trans.max())
    m = move * weight[:, None, :]
    m[first] = weight[first][:, None, :]  # any row of a product is then the forward vector
    alpha = _products(m, first)[:, 0]
    back = np.where(last[:, None, None], 1.0, np.roll(m, -1, 0))[::-1]  # read from behind, matrices turned round
    beta = _products(np.ascontiguousarray(back.transpose(0, 2, 1)), last[::-1])[::-1, 0]
    both = alpha * beta
    pairs = np.roll(alpha, 1, 0)[:, :, None] * move * (weight * beta)[:, None, :]
    return both[:, 1] / both.sum(1), pairs / pairs.sum((1, 2), keepdims=True)


def _ends(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    return first, np.append(first[1:], True)


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    def lines(self, doc, slots) -> np.ndarray:
        """P(good) of each line."""
        first, last = _ends(doc)
        return chains(first, last, _emissions(slots, first, last, self.weights), self.trans)[0]

    def quality(self, doc, size, slots) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, for each text."""
        weight = size + 1.0  # the line feed counts, so empty lines do too
        return np.bincount(doc, self.lines(doc, slots) * weight) / np.bincount(doc, weight)

    def score(self, doc, size, slots) -> np.ndarray:
        return logistic(self.slope * (self.quality(doc, size, slots) - 0.5) + self.shift)


def train(doc, size, slots, y, steps: int = 150, l2: tuple[float, float, float] = L2, noise: tuple[float, float] = (BAD_IN_GOOD, GOOD_IN_BAD)) -> Model:
    """Maximises the likelihood of the documents' labels as reports on hidden line labels, both labels weighing the same."""
    first, last = _ends(doc)
    label = y[doc].astype(int)
    report = np.where(label > 0, np.log((1 - noise[0]) / noise[1]), np.log(noise[0] / (1 - noise[1])))
    share = np.where(label > 0, 0.5 / max(1, (label > 0).sum()), 0.5 / max(1, (label == 0).sum()))
    w, trans = np.zeros(DIMS), np.zeros((2, 2))
    m, v = np.zeros(DIMS + 4), np.zeros(DIMS + 4)
    cols = slots.shape[1]
    shrink = np.repeat(l2, [OWN, 2 * OWN, 4])
    for step in range(1, steps + 1):
        emit = _emissions(slots, first, last, w)
        free, free_pairs = chains(first, last, emit, trans)
        told, told_pairs = chains(first, last, emit + report, trans)
        error = (told - free) * share
        grad = np.zeros(DIMS)
        grad[:OWN] = np.bincount(slots.ravel(), np.repeat(error, cols), OWN)
        grad[OWN : 2 * OWN] = np.bincount(slots[:-1].ravel(), np.repeat(np.where(first[1:], 0, error[1:]), cols), OWN)
        grad[2 * OWN :] = np.bincount(slots[1:].ravel(), np.repeat(np.where(last[:-1], 0, error[:-1]), cols), OWN)
        turn = ((told_pairs - free_pairs) * np.where(first, 0, share)[:, None, None]).sum(0)
        g = np.concatenate([grad, turn.ravel()]) - shrink * np.concatenate([w, trans.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, trans = w + move[:-4], trans + move[-4:].reshape(2, 2)
    model = Model(w, trans, 1.0, 0.0)
    q = model.quality(doc, size, slots)
    slope, shift = platt(q - 0.5, y)
    return Model(w, trans, slope, shift)


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | float:
    """The model, or the constant score where a label is missing."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column(0)):
                doc, size, slots = line_features(block)
                place = np.searchsorted(doc, np.arange(block.n + 1))
                lines = [slots[a:b].astype(np.uint8).tobytes() for a, b in zip(place, place[1:])]
                sizes = [size[a:b].astype(np.int32).tobytes() for a, b in zip(place, place[1:])]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, block.n) for c in batch.columns[1:]), pa.array(sizes, pa.binary()), pa.array(lines, pa.binary())], ["quality", "sample_key", "sizes", "slots"])

    marked = labels.where("quality in (0, 1) and doc_id is not null").where(id_bucket("doc_id", 3) != 1).select("doc_id", F.col("quality").cast("int").alias("quality"))
    # no text takes more than a hundredth of the bound, and if all together are too long, fewer rows are drawn
    chosen = labelled_sample(documents, marked, "quality", sample_rows, 0.7).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes // 100)
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > sample_bytes:
        chosen = chosen.where(F.pmod(F.col("sample_key"), F.lit(1 << 20)) < int((1 << 20) * sample_bytes / size))
    got = chosen.select("text", "quality", "sample_key").mapInArrow(rows, "quality int, sample_key long, sizes binary, slots binary").toArrow()
    got = got.sort_by([("quality", "ascending"), ("sample_key", "ascending")])
    y = got.column("quality").to_numpy()
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    sizes = [np.frombuffer(r.as_buffer(), np.int32) for r in got.column("sizes")]
    slots = np.frombuffer(b"".join(r.as_py() for r in got.column("slots")), np.uint8).reshape(-1, len(_STEPS) + 1).astype(np.int64)
    doc = np.repeat(np.arange(len(y)), [len(s) for s in sizes])
    return train(doc, np.concatenate(sizes), slots, y)


def predict(documents: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column(1)):
                m = shared.value
                p = np.full(block.n, m) if isinstance(m, float) else m.score(*line_features(block))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, block.n), pa.array(p)], ["doc_id", "score"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def classify(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted; learns from labels whose id isn't in fold 1 of 3."""
    out = predict(documents, fit(documents, labels, sample_rows))
    return out.select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
