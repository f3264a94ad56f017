"""Near-duplicate detection with BagMinHash over multisets of five-word shingles.

Each shingle owns Poisson processes over a dyadic division of its weight axis,
(0, 1], (1, 2], (2, 4], ...; a process runs at a rate of its interval's length
for each signature component. An interval longer than a unit is split at its
first point: the half that holds the point keeps it, the other half is a process
of half the rate that goes on from there, and halves above the shingle's weight
are dropped, so the same hierarchy serves all weights. Component values are the
first points, so two documents agree on a component with the probability of
their weighted Jaccard similarity. Points are drawn in ascending order and only
up to the level that all components of the document reach, so the work grows with
the signature, not with the weights.

Bands of components put documents into buckets. Documents with equal multisets
are one node first. In each turn a few hash-chosen leaders of every bucket are
compared, by the exact weighted Jaccard similarity of the multisets, with all
nodes of the bucket that aren't in their class yet; links merge classes by label
propagation. Leaders have met their whole bucket and leave it, and a bucket ends
when its nodes are of one class. So a group of thousands of copies ends after a
turn or two, every two nodes of a bucket are compared, known to be of one class or
known to be too different, and as the leaders multiply there are few turns.

Documents around a large group, below the threshold to most of it, would still meet
all of it. So after the first turn the nodes of unfinished buckets meet over rare
shingles instead: to be similar enough, two nodes must share weight, and with
shingles in one order for all nodes, rarest first, each must hold a common one
before the weight that is left in it falls below that. Shingles of one class alone
come first of all. And each node has a parity sketch: every copy of a shingle flips
one of its bits, so the bits in which two sketches differ are a lower bound of the
weight that only one of the two has; where that is too much, the pair isn't made.
A sketch has two to four bits a shingle, as one that is nearly full of flips shows
nothing, and the longer of two is folded onto the shorter. Pairs once found too
different aren't compared in later turns. All this is exact: no pair of a bucket
that could be a link is dropped.

With 24 bands of 5 components a pair of similarity 0.8 shares a bucket with
probability 0.9999, a pair of 0.9 with 1 - 1e-9.

Defined results: texts without a word (null and empty ones too) are each a class
of their own; a text of fewer than five words has one shingle of all its words;
words are compared exactly as written. Rows with equal texts share a class
whatever their ids; class_id is the smallest doc_id (null only if all are null),
and one row of it is kept, however often an id or a row is repeated. Empty tables
give no rows; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, salted_join, small_batches
from .textbytes import U64, Block, blocks, mix

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Leaders of a bucket in the first turn, and their growth from turn to turn.
FIRST_LEADERS, GROWTH = 1, 16
#: The least length of a node's parity sketch in longs; it doubles until there are two bits for each shingle.
PARITY_LONGS = 16

_STEP = U64(0x9FB21C651E98DF25)
_LEVEL = U64(0xA0761D6478BD642F)
_HALF = U64(0xE7037ED1A0B428DB)
_SIDES = _HALF * np.arange(1, 3, dtype=U64)


def shingles(block: Block, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, weight) of each distinct shingle of each text, texts ascending."""
    start, end = block.words()
    word = block.hashes(start, end)
    first = np.searchsorted(start, block.off)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(block.n), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    hashed = np.zeros(len(doc), U64)
    room = np.repeat(np.minimum(n, width), count)
    for k in range(width):
        inside = k < room
        hashed = hashed * U64(0x9E3779B97F4A7C15) + np.where(inside, word[np.minimum(at + k, max(len(word) - 1, 0))] if len(word) else U64(0), U64(k + 1))
    hashed = mix(hashed)
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
    places = np.flatnonzero(new)
    return doc[places], hashed[places], np.diff(np.append(places, len(doc)))


def _uniform(draw: np.ndarray) -> np.ndarray:
    return ((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _leaves(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, bound: np.ndarray, size: int, out: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, seed, start) of the unit processes of items, of which those within ``bound`` are final from ``start`` on.

    An octave (2**(j-1), 2**j] of the weight axis is one process. Its first point falls into one half; the process is
    then split, that half keeps the point, the other one goes on from there at half the rate, and so on down to units.
    A half above the item's weight is dropped. Points that arrive at a unit are entered into ``out`` at once.
    """
    reach = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    of = np.repeat(np.arange(len(doc)), reach + 1)
    octave = np.arange(len(of)) - np.repeat(np.cumsum(reach + 1) - (reach + 1), reach + 1)
    length = np.where(octave > 1, 1 << np.maximum(octave - 1, 0), 1)
    low = np.where(octave > 0, length, 0)
    seed = mix(item[of] + octave.astype(U64) * _LEVEL)
    text, room, x = doc[of], weight[of], np.zeros(len(of))
    done = [(text[length == 1], seed[length == 1], x[length == 1])]
    # processes still to be split: x is where a process goes on, or its first point where it has one (part >= 0)
    keep = length > 1
    text, seed, room, low, length, x = (v[keep] for v in (text, seed, room, low, length, x))
    part = np.full(len(text), -1)
    while len(text):
        draw = mix(seed + _STEP)
        new = part < 0
        x = np.where(new, x - np.log(_uniform(draw)) / (size * length), x)
        part = np.where(new, ((mix(draw ^ _LEVEL) >> U64(40)) % U64(size)).astype(np.int64), part)
        live = x <= bound[text]
        text, seed, room, low, length, x, part, draw = (v[live] for v in (text, seed, room, low, length, x, part, draw))
        half = length >> 1
        upper = (mix(seed ^ _HALF) & U64(1)).astype(bool)  # the half that the point falls into
        sides = [(side, upper == bool(side)) for side in (0, 1)]
        text, seed, room, low, x, part, length = (
            np.concatenate(v)
            for v in zip(*((text, mix(seed + _SIDES[side]), room, low + side * half, x, np.where(hit, part, -1), half) for side, hit in sides))
        )
        below = low < room
        text, seed, room, low, x, part, length = (v[below] for v in (text, seed, room, low, x, part, length))
        unit = length == 1
        point = unit & (part >= 0)
        np.minimum.at(out, text[point] * size + part[point], x[point])
        done.append((text[unit], seed[unit], x[unit]))
        text, seed, room, low, x, part, length = (v[~unit] for v in (text, seed, room, low, x, part, length))
    return tuple(np.concatenate(v) for v in zip(*done))


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """BagMinHash values, n_docs x size, of weighted items; infinite where a document has none."""
    out = np.full(n_docs * size, np.inf)
    total = np.bincount(doc, weight, n_docs)
    todo = np.flatnonzero(total > 0)
    bound = np.full(n_docs, np.inf)
    bound[todo] = (np.log(size) + 3) / total[todo]
    while len(todo):
        chosen = np.zeros(n_docs, bool)
        chosen[todo] = True
        mine = chosen[doc]
        text, seed, x = _leaves(doc[mine], item[mine], weight[mine], bound, size, out)
        turn = 0
        while len(text):
            width = int(min(64, max(1, 16384 // len(text))))
            turns = np.arange(turn + 1, turn + width + 1, dtype=U64)
            draw = mix(seed[:, None] + turns * _STEP)
            step = -np.log(_uniform(draw)) / size
            step[:, 0] += x
            points = np.cumsum(step, 1)
            part = (mix(draw ^ _LEVEL) >> U64(40)) % U64(size)
            row, col = np.nonzero(points <= bound[text][:, None])
            np.minimum.at(out, text[row] * size + part[row, col].astype(np.int64), points[row, col])
            on = points[:, -1] <= bound[text]
            text, seed, x, turn = text[on], seed[on], points[on, -1], turn + width
        short = np.isinf(out.reshape(n_docs, size)[todo]).any(1)
        todo = todo[short]
        bound[todo] *= 2
    return out.reshape(n_docs, size)


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = values.astype(np.float32).view(np.uint32).astype(U64).reshape(len(values), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (len(values), bands)).copy()
    for k in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return key


def content_keys(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the multiset: two sums of independent hashes."""
    out = []
    for salt in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35):
        term = mix(item + U64(salt)) * (mix(weight.astype(U64) + U64(salt)) | U64(1))
        sums = np.zeros(n_docs, U64)
        np.add.at(sums, doc, term)
        out.append(mix(sums).view(np.int64))
    return out[0], out[1]


def parities(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, longs: int = PARITY_LONGS) -> np.ndarray:
    """n_docs x longs: each copy of each item flips one bit of its text's sketch. Bits that differ between two sketches
    were flipped by copies that one text has more of, so they are no more than those."""
    of = np.repeat(np.arange(len(doc)), weight)
    copy = np.arange(len(of)) - np.repeat(np.cumsum(weight) - weight, weight)
    bit = (mix(item[of] + copy.astype(U64) * _STEP) >> U64(20)).astype(np.int64) % (64 * longs)
    flips = np.bincount(doc[of] * (64 * longs) + bit, minlength=n_docs * 64 * longs) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n_docs, -1), axis=1, bitorder="little").view(np.int64)


def sketches(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int) -> pa.Array:
    """The parity sketch of each text, of a length that fits its size."""
    total = np.maximum(np.bincount(doc, weight, n_docs), 1)
    longs = PARITY_LONGS << np.maximum(0, np.ceil(np.log2(total / (32 * PARITY_LONGS)))).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(longs)])
    out = np.zeros(off[-1], np.int64)
    for length in np.unique(longs):
        mine = longs == length
        rows = mine[doc]
        place = (np.cumsum(mine) - 1)[doc[rows]]
        values = parities(place, item[rows], weight[rows], int(mine.sum()), int(length))
        out[off[:-1][mine][:, None] + np.arange(length)] = values
    return pa.ListArray.from_arrays(off.astype(np.int32), out)


def _text_keys() -> list[Column]:
    """t1 and t2: 128 bits that name the text."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def sign(documents: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """row, doc_id, t1, t2 (128 bits of the text), k1, k2 (null without a word), the number of shingles, the band keys
    and the parity sketch of every row."""

    def lists(values: np.ndarray) -> pa.Array:
        n, width = values.shape
        return pa.ListArray.from_arrays(np.arange(0, (n + 1) * width, width, dtype=np.int32), values.reshape(-1).view(np.int64))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column(0)):
                doc, item, weight = shingles(block, width)
                k1, k2 = content_keys(doc, item, weight, block.n)
                keys = band_keys(signatures(doc, item, weight, block.n, bands * rows), bands, rows)
                total = np.bincount(doc, weight, block.n).astype(np.int64)
                none = total == 0
                cols = [c.slice(at, block.n) for c in batch.columns[1:]] + [pa.array(k1, mask=none), pa.array(k2, mask=none), pa.array(total), lists(keys), sketches(doc, item, weight, block.n)]
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "t1", "t2", "k1", "k2", "size", "bands", "parity"])

    rows_in = documents.select("text", F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *_text_keys())
    return rows_in.mapInArrow(signed, "row long, doc_id long, t1 long, t2 long, k1 long, k2 long, size long, bands array<long>, parity array<long>")


def _texts(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text, once, of each of ``nodes`` (node, t1, t2). Ids play no part, so null and repeated ones do no harm,
    and copies of a text are one before they are shuffled."""
    here = documents.where("text is not null").select(*_text_keys(), "text").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    return here.join(nodes, ["t1", "t2"]).select("node", "text")


def _rare(live: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """node, place, size, label, parity and bucket: the rare shingles over which ``live`` nodes (node, place, size, label,
    parity and low, the least size of a node that they have yet to meet) must meet all others that can be similar enough."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column("text")):
                doc, item, weight = shingles(block, width)
                of = batch.slice(at, block.n).select(["node", "label", "slack"]).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([*of.columns, pa.array(item.view(np.int64)), pa.array(weight)], ["node", "label", "slack", "item", "weight"])

    need = F.lit(similarity / (1 + similarity) * (1 - 1e-9)) * (F.col("size") + F.greatest(F.col("low"), F.lit(similarity) * F.col("size")))
    rows = live.select("node", "label", (F.col("size") - need).alias("slack")).join(texts, "node").select("node", "label", "slack", "text")
    rows = materialise(rows.mapInArrow(listed, "node long, label long, slack double, item long, weight long"), "near-shingles")
    often = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
    often = often.select("item", F.when(F.col("a") < F.col("b"), F.col("n")).otherwise(0).alias("n"))
    before = Window.partitionBy("node").orderBy("n", "item").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.drop("label").join(often, "item").withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    held = held.where("before <= slack and n > 0").select("node", F.col("item").alias("bucket"))
    return held.join(live.drop("low"), "node")


def _flips(a: str, b: str) -> Column:
    """How many bits of two sketches differ, when the longer one is folded onto the shorter; null where one is more than
    twice as long as the other, and so too long for the pair to be similar."""

    def folded(x: str, to: Column) -> Column:
        halves = F.zip_with(F.slice(x, F.lit(1), to), F.slice(x, to + 1, to), lambda v, w: v.bitwiseXOR(w))
        return F.when(F.size(x) > to, halves).otherwise(F.col(x))

    both = F.zip_with(folded(a, F.size(b)), folded(b, F.size(a)), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.when(F.greatest(F.size(a), F.size(b)) <= 2 * F.least(F.size(a), F.size(b)), F.aggregate(both, F.lit(0), lambda n, x: n + x))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """``pairs`` (node, leader) and whether their exact weighted Jaccard similarity is ``similarity`` or more (alike)."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            leaders = batch.column("leader").to_numpy()
            for at, block in blocks(batch.column("text")):
                doc, item, weight = shingles(block, width)
                place = np.searchsorted(doc, np.arange(block.n + 1))
                for i in range(block.n):
                    if leaders[at + i] != last:
                        last = leaders[at + i]
                        _, own = next(blocks(batch.column("leader_text").slice(at + i, 1)))
                        known = shingles(own, width)[1:]
                    a, wa = item[place[i] : place[i + 1]], weight[place[i] : place[i + 1]]
                    b, wb = known
                    spot = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    both = np.minimum(wa, wb[spot])[b[spot] == a].sum()
                    keep[at + i] = both >= similarity * (wa.sum() + wb.sum() - both) * (1 - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("leader"), pa.array(keep)], ["node", "leader", "alike"])

    rows = pairs.join(texts, "node").join(texts.selectExpr("node as leader", "text as leader_text"), "leader")
    return rows.select("node", "leader", "text", "leader_text").mapInArrow(alike, "node long, leader long, alike boolean")


def classes(links: DataFrame) -> DataFrame:
    """node and label (the smallest node) of each connected component; ``links``: node, leader."""
    both = materialise(links.unionByName(links.selectExpr("leader as node", "node as leader")), "near-links")
    labels = both.groupBy("node").agg(F.min("leader").alias("m")).select("node", F.least("node", "m").alias("label"))
    while True:
        heard = both.join(labels.selectExpr("node as leader", "label as other"), "leader").groupBy("node").agg(F.min("other").alias("other"))
        near = labels.join(heard, "node").select("node", "label", F.least("label", "other").alias("low"))
        jump = labels.selectExpr("node as low", "label as far")
        new = near.join(jump, "low").select("node", F.least("low", "far").alias("new"), "label")
        new = materialise(new, "near-labels")
        changed = not new.where("new < label").isEmpty()
        labels = new.selectExpr("node", "new as label")
        if not changed:
            return labels


def _classed(documents: DataFrame, **options) -> DataFrame:
    with small_batches(documents.sparkSession):  # all that runs in Python is written inside
        return _classes_of(documents, **options)


def _classes_of(documents: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """row, doc_id, t1, t2, worded and node of every row of ``documents``: rows of one node are one class."""
    signed = materialise(sign(documents, bands, rows, width), "near-signatures")
    known = signed.where("k1 is not null")
    groups = known.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("t1").alias("t1"), F.min_by("t2", "t1").alias("t2"), F.count(F.lit(1)).alias("copies"))
    groups = materialise(groups, "near-nodes")

    firsts = signed.join(groups.selectExpr("node as row"), "row", "left_semi")
    sketches = signed.selectExpr("row as node", "parity")
    members = firsts.select(F.col("row").alias("node"), F.xxhash64("k1", "k2").alias("place"), "size", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = materialise(members.join(shared, "bucket"), "near-buckets")
    texts = materialise(_texts(documents, groups.join(members.select("node").distinct(), "node").select("node", "t1", "t2")), "near-texts")

    labels, refused, leaders = None, None, FIRST_LEADERS
    while True:
        now = members.withColumn("label", F.col("node"))
        if labels is not None:
            now = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        if leaders == FIRST_LEADERS * GROWTH:
            lows = now.groupBy("bucket").agg(F.min("size").alias("low"), F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
            live = now.join(lows.select("bucket", "low"), "bucket").groupBy("node", "place", "size", "label").agg(F.min("low").alias("low"))
            live = materialise(live.join(sketches, "node"), "near-live")
            now = materialise(_rare(live, texts, similarity, width), "near-buckets")
        of = now.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
        share = (F.lit(float(leaders)) / F.col("n")) * F.lit(2.0**64) - F.lit(2.0**63)
        bound = F.when(F.col("n") <= leaders, F.lit((1 << 63) - 1)).otherwise(F.greatest("least", F.floor(F.when(F.col("n") > leaders, share)).cast("long")))
        now = now.join(of.select("bucket", bound.alias("bound")), "bucket").withColumn("leads", F.col("place") <= F.col("bound"))
        now = materialise(now.drop("bound"), "near-buckets")
        if now.isEmpty():
            break
        lead = now.where("leads").select("bucket", *[F.col(c).alias(f"lead_{c}") for c in now.columns if c not in ("bucket", "bound", "leads")])
        later = (F.col("place") > F.col("lead_place")) | ((F.col("place") == F.col("lead_place")) & (F.col("node") > F.col("lead_node")))
        near = F.least("size", "lead_size") >= F.lit(similarity * (1 - 1e-9)) * F.greatest("size", "lead_size")
        if "parity" in now.columns:
            near = near & (_flips("parity", "lead_parity") <= F.lit((1 - similarity) / (1 + similarity) * (1 + 1e-9)) * (F.col("size") + F.col("lead_size")))
        pairs = now.join(lead, "bucket").where((F.col("label") != F.col("lead_label")) & near & (~F.col("leads") | later)).select("node", F.col("lead_node").alias("leader"))
        pairs = pairs.withColumns({"low": F.least("node", "leader"), "high": F.greatest("node", "leader")}).dropDuplicates(["low", "high"])
        if refused is not None:
            pairs = pairs.join(refused, ["low", "high"], "left_anti")
        compared = materialise(_verified(pairs, texts, similarity, width), "near-compared")
        found = compared.where("alike").select("node", "leader")
        different = compared.where("not alike").select(F.least("node", "leader").alias("low"), F.greatest("node", "leader").alias("high"))
        refused = different if refused is None else refused.unionByName(different)
        if not found.isEmpty():
            # the classes so far are links to their labels
            labels = classes(found if labels is None else found.unionByName(labels.selectExpr("node", "label as leader")))
        members = now.where("not leads").drop("label", "leads")
        leaders *= GROWTH

    named = salted_join(signed.where("k1 is not null"), groups.select("k1", "k2", "node", F.col("copies").alias("n")), ["k1", "k2"]).drop("n")
    named = named.select("row", "doc_id", "t1", "t2", F.lit(True).alias("worded"), "node")
    if labels is not None:
        # classes are of different texts, and a text's own copies may be many
        of_node = groups.selectExpr("node", "copies as n").join(labels, "node")
        named = salted_join(named, of_node, ["node"], outer=True).withColumn("node", F.coalesce("label", "node")).drop("label", "n")
    alone = signed.where("k1 is null").select("row", "doc_id", "t1", "t2", F.lit(False).alias("worded"), F.col("row").alias("node"))
    return materialise(named.unionByName(alone), "near-classed")


def _kept(classed: DataFrame) -> DataFrame:
    """node, class_id, class_size (also as n) and the row that stays of each class: of the smallest doc_id, then text."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2", "row")
    of = classed.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(first).alias("first"))
    return of.select("node", "class_id", "class_size", F.col("class_size").alias("n"), "first")


def near_classes(documents: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, class_size and kept of every row of ``documents``; one row of each class is kept."""
    classed = _classed(documents, **options)
    rows = salted_join(classed, _kept(classed), ["node"])
    return rows.select("doc_id", "class_id", "class_size", (F.col("row") == F.col("first.row")).alias("kept"))


def near_dedup(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that stay, with their columns: one row of each class, rows without a word among them.

    A kept row is found again by its id and the 128 bits of its text. Where that pair is repeated, as equal rows are,
    the rows are ranked and one stays; texts without a word all stay.
    """
    classed = _classed(documents, **options)
    first = _kept(classed).select("node", "first.*")
    key = ["__t1", "__t2", "__no_id", "__id"]
    keyed = lambda df: df.select(F.col("t1").alias(key[0]), F.col("t2").alias(key[1]), F.col("doc_id").isNull().alias(key[2]), F.coalesce("doc_id", F.lit(0)).alias(key[3]))
    repeated = keyed(classed.where("worded")).groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    wanted = materialise(keyed(first.join(classed.where("not worded").select("row"), "row", "left_anti")).join(repeated, key), "near-kept")
    # the rows' own columns travel as one, so that their names can't meet those used here
    t1, t2 = _text_keys()
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    wordless = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = documents.select(row.alias("__in"), t1.alias(key[0]), t2.alias(key[1]), F.col("doc_id").isNull().alias(key[2]), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(key[3]), wordless.alias("__wordless"))
    out = rows.join(wanted.where("__n = 1").select(*key).hint("shuffle_hash"), key, "left_semi").select("__in").unionByName(rows.where("__wordless").select("__in"))
    several = wanted.where("__n > 1").select(*key)
    if not several.isEmpty():
        plain = [F.col("__in")[c] for c, kind in documents.dtypes if "map<" not in kind]
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*plain)))
        again = rows.join(several.hint("shuffle_hash"), key, "left_semi").withColumn("__nth", nth).where("__nth = 1").select("__in")
        out = out.unionByName(again)
    return out.select(*[F.col("__in")[c].alias(c) for c in documents.columns])
