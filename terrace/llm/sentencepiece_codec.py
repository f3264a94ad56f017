"""SentencePiece encoding by a streaming Viterbi search, and decoding.

``Viterbi`` takes a text from left to right. From each boundary it extends the
best path by all pieces that start there, so it looks ahead by the longest piece
at most; when all surviving backpointer paths meet in one boundary, the pieces
before it are final, are emitted and forgotten. A text without a single space
needs no more memory than its undecided end.

What the best path is depends on the model. In a unigram model it has the
greatest sum of piece scores; of equal ones the longest last piece wins. In a
model of merges (BPE, as the public file at MODEL) a step from one piece to the
next is allowed only if merging the two pieces' own characters gives those two
pieces again. Exactly one path to each boundary consists of allowed steps, and it
is what merging the whole text gives, so the ids are those of SentencePiece itself.

Two neighbouring characters that no piece contains side by side are a sure
boundary whatever stands around them. ``Lanes`` cuts the texts of a batch there
and runs the same search over all distinct short stretches between the cuts in
step, with numpy; stretches above ``LANE_CHARS`` characters go through ``Viterbi``.

The vocabulary (pieces, scores, byte pieces) is read from a public model file on
the driver and broadcast: its size is that of the file, whatever the data. A
character outside the vocabulary becomes its UTF-8 bytes. As the model asks, one
space is put before the text.

Defined results: a null text has null ids and decodes to null; an empty text has
no ids. A literal U+2581, which SentencePiece itself would turn into a space, is
written as bytes, so decoding gives back every text exactly. Repeated rows are
encoded alike, extra columns are passed on by ``encode`` (its own ``ids`` replaces
a column of that name), empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .common import materialise, small_batches
from .textbytes import U64, _powers, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: The longest stretch that is searched in step with others.
LANE_CHARS = 64
#: Texts of about this many characters are encoded together and make one output batch.
BATCH_CHARS = 1 << 18
_PAIR_BITS = 20
#: Pairs of pieces whose step is remembered: so many in a fast table, so many at all.
_STEP_BITS, MEMO_STEPS = 20, 200_000


@dataclass
class Vocabulary:
    pieces: list[tuple[str, float, int]]  # text with plain spaces, score, id
    byte_ids: list[int]
    #: The bytes that each id stands for; control ids stand for none.
    surface: list[bytes]
    #: Is it a model of merges, else a unigram model.
    merges: bool = True
    _score: dict[str, float] = field(default_factory=dict)
    _text: dict[int, str] = field(default_factory=dict)
    _steps: dict[tuple[int, int], bool] = field(default_factory=dict)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], byte_ids: list[int], size: int, merges: bool = True) -> Vocabulary:
        surface = [b""] * size
        for text, _, k in pieces:
            surface[k] = text.encode()
        for value, k in enumerate(byte_ids):
            surface[k] = bytes([value])
        return cls(pieces, byte_ids, surface, merges, {t: score for t, score, _ in pieces}, {k: t for t, _, k in pieces})

    @classmethod
    def load(cls, model: str = MODEL, merges: bool = True) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        size = m.get_piece_size()
        plain = [k for k in range(size) if not (m.is_byte(k) or m.is_control(k) or m.is_unknown(k) or m.is_unused(k))]
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls.of([(m.id_to_piece(k).replace("▁", " "), m.get_score(k), k) for k in plain], byte_ids, size, merges)

    def merged(self, parts: list[str]) -> list[str]:
        """``parts`` after merging the neighbours of the highest score, the leftmost of equals, until none is a piece."""
        parts = list(parts)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = self._score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, left: int, right: int) -> bool:
        """May piece ``right`` follow piece ``left`` (-1: nothing or an unknown character)?"""
        if not self.merges:
            return True
        known = self._steps.get((left, right))
        if known is None:
            pair = [self._text[k] for k in (left, right) if k >= 0]
            known = self.merged(list("".join(pair))) == pair
            if len(self._steps) >= MEMO_STEPS:
                self._steps.clear()
            self._steps[left, right] = known
        return known

    @property
    def longest(self) -> int:
        return max((len(t) for t, _, _ in self.pieces), default=1)

    @property
    def unknown(self) -> float:
        return min((s for _, s, _ in self.pieces), default=0.0) - UNKNOWN_PENALTY

    def trie(self) -> dict:
        """Nested dicts by character; a piece's (score, id) stands under None."""
        root: dict = {}
        for text, score, k in self.pieces:
            node = root
            for c in text:
                node = node.setdefault(c, {})
            node[None] = (score, k)
        return root


class Viterbi:
    """One text: ``feed`` it in parts of any size, each call returns the (characters, id) of the pieces that
    have become final, id -1 for an unknown character; ``finish`` returns the last ones."""

    def __init__(self, vocabulary: Vocabulary, trie: dict | None = None):
        self.v, self.trie = vocabulary, vocabulary.trie() if trie is None else trie
        self.unknown, self.longest = vocabulary.unknown, vocabulary.longest
        self.text = ""  # from the last commit on
        self.at = 0  # the boundary that is extended next
        self.score: list[float | None] = [0.0]
        self.back: list[tuple[int, int]] = [(0, -1)]  # (characters, id) of the last piece up to each boundary
        self.patience = 4 * self.longest
        self.widest = 0  # most characters held at once

    def feed(self, part: str, last: bool = False) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        self.text += part
        self.widest = max(self.widest, len(self.text))
        trie, unknown, longest = self.trie, self.unknown, self.longest
        while self.at < len(self.text) - (0 if last else longest):
            text, at, score, back = self.text, self.at, self.score, self.back
            base, before, node, n = score[at], back[at][1], trie, 0
            for c in text[at : at + longest]:
                node = node.get(c)
                if node is None:
                    break
                n += 1
                hit = node.get(None)
                if hit is not None and self.v.stands(before, hit[1]):
                    self._offer(at + n, base + (0 if self.v.merges else hit[0]), n, hit[1])
            if None not in trie.get(text[at], ()):
                self._offer(at + 1, base + unknown, 1, -1)
            self.at = at + 1
            reached = [b for b in range(at + 1, len(score)) if score[b] is not None]
            if len(reached) == 1 or self.at >= self.patience:
                out += self._commit(reached)
                self.patience = max(4 * longest, 2 * self.at)  # paths that never meet are followed back seldom
        return out

    def _offer(self, to: int, total: float, n: int, piece: int) -> None:
        score, back = self.score, self.back
        while len(score) <= to:
            score.append(None)
            back.append((0, -1))
        if score[to] is None or total > score[to]:
            score[to], back[to] = total, (n, piece)

    def _commit(self, ends: list[int]) -> list[tuple[int, int]]:
        """The pieces up to the boundary in which the best paths to all of ``ends`` meet."""
        ends = sorted(ends)
        while len(ends) > 1:
            end = ends.pop()
            before = end - self.back[end][0]
            if before not in ends:
                ends = sorted([*ends, before])
        meet, out = ends[0], []
        while ends[0] > 0:
            out.append(self.back[ends[0]])
            ends[0] -= self.back[ends[0]][0]
        if meet:
            base = self.score[meet]
            self.text, self.at = self.text[meet:], self.at - meet
            self.score = [None if s is None else s - base for s in self.score[meet:]]
            self.back = self.back[meet:]
        return out[::-1]

    def finish(self) -> list[tuple[int, int]]:
        out = self.feed("", True)
        return out + self._commit([len(self.text)])


class Lanes:
    """Encodes the texts of a batch together."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.trie = vocabulary, vocabulary.trie()
        self.longest, self.unknown = vocabulary.longest, vocabulary.unknown
        letters = sorted({c for t, _, _ in vocabulary.pieces for c in t})
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros(1 << _PAIR_BITS, bool)
        for t, _, _ in vocabulary.pieces:
            s = self.symbol[[ord(c) for c in t]]
            self.beside[self._pair(s[:-1], s[1:])] = True
        self._flatten(len(letters))
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32)
        self.step_key, self.step = np.full(1 << _STEP_BITS, -1, np.int64), np.zeros(1 << _STEP_BITS, bool)

    def _stands(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Vocabulary.stands`` of many pairs, through a table of one place for each slot."""
        key = ((left.astype(np.int64) + 1) << 32) | right
        slot = (mix(key.view(U64)) >> U64(64 - _STEP_BITS)).astype(np.int64)
        miss = np.flatnonzero(self.step_key[slot] != key)
        out = self.step[slot]
        if len(miss):
            asked, which = np.unique(key[miss], return_inverse=True)
            known = np.array([self.v.stands((k >> 32) - 1, k & 0xFFFFFFFF) for k in asked.tolist()], bool)
            out[miss] = known[which]
            self.step_key[slot[miss]], self.step[slot[miss]] = key[miss], known[which]
            late = self.step_key[slot[miss]] != key[miss]  # two pairs of one slot: the key that stayed sets the answer
            self.step[slot[miss][~late]] = known[which][~late]
        return out

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A slot for each pair of symbols; pairs may share one, which only means fewer cuts."""
        mixed = a.astype(np.uint32) * np.uint32(0x9E3779B1) + b.astype(np.uint32) * np.uint32(0x85EBCA6B)
        return (mixed ^ (mixed >> np.uint32(15))) & np.uint32((1 << _PAIR_BITS) - 1)

    def _flatten(self, letters: int) -> None:
        """The trie as arrays: the child of node n by symbol s is goes[base[n] + s] if owner[base[n] + s] == n."""
        nodes, piece, score = [self.trie], [-1], [0.0]
        edges: list[list[tuple[int, int]]] = []
        for node in nodes:  # grows meanwhile
            edges.append([])
            for c, child in node.items():
                if c is None:
                    score[len(edges) - 1], piece[len(edges) - 1] = child
                else:
                    edges[-1].append((int(self.symbol[ord(c)]), len(nodes)))
                    nodes.append(child)
                    piece.append(-1)
                    score.append(0.0)
        room = 4 * len(nodes) + 4 * letters + 4
        owner, goes, base = [-1] * (room + letters + 1), [0] * (room + letters + 1), [0] * len(nodes)
        free = crowded = letters + 1  # the first slot that may be free, and where to look for several at once
        for n in sorted(range(len(nodes)), key=lambda n: -len(edges[n])):
            if not edges[n]:
                base[n] = room  # nothing there is owned by n
                continue
            least, tries = min(s for s, _ in edges[n]), 0
            while owner[free] != -1:
                free += 1
            at = (free if len(edges[n]) == 1 else max(free, crowded)) - least
            while any(owner[at + s] != -1 for s, _ in edges[n]):
                at += 1
                tries += 1
            if tries > 30:
                crowded = at + least
            base[n] = at
            for s, child in edges[n]:
                owner[at + s], goes[at + s] = n, child
        self.owner, self.goes, self.base = (np.array(x, np.int32) for x in (owner, goes, base))
        self.piece, self.score = np.array(piece, np.int32), np.array(score)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, start of each text and the end)."""
        spaced = [" " + t if t else "" for t in texts]
        code = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.cumsum([0, *map(len, spaced)])
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(len(place), np.int64)
        symbol = self.symbol[code]
        cut = np.ones(len(code), bool)
        cut[1:] = ~self.beside[self._pair(symbol[:-1], symbol[1:])]
        cut[place[:-1][place[:-1] < len(code)]] = True
        start = np.flatnonzero(cut)
        size = np.diff(start, append=len(code))
        model, of = self._distinct(code, start, size)
        at, length = start[model], size[model]
        first = np.cumsum(length + 1) - (length + 1)  # a stretch of n characters has n + 1 boundaries
        best = np.full(int(length.sum()) + len(at), -np.inf)
        back, ids = np.zeros(len(best), np.int32), np.full(len(best), -1, np.int32)
        best[first] = 0
        self._search(symbol, at, length, first, best, back, ids)
        ends = np.zeros(len(best), bool)
        for k in np.flatnonzero(length > LANE_CHARS):
            search = Viterbi(self.v, self.trie)
            stretch = code[at[k] : at[k] + length[k]].tobytes().decode("utf-32-le", "surrogatepass")
            pieces = [p for i in range(0, len(stretch), 1024) for p in search.feed(stretch[i : i + 1024])] + search.finish()
            n, piece = np.array(pieces, np.int64).T
            to = first[k] + np.cumsum(n)
            ends[to], ids[to] = True, piece
        short = length <= LANE_CHARS
        now, origin = (first + length)[short], first[short]
        while len(now):
            ends[now] = True
            now = now - back[now]
            on = now > origin
            now, origin = now[on], origin[on]
        end = np.flatnonzero(ends)
        stretch = np.searchsorted(first, end, "right") - 1
        char = code[at[stretch] + end - first[stretch] - 1]  # the last character of each piece
        pieces = np.bincount(stretch, minlength=len(at))
        total = np.concatenate([[0], np.cumsum(pieces[of])])
        pick = np.repeat((np.cumsum(pieces) - pieces)[of] - total[:-1], pieces[of]) + np.arange(total[-1])
        flat, byte_total = self._spelt(ids[end][pick], char[pick])
        return flat, byte_total[total[np.searchsorted(start, place)]]

    @staticmethod
    def _distinct(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one stretch of each kind, the place of each stretch's kind in it); equal hashes are compared in full."""
        up, down = _powers(len(code) + 1)
        total = np.zeros(len(code) + 1, U64)
        np.cumsum(mix(code.astype(U64) + U64(0x51ED270B)) * up[:-1], out=total[1:])
        hashed = mix((total[start + size] - total[start]) * down[start] + size.astype(U64))
        _, model, of = np.unique(hashed, return_index=True, return_inverse=True)
        same = np.array_equal(size[model][of], size) and np.array_equal(code[np.repeat(start[model][of] - start, size) + np.arange(len(code))], code)
        return (model, of) if same else (np.arange(len(start)), np.arange(len(start)))

    def _search(self, symbol, start, size, first, best, back, ids) -> None:
        order = np.argsort(-size, kind="stable")
        order = order[np.searchsorted(-size[order], -LANE_CHARS) :]
        at, to, left = start[order], first[order], size[order]
        for s in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -s))  # stretches of more than s characters
            here, end, room = at[:live] + s, to[:live] + s, left[:live] - s
            base, before, node, n = best[end], ids[end], np.zeros(live, np.int32), 0
            alone = np.zeros(live, bool)
            while len(node):
                slot = self.base[node] + symbol[here + n]
                on = np.flatnonzero(self.owner[slot] == node)
                node, here, end, room, base, before = self.goes[slot[on]], here[on], end[on], room[on], base[on], before[on]
                n += 1
                hit = np.flatnonzero(self.piece[node] >= 0)
                if n == 1:
                    alone[on[hit]] = True
                if self.v.merges and len(hit):
                    hit = hit[self._stands(before[hit], self.piece[node[hit]])]
                total, target = base[hit] + (0 if self.v.merges else self.score[node[hit]]), end[hit] + n
                more = total > best[target]
                target = target[more]
                best[target], back[target], ids[target] = total[more], n, self.piece[node[hit[more]]]
                on = np.flatnonzero(room > n)
                node, here, end, room, base, before = node[on], here[on], end[on], room[on], base[on], before[on]
            odd = np.flatnonzero(~alone)
            target = to[odd] + s + 1
            total = best[target - 1] + self.unknown
            more = total > best[target]
            target = target[more]
            best[target], back[target], ids[target] = total[more], 1, -1

    def _spelt(self, ids: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids with unknown characters as byte pieces, how many there are before each piece and at the end)."""
        odd = np.flatnonzero(ids < 0)
        c = char[odd]
        width = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        count = np.ones(len(ids), np.int64)
        count[odd] = width
        total = np.concatenate([[0], np.cumsum(count)])
        out = np.repeat(ids, count)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)
        for k in range(4):
            w = width > k
            bits = c[w] >> (6 * (width[w] - 1 - k)).astype(np.uint32)
            byte = (bits & 0x3F) | 0x80 if k else bits | lead[width[w]]
            out[total[odd[w]] + k] = self.byte_ids[byte]
        return out.astype(np.int32), total


def _batches(batch: pa.RecordBatch, size) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about BATCH_CHARS each; size: array of each row's characters."""
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_CHARS, "right")))
        yield batch.slice(at, to - at)
        at = to


def _ids_of(lanes: Lanes, texts: pa.Array) -> pa.Array:
    flat, at = lanes.encode(texts.fill_null("").to_pylist())
    none = np.append(~np.asarray(texts.is_valid()), False)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=none), pa.array(flat))


def _texts_of(surface: list[bytes], ids: pa.Array) -> pa.Array:
    ends = np.append(np.zeros(1, np.int64), np.cumsum(np.asarray(ids.value_lengths().fill_null(0))))
    flat = [surface[k] for k in ids.flatten().to_pylist()]
    texts = [b"".join(flat[a:b])[1:] if ok else None for a, b, ok in zip(ends, ends[1:], ids.is_valid().to_pylist())]
    return pa.array(texts, pa.binary()).cast(pa.string())


def _encoded(documents: DataFrame, vocabulary: Vocabulary, check: bool) -> DataFrame:
    """``documents`` with ``ids``, and with ``exact`` if they are to be decoded and compared at once."""
    import pyarrow.compute as pc

    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    added = ["ids", "exact"] if check else ["ids"]
    rows = documents.drop(*added)
    place = [c.lower() for c in rows.columns].index("text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = Lanes(shared.value)
        for batch in batches:
            for part in _batches(batch, np.asarray(pc.fill_null(pc.binary_length(batch.column(place)), 0))):
                texts = part.column(place)
                ids = _ids_of(lanes, texts)
                new = [ids, pc.fill_null(pc.equal(_texts_of(shared.value.surface, ids), texts), True)] if check else [ids]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *added])
                del ids, new
                pa.default_memory_pool().release_unused()  # else what earlier parts took stays with the worker

    schema = StructType([*rows.schema, StructField("ids", ArrayType(IntegerType())), *([StructField("exact", BooleanType())] if check else [])])
    return rows.mapInArrow(encoded, schema)


def encode(documents: DataFrame, model: str = MODEL, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``documents`` with ``ids``, the SentencePiece ids of ``text``."""
    return _encoded(documents, vocabulary or Vocabulary.load(model), False)


def decode(encoded: DataFrame, model: str = MODEL, vocabulary: Vocabulary | None = None, to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids`` in column ``to``."""
    shared = encoded.sparkSession.sparkContext.broadcast((vocabulary or Vocabulary.load(model)).surface)
    rows = encoded.drop(to)
    place = [c.lower() for c in rows.columns].index("ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch, np.asarray(batch.column(place).value_lengths().fill_null(0)) * 4):
                yield pa.RecordBatch.from_arrays([*part.columns, _texts_of(shared.value, part.column(place))], [*part.schema.names, to])

    return rows.mapInArrow(decoded, StructType([*rows.schema, StructField(to, StringType())]))


def written_round_trip(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """``round_trip`` run and written at once, with small Arrow batches: a batch is held by the JVM and by the Python worker
    of each running task, and 10,000 texts may be of any length."""
    with small_batches(documents.sparkSession):
        return materialise(round_trip(documents, model), "pieces")


def round_trip(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """``documents`` with ``ids``, ``n_ids`` and ``exact``: do the ids decode to the very text (true for null).

    Both directions run in the task's one worker, so ids and texts cross to Python once.
    """
    both = _encoded(documents, Vocabulary.load(model), True)
    return both.withColumn("n_ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))
