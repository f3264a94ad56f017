"""Repair of the structure of conversations: A* on the lattice of edits, in blocks of turns.

A repaired conversation alternates user and assistant, may begin with one system turn, and ends with the assistant:
its role initials are ``(s?(ua)+)?``. Turns are kept (K, cost 0), get another role (R, 2), are deleted (D, 3; the only
way for blank turns and repeated ones) or new ones without text are inserted (I, 2); a truncated turn that isn't deleted
costs 1 more. A node of the lattice is (turns consumed, state of the pattern). What is left costs at least 3 for each
turn that must be deleted and 1 for each truncated one, so suffix sums of those are an admissible and consistent
heuristic, and the queue is keyed by (cost plus heuristic, audit so far): the first goal that leaves it is the cheapest
edit, ties by the audit's letters. (Of two ways to one node at the same cost no audit begins with the other one, as that
would have cost less, so a node's least audit stays least whatever follows.)

Turns are range-sorted once and written with their position. A block is BLOCK consecutive positions; a conversation
inside a block is searched whole, one that crosses blocks gives for each block the cheapest way from every state to every
state, and those are joined in order, like a product of small matrices. So a conversation may hold any share of the rows:
no task searches more than a block, and only its audit, a letter a turn, comes together in one row. The SHA-256 of a
repaired conversation is sequential by definition; it is computed on sorted rows that stream by, in constant memory.

Defined results: null roles and texts count as one space; turns are ordered by turn (null first), then role, then text;
equal turns, repeated rows among them, are duplicates of the first. A null conv_id is a conversation of its own. A
conversation without turns gives zeros, an empty audit and the hash of the empty text. Extra columns are ignored, empty
tables give no rows. Rows of one conversation and turn with the same role and the same 64 characters at the front are
sorted in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, salted_join, small_batches

#: States of the pattern: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
RETYPE, REMOVE, ADD, CUT_SHORT = 2, 3, 2, 1
BLOCK_BITS = 10
_SPACE = " \t\n\x0b\x0c\r"


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with faults put in by crc32(conv_id:turn) % 20, nulls being one space: 0 drops the row, 1 empties
    its text, 2 takes out ``[.!?]``, 3 repeats it, 4 makes it the user's."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def _conv() -> Column:
    """One text for each conversation, of null ids too."""
    return F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit(""))


def placed(turns: DataFrame) -> DataFrame:
    """pos (ascending along every conversation), conv, turn, role, text, blank, truncated, initial and two hashes of the text."""
    rows = turns.select(_conv().alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    # the first characters stand for the text where ranges are chosen, so that no long text comes to the driver
    rows = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    last = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    initial = F.when(F.length("role") == 0, 0).otherwise(initial)
    return rows.select(
        F.monotonically_increasing_id().alias("pos"), "conv", "turn", "role", "text", (last == "").alias("blank"), ((last != "") & ~last.isin(".", "!", "?")).alias("truncated"),
        initial.cast("int").alias("initial"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))


def _repeated(turns: DataFrame) -> DataFrame:
    """pos of the turns whose role and text were seen earlier in their conversation."""
    key = ["conv", "role", "h1", "h2"]
    first = turns.groupBy(*key).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return salted_join(turns.select(*key, "pos"), first, key).where("pos > first").select("pos", F.lit(True).alias("repeated"))


def _steps(code: int, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, letter, next state) of what may be done with a turn; code: initial + 4 * must be deleted + 8 * truncated."""
    yield REMOVE, "D", state
    if code & 4:
        return
    late, initial = CUT_SHORT * (code >> 3), code & 3
    to = ASSISTANT if state == USER else USER
    if initial == to or (initial == SYSTEM and state == START):
        yield late, "K", initial
    yield late + RETYPE, "R", to


def search(codes: bytes, entry: int, final: bool) -> dict[int, tuple[int, str]]:
    """exit state -> (cost, audit) of the cheapest edits of a run of turns from the state ``entry``. A ``final`` run must end
    the pattern and may insert behind its last turn; then the one exit is the best."""
    n, ahead = len(codes), [0]
    for code in reversed(codes):
        ahead.append(ahead[-1] + (REMOVE if code & 4 else CUT_SHORT * (code >> 3)))
    ahead.reverse()
    queue, closed, out = [(ahead[0], "", 0, entry)], set(), {}
    while queue:
        cost, audit, at, state = heappop(queue)
        if (at, state) in closed:
            continue
        closed.add((at, state))
        if at == n and (not final or state in (START, ASSISTANT)):
            out[state] = (cost, audit)
            if final or len(out) == 4:
                break
            continue
        heappush(queue, (cost + ADD, audit + "I", at, ASSISTANT if state == USER else USER))
        if at < n:
            for more, letter, to in _steps(codes[at], state):
                heappush(queue, (cost - ahead[at] + more + ahead[at + 1], audit + letter, at + 1, to))
    return out


@lru_cache(1 << 16)
def _known(codes: bytes, entry: int, final: bool) -> dict[int, tuple[int, str]]:
    """``search`` of a short run; those of the same shape are searched once a worker."""
    return search(codes, entry, final)

PORTION = "conv string, block long, lo long, blank long, duplicate long, truncated long, illegal long, first int, last int, whole boolean, entries array<int>, exits array<int>, systems array<boolean>, costs array<long>, audits array<string>"


def _portions(rows: DataFrame) -> DataFrame:
    """The PORTION of each conversation in each block."""

    def searched(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        cols = {c: table.column(c).to_pylist() for c in table.column_names}
        conv, n, out, lo = cols["conv"], table.num_rows, [], 0
        while lo < n:
            hi = lo
            while hi < n and conv[hi] == conv[lo]:
                hi += 1
            codes, count, illegal = bytearray(), [0, 0, 0], 0
            for i in range(lo, hi):
                blank, repeated, short, initial = (cols[c][i] for c in ("blank", "repeated", "truncated", "initial"))
                fault = 0 if blank else 1 if repeated else 2 if short else None
                if fault is not None:
                    count[fault] += 1
                codes.append(initial + (4 if blank or repeated else 8 if short else 0))
                if i > lo:
                    illegal += not follows(cols["initial"][i - 1], initial)
            # a portion at an edge of the block may go on beyond it
            whole, codes = lo > 0 and hi < n, bytes(codes)
            find = _known if len(codes) <= 32 else search
            ways = [(e, x, e == START and keeps_system(codes, v[1]), *v) for e in ((START,) if whole else range(4)) for x, v in sorted(find(codes, e, whole).items())]
            out.append((conv[lo], cols["block"][lo], cols["pos"][lo], *count, illegal, cols["initial"][lo], cols["initial"][hi - 1], whole, *map(list, zip(*ways))))
            lo = hi
        names = ["conv", "block", "lo", "blank", "duplicate", "truncated", "illegal", "first", "last", "whole", "entries", "exits", "systems", "costs", "audits"]
        types = [pa.string(), *[pa.int64()] * 6, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return rows.groupBy("block").applyInArrow(searched, PORTION)


def follows(a: int, b: int) -> bool:
    """May a turn of initial ``b`` come after one of ``a``?"""
    return b == (ASSISTANT if a == USER else USER) and a != 0


def keeps_system(codes: bytes, audit: str) -> bool:
    """Is the first turn that ``audit`` doesn't delete kept as a system turn?"""
    rest = audit.lstrip("D")
    return rest[:1] == "K" and codes[len(audit) - len(rest)] & 3 == SYSTEM


def joined(portions: list[dict]) -> tuple[int, str, list[tuple[int, bool, str]]]:
    """(cost, audit, (entry state, begins with a kept system turn, edits) of each portion) of a conversation's portions in order."""
    if len(portions) == 1 and portions[0]["whole"]:
        p = portions[0]
        return p["costs"][0], p["audits"][0], [(START, p["systems"][0], p["audits"][0])]
    best, past = {START: (0, "")}, []
    for p in portions:
        now = {}
        for e, x, system, cost, audit in zip(p["entries"], p["exits"], p["systems"], p["costs"], p["audits"]):
            if e in best:
                way = (best[e][0] + cost, best[e][1] + audit, e, system, audit)
                if x not in now or way[:2] < now[x][:2]:
                    now[x] = way
        past.append({x: way[2:] for x, way in now.items()})
        best = {x: way[:2] for x, way in now.items()}
    ends = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
    cost, audit, state = min((c + ADD * len(ends[s]), a + ends[s], s) for s, (c, a) in best.items())
    pieces, tail = [], ends[state]
    for ways in reversed(past):
        entry, system, edits = ways[state]
        pieces.append((entry, system, edits + tail))
        state, tail = entry, ""
    return cost, audit, pieces[::-1]


SUMMARY = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<lo:long,entry:int,system:boolean,edits:string>>"


def _summaries(portions: DataFrame) -> DataFrame:
    """SUMMARY of each conversation; pieces: its edits by block, from the position ``lo`` and the state ``entry`` on."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = row["portions"]
                cost, audit, pieces = joined(parts)
                sums = [sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")]
                sums[3] += sum(not follows(a["last"], b["first"]) for a, b in zip(parts, parts[1:]))
                out.append((row["conv"], *sums, cost, audit, [{"lo": p["lo"], "entry": e, "system": s, "edits": a} for p, (e, s, a) in zip(parts, pieces)]))
            types = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("entry", pa.int32()), ("system", pa.bool_()), ("edits", pa.string())]))]
            names = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "pieces"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    fields = ["block", *[c for c in portions.columns if c not in ("conv", "block")]]
    return portions.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("portions")).select("conv", "portions").mapInArrow(folded, SUMMARY)


def _spread(summaries: DataFrame) -> DataFrame:
    """conv, pos, nth, role (null: as it is) and inserted of every turn that a repaired conversation has."""

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, pos, state, system, edits in zip(*(batch.column(c).to_pylist() for c in ("conv", "lo", "entry", "system", "edits"))):
                nth, inner = 0, len(edits.rstrip("I"))
                for k, letter in enumerate(edits):
                    if k == inner:  # behind the last turn: what is inserted there stays at its position
                        pos, nth = pos - 1, 8
                    if letter != "D":
                        state = SYSTEM if state == START and system else ASSISTANT if state == USER else USER
                        out.append((conv, pos, nth, None if letter == "K" else ROLE[state], letter == "I"))
                    pos, nth = (pos, nth + 1) if letter == "I" else (pos + 1, 0)
            types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["conv", "pos", "nth", "role", "inserted"])

    pieces = summaries.select("conv", F.explode("pieces").alias("p")).select("conv", "p.*")
    return pieces.mapInArrow(turns, "conv string, pos long, nth int, role string, inserted boolean")


def digests(turns: DataFrame) -> DataFrame:
    """conv and repaired_sha256 of the lines ``role:text`` of each conversation, in the order of pos and nth.

    The rows of a task are sorted and stream by; all that is held is the hash so far.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["conv", "repaired_sha256"])
        for batch in batches:
            out = []
            for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line")):
                if conv != last or state is None:
                    if state is not None:
                        out.append((last, state.hexdigest()))
                    last, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(memoryview(line.as_buffer()))
            yield pack(out)
        if state is not None:
            yield pack([(last, state.hexdigest())])

    lines = turns.select("conv", "pos", "nth", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "pos", "nth").select("conv", "line").mapInArrow(hashed, "conv string, repaired_sha256 string")


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row for each conversation, the turns of the repaired ones).

    The first has conv_id, gaps (turn numbers that are missing between the least and the greatest), blank, duplicate and
    truncated (turns by their first fault), illegal (neighbours whose roles can't follow each other), cost, audit and
    repaired_sha256; of every conv_id of ``conversations``, where given, else of ``turns``. The second has conv_id, pos and
    nth (the order), role, text and inserted.
    """
    with small_batches(turns.sparkSession):  # all that runs in Python is written inside
        rows = materialise(placed(turns), "repair-turns")
        marked = rows.join(_repeated(rows), "pos", "left").select("pos", "conv", "blank", "truncated", "initial", F.coalesce("repeated", F.lit(False)).alias("repeated"), F.shiftright("pos", BLOCK_BITS).alias("block"))
        portions = materialise(_portions(marked), "repair-portions")
        summaries = materialise(_summaries(portions), "repair-summaries")
        spread = _spread(summaries).join(rows.select("pos", F.col("role").alias("own"), "text"), "pos")
        lasting = spread.select("conv", "pos", "nth", F.coalesce("role", "own").alias("role"), F.when(F.col("inserted"), "").otherwise(F.col("text")).alias("text"), "inserted")
        lasting = materialise(lasting, "repair-repaired")
        hashes = materialise(digests(lasting), "repair-hashes")
    span = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    of = (turns if conversations is None else conversations).select("conv_id", _conv().alias("conv")).distinct()
    out = of.join(summaries.drop("pieces"), "conv", "left").join(span, "conv", "left").join(hashes, "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return out, of.join(lasting, "conv").select("conv_id", "pos", "nth", "role", "text", "inserted")
