"""Conversation repair, sharding and collocations against brute force, ties, nulls, repeats, long texts and hot groups."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from terrace.llm import collocations, sharding
from terrace.llm import conversation_repair as cr
from terrace.llm.conversation_repair import REMOVE, START, joined, search

TURNS = "conv_id long, turn long, role string, text string, pos int, conv string, block int"


def _all_ways(codes, entry, final):
    """The least (cost, audit) of each exit by plain dynamic programming over all ways, without a heuristic."""
    best = {entry: (0, "")}

    def inserted(best):
        out = dict(best)
        for _ in range(4):
            for s, (c, a) in list(out.items()):
                to = 3 if s == 2 else 2
                way = (c + 2, a + "I")
                if to not in out or way < out[to]:
                    out[to] = way
        return out

    for code in codes:
        new = {}
        for s, (c, a) in inserted(best).items():
            ways = [(c + 3, a + "D", s)]
            if not code & 4:
                to, late = (3 if s == 2 else 2), code >> 3
                ways.append((c + 2 + late, a + "R", to))
                if code & 3 == to or (code & 3 == 1 and s == 0):
                    ways.append((c + late, a + "K", code & 3))
            for cost, audit, x in ways:
                if x not in new or (cost, audit) < new[x]:
                    new[x] = (cost, audit)
        best = new
    if final:
        ends = inserted(best)
        return min(ends[s] for s in (0, 3) if s in ends)
    return best


def _codes(rnd, n):
    return bytes(rnd.choice([0, 1, 2, 2, 2, 3, 3, 3]) + rnd.choice([0, 0, 0, 0, 4, 8]) for _ in range(n))


def test_search_finds_the_cheapest_edits_and_least_audit():
    rnd = random.Random(1)
    for n in [0, 1, 2, 3, 5, 8, 13, 40] * 20:
        codes = _codes(rnd, n)
        (found,) = search(codes, START, True).values()
        assert found == _all_ways(codes, START, True)
        for entry in range(4):
            assert search(codes, entry, False) == _all_ways(codes, entry, False)


def test_blocks_joined_equal_one_search():
    rnd = random.Random(2)
    for _ in range(60):
        codes = _codes(rnd, rnd.randint(1, 60))
        cuts = sorted({0, len(codes), *(rnd.randrange(len(codes) + 1) for _ in range(4))})
        parts = []
        for lo, hi in zip(cuts, cuts[1:]):
            ways = [(e, x, e == START and cr.keeps_system(codes[lo:hi], v[1]), *v) for e in range(4) for x, v in search(codes[lo:hi], e, False).items()]
            parts.append({"whole": False, **dict(zip(("entries", "exits", "systems", "costs", "audits"), map(list, zip(*ways))))})
        cost, audit, pieces = joined(parts)
        assert (cost, audit) == _all_ways(codes, START, True) and "".join(p[2] for p in pieces) == audit


def _repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, text) of one conversation's turns, by brute force."""
    rows = sorted(((t, r or (" " if r is None else ""), " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
    seen, codes, count, illegal = set(), [], Counter(), 0
    for k, (_, role, text) in enumerate(rows):
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        count[fault] += 1
        codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + (4 if fault in ("blank", "duplicate") else 8 if fault else 0))
        illegal += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    cost, audit = _all_ways(bytes(codes), START, True)
    lines, at, state = [], 0, START
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        to = 3 if state == 2 else 2
        if letter == "K" and state == START and rows[at][1][0] == "s":
            to = 1
        lines.append(({2: "user", 3: "assistant"}[to] if letter != "K" else rows[at][1]) + ":" + ("" if letter == "I" else rows[at][2]))
        state, at = to, at + (letter != "I")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, "\n".join(lines)


def test_repair_equals_brute_force_across_blocks(spark, monkeypatch):
    """Blocks of 8 turns, so that most conversations cross one; nulls, ties, repeats, odd roles and clashing names."""
    monkeypatch.setattr(cr, "BLOCK_BITS", 3)
    rnd, rows = random.Random(3), []
    for conv in [None, *range(12)]:
        for k in range(rnd.choice([1, 3, 6, 40])):
            turn = None if rnd.random() < 0.1 else k + rnd.choice([0, 0, 0, 1])
            rows.append((conv, turn, rnd.choice(["user", "assistant", "system", "user", "assistant", "", None, "tool"]), rnd.choice(["Yes.", "No!", "so what", "", " \n", None, f"long {k} " * 900 + ".", f"é{k}?\t"])))
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)
    summary, turns = cr.repair(df)
    want = {c: _repaired([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    text = defaultdict(list)
    for r in turns.orderBy("pos", "nth").collect():
        text[r.conv_id].append(f"{r.role}:{r.text}")
    got = summary.collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, "\n".join(text[r.conv_id])) == want[r.conv_id]
        assert r.repaired_sha256 == hashlib.sha256(want[r.conv_id][-1].encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in text[r.conv_id]))


def test_one_conversation_with_most_rows(spark):
    """5000 turns of one conversation, in many blocks: the audit and text are those of a single search."""
    rnd = random.Random(4)
    rows = [(7, k, rnd.choice(["user", "assistant"]), f"turn {k}{rnd.choice(['.', '.', ''])}") for k in range(5000)] + [(8, 0, "user", "hi.")]
    got = {r.conv_id: r for r in cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))[0].collect()}
    want = _repaired([r[1:] for r in rows if r[0] == 7])
    assert (got[7].cost, got[7].audit) == want[5:7] and got[7].repaired_sha256 == hashlib.sha256(want[7].encode()).hexdigest()
    assert (got[8].cost, got[8].audit) == (2, "KI")


def test_damage(spark):
    rows = [(c, t, "assistant", f"Well. Done! {c}?") for c in [None, *range(40)] for t in (None, 0, 1)]
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in cr.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault:
            want[c, t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text] += 2 if fault == 3 else 1
    assert got == want


def test_conversations_without_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    (r,) = cr.repair(rows.where("false"), rows)[0].collect()
    assert (r.gaps, r.cost, r.audit, r.repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cr.repair(rows.where("false"))[0].count() == 0
    # the only turn must go: nothing is left
    (r,) = cr.repair(spark.createDataFrame([(1, None, None, None)], "conv_id long, turn long, role string, text string"))[0].collect()
    assert (r.gaps, r.blank, r.cost, r.audit) == (0, 1, REMOVE, "D")


DOCS = "doc_id long, text string, lang string, shard int, size string, copies int"


def _doc_rows(rnd, n):
    texts = [None, "", "é" * 5, *["w " * rnd.randint(1, 400) for _ in range(n)], "long " * 60000]
    return [(i if rnd.random() < 0.95 else None, rnd.choice(texts[: 5 + i]), "en", 1, "x", 2) for i in range(n)] + [(1, "twin", "en", 1, "x", 2)] * 3 + [(None, None, None, None, None, None)] * 2


@pytest.mark.parametrize("heads,buckets", [(1, 1), (8, 4), (1 << 15, 64)])
def test_shards_keep_groups_and_balance(spark, heads, buckets):
    rows = _doc_rows(random.Random(5), 400)
    out = sharding.shard(spark.createDataFrame(rows, DOCS).repartition(3), heads=heads, buckets=buckets, ranges=4)
    got = out.collect()
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    bytes_of = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(bytes_of(t)) + 1, zlib.crc32(bytes_of(t))) for i, t, *_ in rows)
    of, loads, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        of[r.size, r.text_crc32].add(r.shard)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    weights = Counter()
    for _, t, *_ in rows:
        weights[t or ""] += len(bytes_of(t)) + 1
    plain = [0] * 8
    for w in sorted(weights.values(), reverse=True):
        heapq.heapreplace(plain, plain[0] + w)
    # the largest group fills a shard by itself; among the rest no load differs by more than the largest group dealt in tasks
    if heads > len(weights):
        assert sorted(loads[s] for s in range(8)) == sorted(plain)
    rest = sorted(loads[s] for s in range(8))[:-1]
    assert rest[-1] - rest[0] <= sorted(weights.values())[-2]
    again = sharding.shard(spark.createDataFrame(rows[::-1], DOCS), heads=heads, buckets=buckets, ranges=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_copies_of_a_row_have_a_slot_each(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    got = sharding.shard(spark.range(50).selectExpr("cast(null as long) doc_id", "'same' text")).collect()
    assert sorted(r.slot for r in got) == list(range(50)) and len({r.shard for r in got}) == 1


def test_shards_of_an_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


def _phrases(rows, least, longest, top):
    """The best phrases by plain counting."""
    counts, total = defaultdict(Counter), Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in kept.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (f[p[:j]] * f[p[j:]]), j, f[p[:j]], f[p[j:]]) for j in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, n, p.decode(), -a, l, r, total[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest,block", [(2, 50), (3, 1 << 20), (5, 70)])
def test_collocations_equal_plain_counting(spark, longest, block):
    rnd = random.Random(6)
    words = ["The", "the", "of", "é", "日本", "a-b", "x y", "T'is", "zz"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", " ", ". ", "\n", ",", "\x0b"]) for _ in range(n))
    rows = [(text(rnd.choice([0, 3, 40])), rnd.choice(["en", "fr", None])) for _ in range(60)] + [(None, "en"), ("", None), (" ,. ", "de"), (text(4000), "en")]
    rows += [rows[3]] * 4
    df = spark.createDataFrame([(i, t, g, 1, 2.0, "r") for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, block int, id double, seq string").repartition(3)
    got = collocations.collocations(df, least=4, longest=longest, top=25, block_words=block)
    assert sorted(map(tuple, got.collect())) == _phrases(rows, 4, longest, 25)


def test_scores_beyond_64_bits_are_exact(spark):
    cases = [(999999999999999, 999999999999999, 999999999999999), (123456789012345, 999999999999998, 234567890123456), (10**14 + 7, 10**14 + 9, 3 * 10**14 + 1), (10, 10, 10), (10, 11, 13)]
    got = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == [1000000 * a * a // (x * y) for a, x, y in cases]
