"""Line dedup's suffix order, common prefixes and maximal runs against brute force."""

import random
import re

from terrace.llm import line_dedup


def _common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _fixture(seed):
    rng = random.Random(seed)
    shared = [f"line {k} of a shared passage" for k in range(9)]
    docs = []
    for i in range(14):
        lines = [rng.choice(["a b c", "d e", "f", "g h i j", f"own {i} {rng.random()}"]) for _ in range(rng.randint(0, 9))]
        if i % 3 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = shared[rng.randint(0, 2):]
        docs.append((i, "\n".join(lines)))
    return docs + [(20, docs[3][1]), (21, "x y\n" * 40), (22, None), (23, "")]


def test_suffix_order_and_common_prefixes(spark):
    for seed in range(1):
        docs = spark.createDataFrame(_fixture(seed), "doc_id long, text string")
        lines = line_dedup._lines(line_dedup._keyed(docs), 6)
        at = {r.pos: r for r in lines.collect()}
        tail = {p: [at[k]["rank"] for k in range(p, r.end + 1)] for p, r in at.items()}
        rows = sorted(line_dedup.suffix_order(lines).collect(), key=lambda r: r["index"])
        assert [r.pos for r in rows] == sorted(at, key=lambda p: (tail[p], p))
        assert rows[0].lcp == 0
        for before, row in zip(rows, rows[1:]):
            assert (row.other, row.lcp) == (before.pos, _common(tail[before.pos], tail[row.pos]))
            left = [at[p - 1]["rank"] if p > at[p].run else None for p in (before.pos, row.pos)]
            assert row.maximal == (None in left or left[0] != left[1])


def test_maximal_runs_are_repeated_and_cannot_grow(spark):
    docs = _fixture(5)
    units = {i: (t or "").split("\n") if t else [] for i, t in docs}
    got = line_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string"), 12).collect()
    for r in got:
        a, b, n = units[r.doc_id], units[r.other_doc_id], r.lines
        i, j = r.unit, r.other_unit
        assert a[i : i + n] == b[j : j + n] and len(" ".join(a[i : i + n]).split()) == r.words >= 12
        assert i == 0 or j == 0 or a[i - 1] != b[j - 1]
        assert i + n == len(a) or j + n == len(b) or a[i + n] != b[j + n]
    longest = {}
    for d, a in units.items():
        for e, b in units.items():
            for i in range(len(a)):
                for j in range(len(b)):
                    if (d, i) < (e, j) and (n := _common(a[i:], b[j:])) and len(" ".join(a[i : i + n]).split()) >= 12:
                        for place in ((d, i), (e, j)):
                            longest[place] = max(longest.get(place, 0), n)
    # the longest run of the fixture comes out, and nothing longer
    assert max(r.lines for r in got) == max(longest.values()) == 39
    assert {tuple(units[r.doc_id][r.unit : r.unit + r.lines]) for r in got} >= {tuple(f"line {k} of a shared passage" for k in range(2, 9))} or any(r.lines >= 7 for r in got if r.doc_id != 21)


def test_no_repeats_and_no_rows(spark):
    for docs in ([], [(1, None), (2, "")], [(1, "a b"), (2, "c d")]):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert line_dedup.repeated_runs(df, 1).isEmpty()
        assert sorted(r.deleted_lines for r in line_dedup.line_dedup(df, 1).collect()) == [0] * len(docs)


ODD = ["", "\n", "\n\n a", "a\n \nb", "a b\n", "  a  b \nc", "\tq\x0bz\n\r\nx y\r\n", "é ü\nß", "a\n\x0c\n\x0b\nb c d", "x\ny z\n\n\n", "\xa0\n\xa0 b", " \n \n", "a\rb\nc\r", "one two\nthree"]


def test_lines_are_split_and_counted_once(spark, monkeypatch):
    plans, write = [], line_dedup.materialise

    def spy(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(line_dedup, "materialise", spy)
    docs = line_dedup._keyed(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"))
    line_dedup._lines(docs, 1)
    # words are counted in one place, and texts are read for lines alone, not once more for their number
    assert sum(p.count("regexp_extract_all") + p.count("regexp_count") for n, p in plans if n == "lines") == 1
    assert not any("text#" in p for n, p in plans if n == "line-starts")


def test_odd_white_space_gives_the_pattern_s_units_and_words(spark, monkeypatch):
    written, write = {}, line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name: written.setdefault(name, write(df, name)))
    docs = line_dedup._keyed(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"))
    line_dedup._lines(docs, 1)
    want = []
    for i, text in enumerate(ODD):
        for unit, piece in enumerate(re.split(r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])", text)):
            if n := len(re.findall(r"[^\x20\x09-\x0D]+", piece.split("\n")[0])):
                want.append((i, unit, n))
    assert sorted((r[line_dedup.DOC[0]], r.unit, r.words) for r in written["lines"].collect()) == want
