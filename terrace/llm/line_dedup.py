"""Line deduplication by a suffix array of line ids, with DataFrame functions alone.

The texts are sequences of lines with at least one word; lines that occur once
cut them into stretches. Prefix doubling sorts the suffixes of the stretches by
their first 1, 2, 4, ... lines: a rank is the number of suffixes before the
first one with the same prefix, and each turn sorts the suffixes that still
share a rank by their own and the rank 1, 2, 4, ... lines on, until none share
one that could still differ. The ranks of the last turn are the suffix order.

Longest common prefixes of neighbours in it are found from the ranks of all
turns, longest first, but only where the lines before the two differ; where
they are equal, the prefix is that of the suffix one line earlier, less one.

A run of lines (at least ``min_words`` words) is an interval of suffixes whose
neighbours share that many lines. A line is deleted exactly if it lies in a run
of lines of its document that has ``min_words`` words or more and occurs, equal
line by line, at an earlier position (by doc_id, then line; the same document or
another one; the copies may overlap). Such runs are unions of the shortest ones
of ``min_words`` words that start or end at each line, and of each interval of
these all but the first position are later copies. ``repeated_runs`` gives the
maximal runs themselves.

All sorts are by ranges whose keys end in the position, so no line, rank or
interval, however common, meets in one task; what crosses a range's edge is
carried in one small row a range.

Defined results: a null text stays null. Lines without a word go with the line
before them (leading ones always stay). Line equality is of all bytes between
line feeds. Rows with the same doc_id and text count as one document and get
the same result; a null doc_id sorts last. Empty tables give no rows; extra
columns are kept by ``line_dedup`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, salted_join

MIN_WORDS = 50
#: A line feed before a line with a word: the units are a line and the wordless lines after it.
UNIT = r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"
DOC = ["__doc_key", "__text_key"]


def _keyed(documents: DataFrame) -> DataFrame:
    no_id = F.lit((1 << 63) - 1)
    return documents.select("*", F.coalesce(F.col("doc_id").cast("long"), no_id).alias(DOC[0]), F.xxhash64("text").alias(DOC[1]))


def _starts(lines: DataFrame) -> DataFrame:
    """The global position of each document's first unit, from the rows of all its lines: prefix sums over the documents
    in order of how many units they have up to the last line with a word.

    Documents are range-sorted into written files; window sums inside each range
    and over the range totals give the starts, so no task holds all documents.
    """
    sizes = lines.groupBy(*DOC).agg((F.max("unit") + 1).cast("long").alias("lines"))
    ranged = sizes.repartitionByRange(*DOC).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "line-starts")
    totals = ranged.groupBy("part").agg(F.sum("lines").alias("all"))
    totals = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inner = F.sum("lines").over(Window.partitionBy("part").orderBy(*DOC)) - F.col("lines")
    return ranged.withColumn("inner", inner).join(totals, "part").select(*DOC, (F.col("before") + F.col("inner")).alias("start"))


def _ordered(rows: DataFrame, order: list[str], opens: dict[str, str], name: str, seen: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their ``index`` (from 1) by ``order``, ``before`` (``seen`` of the row before) and, for each of
    ``opens``, the index of the last row up to this one for which the condition held; ``closes``: the next row opens the first.

    One pass over range-sorted rows, written; the edges of the ranges are a row each.
    """
    columns, opened = rows.columns, [f"{k}_opens" for k in opens]
    at = Window.partitionBy("part").orderBy(*order)
    sofar = at.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    rows = rows.withColumn("row", F.row_number().over(at)).withColumn("before", F.lag(F.struct(*(seen or order))).over(at))
    for k, condition in opens.items():
        rows = rows.withColumn(f"{k}_opens", (F.col("row") > 1) & F.expr(condition))
        rows = rows.withColumn(k, F.last(F.when(F.col(f"{k}_opens"), F.col("row")), True).over(sofar))
    closes = F.lead(opened[0]).over(at) if opens else F.lit(False)
    rows = rows.withColumn("closes", closes).withColumn("last", F.lead("row").over(at).isNull())
    rows = materialise(rows.drop(*opened), name)

    parts = Window.orderBy("part")
    ends = rows.where("last").select("part", F.col("row").alias("n"), F.struct(*(seen or order)).alias("tail"), *[F.col(k).alias(f"{k}_at") for k in opens])
    edges = rows.where("row = 1").drop("before", "row", *opens).join(ends, "part")
    edges = edges.withColumn("offset", F.sum("n").over(parts) - F.col("n")).withColumn("before", F.lag("tail").over(parts))
    for k, condition in opens.items():
        first = F.col("before").isNull() | F.expr(condition)
        till = F.last(F.coalesce(F.col("offset") + F.col(f"{k}_at"), F.when(F.col(f"{k}_first"), F.col("offset") + 1)), True).over(parts)
        edges = edges.withColumn(f"{k}_first", first).withColumn(f"{k}_till", till)
        edges = edges.withColumn(f"{k}_carry", F.when(F.col(f"{k}_first"), F.col("offset") + 1).otherwise(F.lag(f"{k}_till").over(parts)))
    edges = edges.withColumn("next_opens", F.coalesce(F.lead(f"{next(iter(opens))}_first").over(parts), F.lit(True)) if opens else F.lit(True))
    edges = edges.select("part", "offset", "next_opens", F.col("before").alias("edge"), *[f"{k}_carry" for k in opens])
    rows = rows.join(F.broadcast(edges), "part")
    starts = [F.coalesce(F.col("offset") + F.col(k), F.col(f"{k}_carry")).alias(k) for k in opens]
    closes = F.when(F.col("last"), F.col("next_opens")).otherwise(F.col("closes")).alias("closes")
    return rows.select(*columns, (F.col("offset") + F.col("row")).alias("index"), F.coalesce("before", "edge").alias("before"), closes, *starts)


ALONE = "key = index AND closes"


def _wordless(line):
    return F.ltrim(line, F.lit(" \t\n\x0b\x0c\r")) == ""


def _n_words(line: str):
    """Matches of WORD in a line with words. Where all white space is single spaces they are counted by bytes, else by the pattern."""
    odd = F.contains(F.col(line), F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(F.col(line), F.lit(c))
    bare = F.trim(F.col(line))
    spaces = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit("")))
    return F.when(odd, F.regexp_count(line, F.lit(WORD))).otherwise(spaces + 1)


def _all_lines(documents: DataFrame) -> DataFrame:
    """doc, unit, words and hashes of every line with words, written."""
    docs = documents.where("text is not null").select(*DOC, "text", F.split("text", "\n").alias("plain"))
    # without a wordless line each line is a unit, and the pattern, which costs several times as much, isn't needed
    units = F.transform(F.split("text", UNIT), lambda u: F.substring_index(u, "\n", 1))
    lines = docs.select(*DOC, F.posexplode(F.when(F.exists("plain", _wordless), units).otherwise(F.col("plain"))).alias("unit", "line"))
    # rows are left out before their words are counted: a filter on the count would count twice
    lines = lines.where(~_wordless(F.col("line"))).select(*DOC, "unit", _n_words("line").alias("words"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))
    return materialise(lines, "lines")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """doc, unit, words and rank of every one of ``lines`` that occurs twice or more; equal lines share a rank."""
    # the sort reads its rows twice
    lines = _ordered(lines, ["h1", "h2", *DOC, "unit"], {"key": "h1 <> before.h1 OR h2 <> before.h2"}, "line-ranks", ("h1", "h2"))
    return lines.where(f"NOT ({ALONE})").select(*DOC, "unit", "words", F.col("key").alias("rank"))


def _lines(documents: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines, in stretches of ``min_words`` words or more, with their global position, the first and last position of their stretch, and the lengths of the
    shortest runs of ``min_words`` words that start (f_len) and end (b_len) with them."""
    every = _all_lines(documents)
    # copies of a row have equal lines: one of them stays
    lines = repeated_lines(every).join(_starts(every), DOC).groupBy(*DOC, "unit").agg(
        F.first("words").alias("words"), F.first("rank").alias("rank"), (F.first("start") + F.col("unit")).alias("pos")
    )
    in_doc = Window.partitionBy(*DOC)
    running = in_doc.orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("till", F.sum("words").over(running)).withColumn("since", F.col("till") - F.col("words"))
    gap = F.coalesce(F.lag("unit").over(in_doc.orderBy("unit")) != F.col("unit") - 1, F.lit(True))
    lines = lines.withColumn("gap", gap).withColumn("run", F.last(F.when(F.col("gap"), F.col("pos")), True).over(running))
    # a stretch of fewer words holds no run
    lines = lines.withColumn("all", F.sum("words").over(Window.partitionBy(*DOC, "run"))).where(F.col("all") >= min_words)
    ahead = in_doc.orderBy("since").rangeBetween(0, min_words - 1)
    behind = in_doc.orderBy("till").rangeBetween(-(min_words - 1), 0)
    lines = lines.withColumn("f_len", F.count(F.lit(1)).over(ahead)).withColumn("f_last", F.max("unit").over(ahead)).withColumn("f_till", F.max("till").over(ahead))
    lines = lines.withColumn("b_len", F.count(F.lit(1)).over(behind)).withColumn("b_first", F.min("unit").over(behind)).withColumn("b_since", F.min("since").over(behind))
    # unrepeated lines and short stretches are missing from the rows: a run over such a gap has no copy anyway
    whole_f = (F.col("f_last") - F.col("unit") + 1 == F.col("f_len")) & (F.col("f_till") - F.col("since") >= min_words)
    whole_b = (F.col("unit") - F.col("b_first") + 1 == F.col("b_len")) & (F.col("till") - F.col("b_since") >= min_words)
    lines = lines.withColumn("f_len", F.when(whole_f, F.col("f_len").cast("int"))).withColumn("b_len", F.when(whole_b, F.col("b_len").cast("int")))
    lines = lines.withColumn("end", F.max("pos").over(Window.partitionBy(*DOC, "run")))
    return materialise(lines.select(*DOC, "unit", "pos", "run", "end", "rank", "till", "since", "f_len", "b_len"), "line-runs")


def _ranks(lines: DataFrame) -> list[DataFrame]:
    """For depths 1, 2, 4, ...: pos and rank of the suffixes, those of stretches whose order is settled left out."""
    along = Window.partitionBy("run").orderBy("pos")
    now = lines.select("run", "end", "pos", "rank", F.lit(True).alias("shared"))
    found, step = [now], 1
    while not now.where(F.col("shared") & (F.col("end") - F.col("pos") >= step)).isEmpty():
        live = F.col("shared") & (F.col("end") - F.col("pos") + 1 >= step)
        pair = now.withColumn("next", F.coalesce(F.lead("rank", step).over(along), F.lit(-1))).withColumn("live", live)
        pair = pair.withColumn("open", F.max("live").over(Window.partitionBy("run"))).where("open")
        keys = {"key": "rank <> before.rank OR next <> before.next", "group": "rank <> before.rank"}
        split = _ordered(pair.where("live").select("run", "end", "pos", "rank", "next"), ["rank", "next", "pos"], keys, f"suffixes-{step}", ("rank", "next"))
        rank = (F.col("rank") + F.col("key") - F.col("group")).alias("rank")
        split = split.select("run", "end", "pos", rank, F.expr(f"NOT ({ALONE})").alias("shared"))
        still = pair.where("NOT live").select("run", "end", "pos", "rank", F.lit(False).alias("shared"))
        now = materialise(split.unionByName(still), f"suffix-ranks-{step}")
        found.append(now)
        step *= 2
    return found


def suffix_order(lines: DataFrame) -> DataFrame:
    """pos, run, end, ``index`` in suffix order, ``other`` (the suffix before it) and ``lcp``, how many lines both share;
    ``maximal``: the lines before the two differ, so the shared run can't be longer on either side."""
    ranks = _ranks(lines)
    last = ranks[0].select("pos", "rank")
    for r in ranks[1:]:
        last = last.unionByName(r.select("pos", "rank"))
    # a later rank is never below an earlier one
    last = last.groupBy("pos").agg(F.max("rank").alias("rank"))
    along = Window.partitionBy("run").orderBy("pos")
    rows = lines.select("pos", "run", "end", F.col("rank").alias("line")).withColumn("left", F.lag("line").over(along)).join(last, "pos")
    rows = _ordered(rows, ["rank", "pos"], {}, "suffix-order", ("pos", "end", "line", "left"))
    meets = F.coalesce(F.col("before.line") == F.col("line"), F.lit(False))
    same_left = F.coalesce(F.col("before.left") == F.col("left"), F.lit(False))
    rows = rows.select("pos", "run", "end", "index", F.col("before.pos").alias("other"), F.col("before.end").alias("other_end"), meets.alias("meets"), (~same_left).alias("maximal"))
    rows = materialise(rows, "suffix-neighbours")
    pairs = rows.where("meets AND maximal").select("pos", "end", "other", "other_end", F.lit(0).cast("long").alias("lcp"))
    for depth in reversed(range(len(ranks))):
        mine = ranks[depth].select(F.col("pos").alias("at"), F.col("rank").alias("mine"))
        its = ranks[depth].select(F.col("pos").alias("at"), F.col("rank").alias("its"))
        pairs = pairs.withColumn("at", F.col("pos") + F.col("lcp")).join(mine, "at", "left")
        pairs = pairs.withColumn("at", F.col("other") + F.col("lcp")).join(its, "at", "left").drop("at")
        pairs = pairs.withColumn("lcp", F.col("lcp") + F.when(F.col("mine") == F.col("its"), 1 << depth).otherwise(0)).drop("mine", "its")
        # suffixes that are equal to the end of their stretches have equal ranks at any depth
        pairs = pairs.withColumn("lcp", F.least("lcp", F.col("end") - F.col("pos") + 1, F.col("other_end") - F.col("other") + 1))
        if depth % 3 == 0:
            pairs = materialise(pairs, f"prefixes-{depth}")
    rows = rows.join(pairs.select("pos", "lcp"), "pos", "left")
    known = F.when(~F.col("meets") | F.col("maximal"), F.col("pos") + F.coalesce("lcp", F.lit(0)))
    reach = F.last(known, True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("lcp", reach - F.col("pos")).select("pos", "run", "end", "index", "other", "lcp", "maximal")


def repeated_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The maximal repeated runs between neighbours in suffix order: of ``lines`` lines and ``words`` words, at ``unit``
    of ``doc_id`` and at ``other_unit`` of ``other_doc_id``. Neither can be made longer on either side."""
    lines = _lines(_keyed(documents.select("doc_id", "text")), min_words)
    runs = suffix_order(lines).where("maximal AND lcp > 0").withColumn("till_pos", F.col("pos") + F.col("lcp") - 1)
    no_id = F.lit((1 << 63) - 1)
    place = [F.when(F.col(DOC[0]) != no_id, F.col(DOC[0])), F.col("unit")]
    runs = runs.join(lines.select("pos", place[0].alias("doc_id"), "unit", "since"), "pos")
    runs = runs.join(lines.select(F.col("pos").alias("till_pos"), "till"), "till_pos").withColumn("words", F.col("till") - F.col("since")).where(F.col("words") >= min_words)
    other = lines.select(F.col("pos").alias("other"), place[0].alias("other_doc_id"), place[1].alias("other_unit"))
    return runs.join(other, "other").select("doc_id", "unit", "other_doc_id", "other_unit", F.col("lcp").alias("lines"), "words")


def deleted_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document with deletions: ``runs``, the sorted disjoint intervals of deleted units."""
    lines = _lines(documents, min_words)
    in_doc = Window.partitionBy(*DOC)
    ahead = lines.where("f_len is not null").select(*DOC, "unit", "pos", F.col("f_len").alias("len"))
    back = lines.where("b_len is not null").select(*DOC, (F.col("unit") - F.col("b_len") + 1).alias("unit"), (F.col("pos") - F.col("b_len") + 1).alias("pos"), F.col("b_len").alias("len"))
    windows = ahead.unionByName(back).distinct()
    order = suffix_order(lines).select("pos", F.col("index").alias("suffix"), "lcp")
    # runs of a length that are equal are neighbours, as all that begin with them are runs of that length too
    windows = _ordered(windows.join(order, "pos"), ["len", "suffix"], {"key": "lcp < len"}, "run-intervals", ("len",)).where(f"NOT ({ALONE})")
    first = windows.groupBy("key").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))
    copies = salted_join(windows.select("key", *DOC, "unit", "pos", "len"), first, ["key"])
    copies = copies.where("pos > first_pos").select(*DOC, "unit", (F.col("unit") + F.col("len") - 1).alias("last"))
    order = in_doc.orderBy("unit", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("unit") > reach + 1), 1).otherwise(0)
    copies = copies.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = copies.groupBy(*DOC, "run").agg(F.min("unit").alias("first"), F.max("last").alias("last"))
    return runs.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def line_dedup(documents: DataFrame, min_words: int = MIN_WORDS, to: tuple[str, str] = ("deleted_runs", "deleted_lines")) -> DataFrame:
    """The rows and columns of ``documents`` with later copies deleted from ``text``, and in the columns ``to``, which
    replace columns of those names, the intervals of deleted units and how many units they are."""
    runs = deleted_runs(_keyed(documents.select("doc_id", "text")), min_words)
    # the input's columns travel as one, so their names can't meet those used here
    rows = _keyed(documents.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__in"))).select("__in", *DOC)
    rows = rows.join(runs.withColumnRenamed("runs", "__runs").hint("shuffle_hash"), DOC, "left")
    cut, text = F.col("__runs").isNotNull(), F.col("__in")["text"]
    rows = rows.withColumn("__units", F.when(cut, F.split(text, UNIT)))
    kept = F.expr(
        r"""array_join(flatten(transform(sequence(0, size(__runs)), i -> slice(__units,
            if(i = 0, 0, __runs[i - 1].last + 1) + 1,
            if(i = size(__runs), size(__units), __runs[i].first) - if(i = 0, 0, __runs[i - 1].last + 1)))), '\n')"""
    )
    gone = F.coalesce(F.expr("aggregate(__runs, 0, (n, r) -> n + int(r.last - r.first + 1))"), F.lit(0))
    names = [(F.when(cut, kept).otherwise(text) if c.lower() == "text" else F.col("__in")[c]).alias(c) for c in documents.columns if c not in to]
    return rows.select(*names, F.coalesce("__runs", F.array().cast("array<struct<first:int,last:int>>")).alias(to[0]), gone.alias(to[1]))
