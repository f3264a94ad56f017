"""Names against a grammar: templates of typed segments with alternatives and repeats, run as a transition table over the split name.

A template becomes states and transitions between them; a name's parts are folded through the table, keeping for every
part and state the segments matched on the way there, so a segment of several parts, a repeat or an alternative needs no
regular expression of its own and nothing is tried twice. Of several ways the one with the fewest repeats and the
shortest first segments stays. It is one expression: a name costs parts times transitions, wherever its row lies.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHED = "array<struct<type:string,value:string>>"


@dataclass(frozen=True)
class Type:
    """What a segment may be: one of ``allow``, or a text that matches one of ``patterns`` whole. ``parts``: it may hold separators."""

    name: str
    allow: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    parts: bool = False

    def holds(self, text: Column) -> Column:
        fits = [text.isin(*self.allow)] if self.allow else []
        return reduce(Column.__or__, fits + [text.rlike(f"^(?:{p})$") for p in self.patterns], F.lit(False))


@dataclass(frozen=True)
class Segment:
    """A literal (a text), a type, or types that stand side by side without a separator; ``least`` to ``most`` times (None: any)."""

    of: str | Type | tuple[Type, ...]
    least: int = 1
    most: int | None = 1


@dataclass(frozen=True)
class Rule:
    """A template of segments, a template's own segments standing for a rule in a rule, and how long a name may be."""

    name: str
    segments: tuple[Segment, ...]
    max_length: int | None = None


def _table(segments: tuple[Segment, ...]) -> tuple[int, list[tuple[int, int, Segment]], list[int]]:
    """(number of states, transitions from, to and by, accepting states); state 0 is the start."""
    states, steps, at = 1, [], [0]
    for s in segments:
        for k in range(max(s.least, s.most if s.most is not None else s.least)):
            steps += [(a, states, s) for a in at]
            at = [states] if k < s.least else [*at, states]
            states += 1
        if s.most is None:
            if s.least == 0:
                steps += [(a, states, s) for a in at]
                at, states = [*at, states], states + 1
            steps.append((states - 1, states - 1, s))
    return states, steps, at


def _glued(types: tuple[Type, ...]) -> list[list[str]]:
    out = [[]]
    for t in types:
        if not t.allow:
            raise ValueError(f"{t.name} stands side by side with others and needs a list of its values")
        out = [[*row, v] for row in out for v in t.allow]
    return out


def _taken(text: Column, segment: Segment) -> tuple[Column, Column]:
    """(does the segment hold ``text``, what is matched then)."""
    entry = lambda t, v: F.struct(F.lit(t).alias("type"), v.cast("string").alias("value"))
    if isinstance(segment.of, str):
        return text == segment.of, F.array().cast(MATCHED)
    if isinstance(segment.of, Type):
        return segment.of.holds(text), F.array(entry(segment.of.name, text))
    rows = _glued(segment.of)
    known = F.create_map(*[x for row in rows for x in (F.lit("".join(row)), F.array(*[entry(t.name, F.lit(v)) for t, v in zip(segment.of, row)]))])
    found = F.try_element_at(known, text)
    return found.isNotNull(), found


def matched(name: Column, rule: Rule, separator: str = "_") -> Column:
    """The segments (type, value) of ``name`` under ``rule``; null if it doesn't match."""
    return _run(F.split(name, separator, -1), rule, separator)


def _run(parts: Column, rule: Rule, separator: str) -> Column:
    states, steps, ends = _table(rule.segments)
    none = F.lit(None).cast(MATCHED)

    def step(before: Column, text: Column, s: Segment) -> Column:
        ok, found = _taken(text, s)
        return F.when(before.isNotNull() & ok, F.concat(before, found))

    def spanned(past: Column, k: Column, a: int, s: Segment):
        """What stands at state ``a`` after k0 parts, and then the parts up to the k-th as one text."""
        return lambda k0: step(F.get(F.get(past, k0), F.lit(a)), F.array_join(F.slice(parts, k0 + 1, k - k0), separator), s)

    def after(past: Column, k: Column) -> Column:
        vector = [none]
        for to in range(1, states):
            ways = []
            for a, b, s in steps:
                if b != to:
                    continue
                if isinstance(s.of, Type) and s.of.parts:
                    tried = F.transform(F.sequence(F.lit(0), k - 1), spanned(past, k, a, s))
                    ways.append(F.get(F.filter(tried, lambda x: x.isNotNull()), F.lit(0)))
                else:
                    ways.append(step(F.get(F.get(past, k - 1), F.lit(a)), F.get(parts, k - 1), s))
            vector.append(F.coalesce(*ways) if ways else none)
        return F.concat(past, F.array(F.array(*vector)))

    start = F.array(F.array(F.array().cast(MATCHED), *[none] * (states - 1)))
    past = F.aggregate(F.sequence(F.lit(1), F.size(parts)), start, after)
    found = F.coalesce(*[F.get(F.element_at(past, -1), F.lit(e)) for e in ends])
    return F.when(parts.isNotNull() & ~F.array_contains(parts, ""), found)


def name_checks(names: DataFrame, rules: dict[str, list[Rule]], separator: str = "_") -> DataFrame:
    """name, layer, rule (the first of its layer's that matches), segments, passed and length_ok of each of ``names`` (name,
    layer); a layer without rules passes. A name that is null matches nothing."""
    tried = [(f"__m{i}", layer, r) for i, (layer, r) in enumerate((layer, r) for layer, of in rules.items() for r in of)]
    # what a rule matches is asked once a name, and only of its own layer's names
    rows = names.select("name", "layer", F.split("name", separator, -1).alias("__parts"))
    rows = rows.select("name", "layer", *[F.when(F.col("layer") == layer, _run(F.col("__parts"), r, separator)).alias(m) for m, layer, r in tried])
    first = lambda of: F.coalesce(*[F.when(F.col(m).isNotNull(), of(m, r)) for m, _, r in tried])
    segments = first(lambda m, r: F.col(m))
    fits = F.coalesce(F.length("name") <= first(lambda m, r: F.lit(r.max_length).cast("int")), F.lit(True))
    bound = F.coalesce(F.col("layer").isin(*rules), F.lit(False))
    return rows.select("name", "layer", first(lambda m, r: F.lit(r.name)).alias("rule"), segments.alias("segments"), (segments.isNotNull() | ~bound).alias("passed"), fits.alias("length_ok"))


def alignment(checks: DataFrame, expected: DataFrame) -> DataFrame:
    """name, score_passed, score_total and violations (type=value, sorted) of matched names against what their models say; checks: as of
    ``name_checks``; expected: name, type and the values that a segment of that type may have. Segments of which nothing
    is expected don't count."""
    each = checks.where("segments is not null").select("name", F.explode("segments").alias("s")).select("name", "s.type", "s.value")
    one = expected.groupBy("name", "type").agg(F.array_distinct(F.flatten(F.collect_list("values"))).alias("values"))
    met = each.join(one, ["name", "type"]).withColumn("ok", F.coalesce(F.array_contains("values", F.col("value")), F.lit(False)))
    bad = F.array_sort(F.collect_set(F.when(~F.col("ok"), F.concat_ws("=", "type", "value"))))
    return met.groupBy("name").agg(F.sum(F.col("ok").cast("long")).alias("score_passed"), F.count(F.lit(1)).alias("score_total"), bad.alias("violations"))
