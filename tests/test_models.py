"""Naming grammars, entity codes, metric references, rules as data and cached results beyond the queries' own data."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType
from terrace.operators import assess, rules, semantics
from terrace.operators.naming import Rule, Segment, Type, alignment, matched, name_checks
from terrace.sources.task_cache import TaskCache, keyed

A, B, W = Type("A", allow=("x", "y")), Type("B", patterns=("[a-c]+",)), Type("W", patterns=("[a-z][a-z_]*",), parts=True)
P, Q = Type("P", allow=("D", "M")), Type("Q", allow=("I", "F"))


@pytest.mark.parametrize("segments,pattern", [
    ((Segment("t"), Segment(A), Segment(B, 1, 2), Segment(W), Segment((P, Q))), r"t_(x|y)_[a-c]+(_[a-c]+)?_[a-z][a-z_]*_[DM][IF]"),
    ((Segment(A, 0, 1), Segment(B, 0, None), Segment("end")), r"((x|y)_)?([a-c]+_)*end"),
    ((Segment(B, 2, None),), r"[a-c]+(_[a-c]+)+"),
    ((Segment(W), Segment("t"), Segment(W)), r"[a-z][a-z_]*_t_[a-z][a-z_]*"),
])
def test_grammar_accepts_what_a_regular_expression_does(spark, segments, pattern):
    rnd = random.Random(3)
    parts = ["t", "x", "y", "a", "bc", "foo", "DI", "MF", "D", "end", "a1", ""]
    names = sorted({"_".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6))) for _ in range(1500)} | {"t_x_a_foo_DI", "t_x_a_b_foo_DI", "x_end", "end", "x_a_bc_end", "a_bc", "foo_t_foo", "t_t_t"})
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", matched(F.col("name"), Rule("r", segments)).alias("m")).collect()
    want = {n for n in names if re.fullmatch(pattern, n) and "" not in n.split("_")}
    assert {r.name for r in got if r.m is not None} == want and want
    for r in got:
        if r.m is not None:  # what was matched stands in the name in order
            assert re.search(".*".join(re.escape(s.value) for s in r.m), r.name)


def test_fewest_repeats_first_and_alignment(spark):
    rule = Rule("r", (Segment("t"), Segment(B, 1, 2), Segment(W)), 8)
    names = spark.createDataFrame([("t_a_b_foo", "L"), ("t_a_foo", "L"), ("nothing", "L"), (None, "L"), ("free", "other"), ("free", None)], "name string, layer string")
    got = {(r.name, r.layer): r for r in name_checks(names, {"L": [rule]}).collect()}
    assert [(s.type, s.value) for s in got["t_a_b_foo", "L"].segments] == [("B", "a"), ("W", "b_foo")] and not got["t_a_b_foo", "L"].length_ok
    assert {k: r.passed for k, r in got.items()} == {("t_a_b_foo", "L"): True, ("t_a_foo", "L"): True, ("nothing", "L"): False, (None, "L"): False, ("free", "other"): True, ("free", None): True}
    expected = spark.createDataFrame([("t_a_foo", "B", ["a", "z"]), ("t_a_foo", "W", ["bar"]), ("t_a_b_foo", "Z", ["q"])], "name string, type string, values array<string>")
    rows = alignment(name_checks(names, {"L": [rule]}), expected).collect()
    assert [(r.name, r.score_passed, r.score_total, r.violations) for r in rows] == [("t_a_foo", 1, 2, ["W=foo"])]


def _dims(spark, rows):
    return spark.createDataFrame(rows, "table_name string, code string, keys array<string>")


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src string, src_column string, dst string, dst_column string")


def test_connected_dimensions_share_one_code(spark):
    dims = _dims(spark, [("a", "Cust", ["id"]), ("b", "Client", ["ID"]), ("c", None, ["id", "part"]), ("x", "One", ["k"]), ("y", "Two", ["k"]), ("z", "Three", ["k"]), ("lone", "L", ["id"]), ("half", "H", ["id", "other"])])
    edges = _edges(spark, [("a", "id", "B", "id"), ("b", "id", "c", "ID"), ("b", "id", "c", "part"), ("x", "k", "z", "k"), ("y", "k", "z", "k"), ("a", "id", "half", "id"), ("lone", "nokey", "a", "id")])
    of = lambda known: {(r.table_name, r.new_code) for r in semantics.dimension_codes(dims, edges, spark.createDataFrame([(k,) for k in known], "code string")).collect()}
    assert of([]) == {("b", "Cust"), ("c", "Cust")}  # two roots compete for z
    assert of(["client", "THREE"]) == {("a", "client"), ("c", "client"), ("x", "THREE"), ("y", "THREE")}
    assert of(["client", "cust"]) == set()


def test_foreign_codes_conflicts_and_ties(spark):
    dims = _dims(spark, [("d1", "One", ["k1", "k2"]), ("d2", "Two", ["k2"]), ("d3", "", ["k3"])])
    ents = spark.createDataFrame([
        ("both", 0, "foreign", "o", ["a", "b"]),  # a says One, b One or Two: One
        ("tie", 0, "foreign", "o", ["a"]),  # One or Two, and no dimension has a key named a
        ("twice", 0, "foreign", "o", ["a"]), ("twice", 1, "foreign", "p", ["b"]),  # both would be One
        ("held", 0, "primary", "ONE", ["id"]), ("held", 1, "foreign", "o", ["a"]),
        ("named", 0, "foreign", None, ["K1"]), ("vague", 0, "foreign", "o", ["k2"]), ("right", 0, "foreign", "one", ["a"]), ("none", 0, "foreign", "o", None)],
        "table_name string, nth int, type string, code string, keys array<string>")
    edges = _edges(spark, [("d1", "k1", "both", "a"), ("d1", "k2", "both", "b"), ("d2", "k2", "both", "b"), ("d1", "k1", "tie", "a"), ("d2", "k2", "tie", "a"), ("d1", "k1", "twice", "a"), ("d1", "k2", "twice", "b"),
                           ("d1", "k1", "held", "a"), ("d1", "other", "named", "z"), ("d1", "x", "vague", "z"), ("d2", "x", "vague", "z"), ("d1", "k1", "right", "a"), ("d3", "k3", "none", "a")])
    got = {(r.table_name, r.nth, r.new_code) for r in semantics.foreign_codes(ents, dims, edges).collect()}
    assert got == {("both", 0, "One"), ("named", 0, "One")}


def test_table_names_may_be_short_in_references(spark):
    s = "string"
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} {s}" for n in names.split()))
    derived = frame([("f", "m1", "amt", "s.t"), ("f", "m2", "amt", "T"), ("f", "m3", "amt", "u"), ("f", None, "amt", None), ("f", "m4", None, None)], "table_name name base_metric base_table")
    atomic = frame([("F", "S.T", "AMT"), ("f", "a.u", "amt"), ("f", "b.u", "amt")], "table_name metric_table metric")
    got = semantics.metric_relation_problems(derived, atomic, frame([("f", "s.t")], "table_name metric_table"), frame([("f", "q")], "table_name metric_table").where("false"), frame([("f", "m", "b", "q")], "table_name name base_metric metric_table"))
    assert sorted((r.problem, r.item) for r in got.collect()) == [("invalid_base_metric_table", "m3:u"), ("missing_base_metric", "m4")]


def test_all_rules_are_asked_in_one_scan(spark, tmp_path):
    from terrace.plans.models import _candidates, candidate_rules
    from conftest import SF

    assert len(candidate_rules()) >= 20
    plan = rules.violations(_candidates(spark, SF), "name", candidate_rules())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_rules_hold_for_nulls_and_empty_rows(spark):
    df = spark.createDataFrame([("a", None, None), ("b", [], "x"), ("c", ["p", "P", None, "q"], None)], "t string, items array<string>, v string")
    asked = [rules.Rule("twice", "d", "low", rules.repeated(F.col("items"))), rules.Rule("null_v", "d", "high", rules.when(F.col("v").isNull(), "v"), F.col("t") != "c"),
             rules.Rule("q", "d", "low", rules.those(F.col("items"), lambda x: x == "q", lambda x: x)), rules.Rule("compares_with_null", "d", "low", rules.when(F.col("v") > "w", F.col("v")))]
    assert sorted((r.target, r.rule, r["item"]) for r in rules.violations(df, "t", asked).collect()) == [("a", "null_v", "v"), ("b", "compares_with_null", "x"), ("c", "q", "q"), ("c", "twice", "p")]
    checks = rules.checks(df, "t", asked)
    assert checks.count() == 11 and checks.where("not passed").count() == 4
    assert rules.status(rules.violations(df, "t", asked)).first()[:] == ("blocked", 4) and rules.status(rules.violations(df.where("false"), "t", asked)).first()[:] == ("passed", 0)


TASK = "task string, sql string, schema_slice string, config string"


def test_only_changed_tasks_are_computed_again(spark, tmp_path):
    asked = []

    def compute(left):
        asked.append(sorted(r.task for r in left.collect()))
        return left.select("key", F.col("sql").alias("out"), F.length("sql").cast("long").alias("n"))

    kind = StructType().add("out", StringType()).add("n", LongType())
    cache = lambda version="1": TaskCache(spark, str(tmp_path / "cache"), version, kind)
    one = spark.createDataFrame([("a", "s1", "x", None), ("b", "s2", None, "x"), ("c", "s2", "x", None)], TASK)
    assert sorted(r.out for r in cache().run(one, compute).collect()) == ["s1", "s2", "s2"]
    assert cache().run(one, compute).count() == 3 and asked == [["a", "b", "c"]]
    two = one.withColumn("schema_slice", F.when(F.col("task") == "b", "y").otherwise(F.col("schema_slice")))
    cache().run(two, compute)
    assert asked[1:] == [["b"]]
    cache().put(compute(keyed(one, "1")))  # another writer of the same results
    assert cache().get(one).count() == 3
    cache("2").run(one, compute)
    assert asked[-1] == ["a", "b", "c"] and cache("2").evict() == ["1"] and cache().get(one).count() == 0 and cache("2").get(one).count() == 3


def test_keys_of_different_tasks_differ(spark):
    values = [None, "", "a", "a\x1f", "\x1fa", "null"]
    rows = [("t", *v) for v in itertools.product(values, repeat=3)]
    assert keyed(spark.createDataFrame(rows, TASK), "1").select("key").distinct().count() == len(rows)


def test_weights_of_projects(spark):
    of = lambda rows: {(r.project, r.dimension): r.weight for r in assess.weights(spark.createDataFrame(rows, "project string, dimension string, weight double")).collect()}
    got = of([("p", "reuse", 0.0), ("q", "nothing", 5.0), (None, "depth", None)])
    assert got["p", "reuse"] == 0 and got["p", "depth"] == round(0.18 / 0.82, 6) and got["q", "reuse"] == 0.18 and got[None, "naming"] == 0.18 and len(got) == 21
    for bad in ([("p", "reuse", -1.0)], [("p", d, 0.0) for d in assess.WEIGHTS]):
        with pytest.raises(Exception, match="weights must be"):
            of(bad)
