"""Cycles, windows up the lineage, canonical JSON, stored tables, snapshots, appends and comparisons beyond the queries' own data."""

import datetime as dt
import hashlib
import json
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from terrace.operators import assess, canonical, cycles, etl, graph, periods, quality, verify
from terrace.operators.stored import Conflict, StoredTable
from terrace.sources import snapshot


def _closure(edges):
    reach = defaultdict(set)
    for a, b in edges:
        reach[a].add(b)
    for k in list({x for e in edges for x in e}):
        for a in list(reach):
            if k in reach[a]:
                reach[a] |= reach[k]
    return reach


@pytest.mark.parametrize("n,m", [(6, 5), (12, 18), (20, 45)])
def test_components_equal_brute_force(spark, n, m):
    rnd = random.Random(n)
    edges = {(f"t{rnd.randrange(n)}", f"T{rnd.randrange(n)}".lower()) for _ in range(m)} | {("loop", "loop"), ("x", "y"), ("y", "x")}
    reach = _closure({(a, b) for a, b in edges if a != b})
    want = {}
    for a in {x for e in edges for x in e}:
        mates = {b for b in reach[a] if a in reach[b]} | {a}
        if len(mates) > 1:
            want[a] = min(mates)
    got = cycles.components(spark.createDataFrame([(a.upper(), f" {b}") for a, b in edges], "src string, dst string"))
    assert {r.node: r.component for r in got.collect()} == want


def test_no_cycle_no_rows(spark):
    assert cycles.components(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a")], "src string, dst string")).count() == 0
    assert cycles.components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_depth_counts_the_middle_tables_of_a_cycle_once(spark):
    models = spark.createDataFrame([("o", "ODS"), ("p", "DWD"), ("q", "DWS"), ("r", "DIM"), ("z", "ADS"), ("y", "ADS")], "name string, layer string")
    edges = spark.createDataFrame([("o", "p"), ("p", "q"), ("q", "p"), ("q", "z"), ("r", "y"), ("z", "y")], "src string, dst string")
    assert {r.name: (r.depth, r.score) for r in assess.depth_scores(models, edges).collect()} == {"z": (2, 100), "y": (2, 100)}
    with pytest.raises(graph.CycleError, match="p, q"):
        graph.levels(models.select(F.col("name").alias("node")), edges)


def test_windows_go_up_the_whole_lineage(spark):
    """A month upstream of a day widens all that is above it; unrelated tables keep their own windows."""
    at = lambda y, m, d: dt.datetime(y, m, d)
    edges = spark.createDataFrame([("order_detail", "sales_monthly"), ("sales_monthly", "daily_report"), ("inventory", "alert"), ("customer", "performance"), ("raw", "order_detail"), ("file", "raw")], "src string, dst string")
    kinds = spark.createDataFrame([("order_detail", "D"), ("sales_monthly", "M"), ("daily_report", "D"), ("inventory", "D"), ("alert", "D"), ("customer", "D"), ("performance", "M"), ("file", "W")], "table_name string, period string")
    anchors = spark.createDataFrame([("daily_report", at(2024, 6, 15), at(2024, 6, 16)), ("ALERT", at(2024, 6, 15), at(2024, 6, 16)), ("performance", at(2024, 6, 15), at(2024, 6, 16)), ("alert", at(2024, 6, 1), at(2024, 6, 1))], "table_name string, start timestamp_ntz, end timestamp_ntz")
    windows = periods.along_lineage(anchors, kinds, edges)
    got = {r.table_name: (r.period, r.start, r["end"], r.anchors) for r in windows.collect()}
    june = (at(2024, 6, 1), at(2024, 7, 1))
    assert got == {
        "daily_report": ("D", at(2024, 6, 15), at(2024, 6, 16), ["daily_report"]), "sales_monthly": ("M", *june, ["daily_report"]), "order_detail": ("D", *june, ["daily_report"]), "raw": (None, *june, ["daily_report"]),
        "file": ("W", at(2024, 5, 27), at(2024, 7, 1), ["daily_report"]), "alert": ("D", at(2024, 6, 15), at(2024, 6, 16), ["alert"]), "inventory": ("D", at(2024, 6, 15), at(2024, 6, 16), ["alert"]),
        "performance": ("M", *june, ["performance"]), "customer": ("D", *june, ["performance"])}
    values = defaultdict(list)
    for r in periods.execution_values(windows).orderBy("period_start").collect():
        values[r.table_name].append(r.period_start)
    assert len(values["order_detail"]) == 30 and values["sales_monthly"] == [at(2024, 6, 1)] and len(values["file"]) == 5 and "raw" not in values
    with pytest.raises(ValueError, match="cycle"):
        periods.along_lineage(anchors, kinds, edges.union(spark.createDataFrame([("daily_report", "file"), ("file", "daily_report")], "src string, dst string")))


def test_windows_that_touch_are_one_and_others_stay_apart(spark):
    day = lambda d: dt.datetime(2024, 6, d)
    anchors = spark.createDataFrame([("a", day(3), day(4)), ("b", day(4), day(6)), ("c", day(20), day(21))], "table_name string, start timestamp_ntz, end timestamp_ntz")
    edges = spark.createDataFrame([("up", "a"), ("up", "b"), ("up", "c")], "src string, dst string")
    got = periods.along_lineage(anchors, spark.createDataFrame([("up", "D")], "table_name string, period string"), edges).where("table_name = 'up'")
    assert sorted((r.start, r["end"], r.anchors) for r in got.collect()) == [(day(3), day(6), ["a", "b"]), (day(20), day(21), ["c"])]


NESTED = "a struct<z:string,y:array<struct<k:bigint,s:string>>>, m map<string,string>, t timestamp_ntz, x double, n string"
_text = st.one_of(st.none(), st.text(st.characters(blacklist_categories=("Cs", "Cc")), max_size=6), st.sampled_from(["null", '"', "\\", "a:b", ",", "{}", "[", "", "\n", "\t"]))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.tuples(_text, st.one_of(st.none(), st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), _text), max_size=3)))), st.one_of(st.none(), st.dictionaries(st.text("ab:\"\\", max_size=3), _text, max_size=3)), st.just(None), st.one_of(st.none(), st.sampled_from([0.5, 1.0, -2.25])), _text), min_size=30, max_size=60))
def test_canonical_json_is_that_of_the_standard_library(spark, rows):
    df = spark.createDataFrame(rows, NESTED)
    got = df.select(canonical.row_json(df.schema).alias("j"), "*").collect()
    for r in got:
        a = None if r.a is None else {"z": r.a.z, "y": None if r.a.y is None else [{"k": e.k, "s": e.s} for e in r.a.y]}
        assert r.j == json.dumps({"a": a, "m": r.m, "t": None, "x": r.x, "n": r.n}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    values = {json.dumps([r.a, r.m, r.x, r.n], sort_keys=True) for r in got}
    assert len({r.j for r in got}) == len(values)


def test_times_keep_their_parts_and_column_order_does_not_matter(spark):
    df = spark.sql("select timestamp_ntz '2024-01-01 00:00:00.000001' t, timestamp_ntz '2024-01-01 00:00:00.000002' u, cast(1.50 as decimal(5,2)) d, unhex('00ff') b, named_struct('b', 1, 'a', 2) s, map(2, 'x', 1, 'y') m")
    one, two = (df.select(canonical.row_json(df.select(*c).schema).alias("j")).first().j for c in (["t", "u", "d", "b", "s", "m"], ["m", "s", "b", "d", "u", "t"]))
    assert one == two == '{"b":"00FF","d":"1.50","m":{"1":"y","2":"x"},"s":{"a":2,"b":1},"t":"2024-01-01 00:00:00.000001","u":"2024-01-01 00:00:00.000002"}'


def test_context_fingerprints_do_not_meet(spark):
    def of(local, ups):
        row = spark.createDataFrame([(local, [dict(zip(("upstream_table_id", "upstream_semantic_context_fingerprint", "upstream_resolved_mode"), u)) for u in ups])], f"local string, ups array<{verify.UPSTREAM}>")
        return row.select(verify.context_fingerprint(F.col("local"), F.col("ups")).alias("f")).first().f

    seen = [of("l", [("a", "f", "m"), ("b:c", "f", "m")]), of("l", [("a:b", "f", "m"), ("c", "f", "m")]), of("l", [("a", None, "m")]), of("l", [("a", "m", None)]), of(None, []), of("", [])]
    assert len(set(seen)) == len(seen) and of("l", [("b", "g", "n"), ("a", "f", "m")]) == of("l", [("a", "f", "m"), ("b", "g", "n")])
    text = json.dumps({"fingerprint_version": 1, "local_change_fingerprint": "l", "affected_upstreams": [{"upstream_table_id": "a", "upstream_semantic_context_fingerprint": "m", "upstream_resolved_mode": None}]}, sort_keys=True, separators=(",", ":"))
    assert seen[3] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_a_stale_declaration_isnt_looked_up_in_history(spark):
    facts = spark.createDataFrame([("a", "f", "equivalent", None, None), ("b", "g", None, "equivalent", "old")], "table_name string, local_fingerprint string, automatic_mode string, declared_mode string, declared_context string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    now = {r.table_name: r for r in verify.resolve_modes(facts, edges).collect()}
    history = spark.createDataFrame([(t, now[t].fingerprint, mode, run, at) for t, mode, run, at in [("a", "changed", "r1", 1), ("a", "equivalent", "r2", 2), ("a", "nonsense", "r3", 3), ("b", "changed", "r1", 1)]], "table_id string, context string, mode string, run_id string, at int")
    got = {r.table_name: (r.mode, r.source, r.run_id) for r in verify.resolve_modes(facts, edges, history).collect()}
    assert got == {"a": ("equivalent", "inherited_user", "r2"), "b": ("unknown", "default_unknown", None)}


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_writer_replaces_only_its_own_rows(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"))
    part = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    assert t.replace_all({"odd": part(1, 3), "even": part(2)}) == 1
    before = t.latest()[1]["owners"]
    t.replace(t.read(["odd"]).selectExpr("v + 10 as v"), "odd")
    assert _rows(t.read()) == [(2,), (11,), (13,)] and _rows(t.read(["even"])) == [(2,)]
    assert t.latest()[1]["owners"]["even"] == before["even"]
    with pytest.raises(ValueError, match="other columns"):
        t.replace(spark.createDataFrame([("x",)], "v string"), "odd")
    t.replace(spark.createDataFrame([], "v int"), "even")
    assert _rows(t.read()) == [(11,), (13,)]


def test_writers_cannot_undo_each_other(spark, tmp_path):
    part = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    a, b = (StoredTable(spark, str(tmp_path / "t")) for _ in range(2))
    a.replace_all({"odd": part(1), "even": part(2)})
    since = b.latest()[0]
    a.replace(part(5), "odd")
    b.replace(part(4), "even", since)  # another owner's rows: both stay
    assert _rows(a.read()) == [(4,), (5,)]
    for late in (lambda: b.replace(part(9), "odd", since), lambda: b.replace_all({"odd": part(9)}, since)):
        with pytest.raises(Conflict):
            late()
    assert _rows(a.read()) == [(4,), (5,)]


def test_a_break_off_at_any_step_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    part = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    StoredTable(spark, path).replace_all({"all": part(1, 2)})
    # before the data are written, after that, and in the middle of the version's file
    bad = part(1).select(F.raise_error(F.lit("lost")).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        StoredTable(spark, path).replace_all({"all": bad})
    broken = StoredTable(spark, path)
    monkeypatch.setattr(broken, "_commit", lambda change: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        broken.replace_all({"all": part(7)})
    (tmp_path / "t" / "versions" / f"{2:020d}.json").write_text('{"schema"')
    assert _rows(StoredTable(spark, path).read()) == [(1,), (2,)]
    assert StoredTable(spark, path).replace_all({"all": part(3)}) == 3 and _rows(StoredTable(spark, path).read()) == [(3,)]
    with pytest.raises(ValueError, match="no version"):
        StoredTable(spark, str(tmp_path / "none")).read()


def test_appended_rows_take_the_types_of_the_target(spark, tmp_path):
    p = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no rows yet"):
        etl.append_aligned(spark.range(1), p)
    etl.append_aligned(spark.createDataFrame([(1, "a", 2.0, 9)], "k int, s string, d double, b long"), p, "k long, s string, d double, b long")
    etl.append_aligned(spark.createDataFrame([(7,)], "K int"), p)
    assert spark.read.parquet(p).dtypes == [("k", "bigint"), ("s", "string"), ("d", "double"), ("b", "bigint")]
    assert sorted(map(tuple, spark.read.parquet(p).collect())) == [(1, "a", 2.0, 9), (7, None, None, None)]
    for df, schema in ((spark.range(1), None), (spark.createDataFrame([(1,)], "k int"), "k long")):
        with pytest.raises(ValueError):
            etl.append_aligned(df, p, schema)


def test_snapshot_ids_are_texts_and_broken_files_are_reported(spark, tmp_path):
    good = {"project": "007", "tables": [{"name": "a", "layer": "ODS", "columns": ["c"]}, {"name": "b", "layer": "DWD", "columns": ["c"]}], "jobs": [{"name": "j", "inputs": ["a"], "outputs": ["b"]}], "edges": [{"job": "j", "src": "a", "src_column": "c", "dst": "b", "dst_column": "c"}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.json").write_text(json.dumps(good))
    (tmp_path / "in" / "cut.json").write_text(json.dumps({**good, "project": "008"})[:-30])
    s = snapshot.read_snapshots(spark, str(tmp_path / "in"))
    assert [(r.kind, r.name, r.problem) for r in snapshot.validate_snapshot(s).collect()] == [("file", "cut.json", "not a snapshot")]
    path = str(tmp_path / "store")
    snapshot.save_snapshot(snapshot.build_snapshot([s]), path, "0042")
    assert snapshot.count_problems(s, spark, path, "0042").count() == 0
    snapshot.activate(spark, path, "007", "0042", "2024")
    assert sorted((r.project, r.snapshot_id, r.name) for r in snapshot.load_active(spark, path, "tables").collect()) == [("007", "0042", "a"), ("007", "0042", "b")]


def test_cycles_of_a_snapshot_are_named(spark):
    edges = spark.createDataFrame([("P", "j", "a", "c", "b", "c"), ("P", "k", "B", "c", "a", "c"), ("q", "j", "a", "c", "b", "c")], "project string, job string, src string, src_column string, dst string, dst_column string")
    jobs = spark.createDataFrame([("P", "j", ["a"], ["b"]), ("P", "k", ["b"], ["a"]), ("q", "j", ["a"], ["b"])], "project string, name string, inputs array<string>, outputs array<string>")
    got = snapshot.cycle_problems({"edges": edges, "jobs": jobs})
    assert sorted(map(tuple, got.collect())) == [("P", "job", "j", "in the cycle of j"), ("P", "job", "k", "in the cycle of j"), ("P", "table", "a", "in the cycle of a"), ("P", "table", "b", "in the cycle of a")]


def test_repeated_keys_within_the_tolerance(spark):
    """Against brute force: equal counts of each exact part, and some pairing of the floats within the tolerance."""
    rnd = random.Random(9)
    side = lambda: [(rnd.randrange(12), rnd.choice(["x", None]), rnd.choice([1.0, 1.004, 1.008, 1.012, 1.02, None])) for _ in range(60)]
    a = side()
    b = [(k, s, v if v is None or rnd.random() < 0.7 else v + 0.006) for k, s, v in a if rnd.random() < 0.97]
    df = lambda rows: spark.createDataFrame(rows, "k int, s string, v double")
    got = {r.k for r in quality.compare_keyed(df(a), df(b), ["k"], tolerance=0.01).collect()}

    def fit(x, y):
        parts = [defaultdict(list) for _ in range(2)]
        for part, rows in zip(parts, (x, y)):
            for _, s, v in rows:
                part[s].append(v)
        near = lambda p, q: p is None and q is None or None not in (p, q) and abs(p - q) <= 0.01
        order = lambda v: sorted(v, key=lambda z: (z is not None, z or 0))
        return parts[0].keys() == parts[1].keys() and all(len(parts[0][s]) == len(parts[1][s]) and all(map(near, order(parts[0][s]), order(parts[1][s]))) for s in parts[0])

    keys = {k for k, *_ in a + b}
    assert got == {k for k in keys if not fit([r for r in a if r[0] == k], [r for r in b if r[0] == k])}
    assert quality.compare_keyed(df([(1, "x", 1.0), (1, "x", 2.0)]), df([(1, "x", 2.001), (1, "x", 1.001)]), ["k"]).count() == 0


def test_applications_may_read_dimensions(spark):
    models = spark.createDataFrame([("m", "DIM"), ("a", "ADS"), ("d", "DWD"), ("o", "ODS"), ("s", "DWS")], "name string, layer string")
    edges = spark.createDataFrame([("m", "a"), ("d", "a"), ("a", "m"), ("o", "a"), ("d", "m"), ("m", "s")], "src string, dst string")
    assert {(r.src, r.dst): r.kind for r in assess.dependency_classes(models, edges).collect()} == {("m", "a"): "next", ("d", "a"): "skip", ("a", "m"): "reverse", ("o", "a"): "skip", ("d", "m"): "same", ("m", "s"): "next"}
    assert {(r.src, r.dst) for r in assess.layer_violations(models, edges).collect()} == {("d", "a"), ("a", "m"), ("o", "a")}


def test_columns_without_ids_are_compared_by_name(spark):
    kind = "table_id string, column_id string, name string, data_type string, nullable boolean, default_value string, comment string"
    old = spark.createDataFrame([("t", None, "a", "int", True, None, None), ("t", None, "b", "int", True, None, "x"), (None, None, "c", "int", True, "1", None), ("t", "i1", "d", "int", True, None, None), ("t", "i2", "e", "int", True, None, None)], kind)
    assert assess.schema_diff(old, old).count() == 0
    new = spark.createDataFrame([("t", None, "A", "INT", None, None, ""), ("t", None, "b", "bigint", True, None, "x"), (None, None, "c", "int", True, None, None), ("t", "i1", "dd", "int", True, None, None), ("t", None, "e", "int", True, None, None)], kind)
    got = {(r.change, r.old_name, r.new_name) for r in assess.schema_diff(old, new).collect()}
    assert got == {("modify", "b", "b"), ("modify", "c", "c"), ("rename", "d", "dd"), ("drop", "e", None), ("add", None, "e")}


def test_only_facts_must_describe_all_columns(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "table_name string, name string")
    declared, returned = pairs([("f", "a"), ("f", "b"), ("d", "a"), ("d", "b"), ("u", "a")]), pairs([("F", "A"), ("d", "a"), ("d", "A"), ("d", "z"), ("none", "a")])
    got = sorted((r.table_name, r.name, r.problem) for r in assess.validate_columns(declared, returned, spark.createDataFrame([("F",)], "table_name string")).collect() if r.name)
    assert got == [("d", "a", "duplicate"), ("d", "z", "unknown"), ("f", "b", "missing")]
    none = assess.validate_columns(declared, returned, spark.createDataFrame([("F",)], "table_name string")).where("problem = 'unavailable'").collect()
    assert [(r.table_name, r.name) for r in none] == [("none", None)]


def test_levels_read_no_broadcast(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "c")], "src string, dst string")
    got = graph.levels(edges.selectExpr("src as node").union(edges.selectExpr("dst")), edges)
    assert {tuple(r) for r in got.collect()} == {("a", 0), ("x", 0), ("b", 1), ("c", 2)}
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_windows_by_levels_are_those_of_the_walk(spark):
    rng = random.Random(4)
    edges = spark.createDataFrame([(f"t{b}", f"t{a}") for b in range(1, 14) for a in {rng.randrange(b) for _ in range(2)}], "src string, dst string")
    kinds = spark.createDataFrame([(f"t{i}", rng.choice("HDWM")) for i in range(0, 14) if i % 4], "table_name string, period string")
    anchors = spark.createDataFrame([(f"t{rng.randrange(3)}", day, day + dt.timedelta(hours=rng.choice([5, 24, 40]))) for day in (dt.datetime(2024, 1, 28) + dt.timedelta(days=k) for k in range(0, 4))], "table_name string, start timestamp_ntz, end timestamp_ntz")
    first = anchors.withColumn("anchors", F.array("table_name"))
    want = periods._merged(periods._walked(first, kinds, edges, 1)).collect()
    got = periods.along_lineage(anchors, kinds, edges).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 14


def test_keyed_comparison_is_dealt_by_size(spark):
    """A task of row_compare_keyed held 64 MB of shuffled rows of both sides, some 3 million; now it gets a number of rows, however large the sides are."""
    a = spark.range(1000).select(F.col("id").alias("k"), F.col("id").cast("double").alias("v"))
    b = a.where("k <> 7").withColumn("v", F.when(F.col("k") == 9, 0.0).otherwise(F.col("v")))
    left, right = quality.dealt_alike(a, b, ["k"], rows=100)
    assert left.rdd.getNumPartitions() == right.rdd.getNumPartitions() == 11
    first = lambda x: x.groupBy("k").agg(F.min("v").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = quality.compare_keyed(first(left), first(right), ["k"], tolerance=None)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert sorted(tuple(r) for r in out.collect()) == [(7, "left", ["v"]), (9, "both", ["v"])]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
