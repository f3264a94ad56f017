import datetime as dt

import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F
from terrace.functions import in_month, safe_ratio
from terrace.operators import assess, etl, graph, periods, quality, ranking, schema, verify
from terrace.plans import checks, lineage, metadata, models, network, sales, stored, streams
from terrace.sources import snapshot

MODULES = (sales, checks, metadata, lineage, stored, network, models, streams)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
JOB_EDGES = "job string, src string, dst string, src_temp boolean, dst_temp boolean"
SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, SQL[name])


def test_latest_version_breaks_ties_and_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (None, 1, 3, "c"), (2, 1, 4, None)], "k int, ts int, id int, v string")
    assert sorted(etl.latest_version(df, ["k"], ["ts", "id"]).select("id").toPandas().id) == [2, 3, 4]
    assert etl.latest_version(df.where("id > 9"), ["k"], ["ts", "id"]).count() == 0


@pytest.mark.parametrize("n", [0, 3, 5, 17, 200])
def test_ntile_equals_the_window_function(spark, n):
    """Two scores at once; one has nulls, in the other most rows share a value."""
    from pyspark.sql import Window

    df = spark.range(n).select("id", F.expr("nullif(id * 7 % 5, 2)").cast("double").alias("v"), F.when(F.col("id") % 9 == 0, F.col("id")).otherwise(3).alias("w"))
    want = df.select("id", *[F.ntile(5).over(Window.orderBy(c, "id")).alias(t) for c, t in (("v", "a"), ("w", "b"))]).orderBy("id").collect()
    assert ranking.ntile_of(df, 5, {"a": "v", "b": "w"}, "id").select("id", "a", "b").orderBy("id").collect() == want


def test_slices_are_replaced_alone(spark, tmp_path):
    p = str(tmp_path / "t")
    day = lambda rows: spark.createDataFrame(rows, "v int, d string")
    etl.overwrite_slices(day([(1, "2024-01-01"), (2, "2024-01-02")]), p, "d")
    etl.overwrite_slices(day([(9, "2024-01-02")]), p, "d")
    assert sorted(r.v for r in spark.read.parquet(p).collect()) == [1, 9]


def test_compare_rules(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y"), (3, 2.0, "z")], "k int, v double, ETL_TIME string")
    b = spark.createDataFrame([(1, 1.005, "q"), (2, None, "y"), (4, 2.0, "z")], "k int, w double, etl_time string")
    got = quality.compare_keyed(a, b, ["k"], ["etl_time"], {"v": "w"}).collect()
    assert sorted((r.k, r.side) for r in got) == [(3, "left"), (4, "right")]
    assert quality.compare_keyed(a, a, ["k"]).count() == 0
    assert {r.extra for r in quality.compare_multisets(a, a.union(a.limit(1))).collect()} == {-1}
    with pytest.raises(ValueError):
        quality.compare_multisets(a, b, ["k", "v", "etl_time"])


def test_null_and_repeated_keys_are_compared(spark):
    a = spark.createDataFrame([(None, 1.0), (1, 2.0), (1, 2.0), (2, 5.0), (2, 6.0), (3, 1.0)], "k int, v double")
    assert quality.compare_keyed(a, a, ["k"]).count() == 0
    b = spark.createDataFrame([(None, 9.0), (1, 2.0), (2, 6.0), (2, 5.0), (3, 1.001)], "k int, v double")
    assert {(r.k, r.side, tuple(r["columns"])) for r in quality.compare_keyed(a, b, ["k"]).collect()} == {(None, "both", ("v",)), (1, "repeated", ())}
    assert quality.compare_positions(a, a, ["k", "v"]).count() == 0
    got = {(r.position, r.side) for r in quality.compare_positions(a, a.where("v < 6"), ["k", "v"]).collect()}
    assert got == {(5, "both"), (6, "left")}


def test_writers_align_and_keep_others(spark, tmp_path):
    p = str(tmp_path / "a")
    with pytest.raises(ValueError):
        etl.append_aligned(spark.createDataFrame([(1, 2)], "a int, z int"), p, ["a", "b"])
    etl.full_refresh(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), p)
    etl.rewrite_owned(spark, p, spark.createDataFrame([(1, "new"), (4, "not owned")], "k int, v string"), F.col("k") == 1)
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [(1, "new"), (2, "y")]


def test_a_dimension_with_a_key_twice_raises(spark):
    facts = spark.createDataFrame([(1,), (None,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(Exception, match="twice"):
        etl.with_dimension(facts, dim, {"k": "k"}, ["v"]).collect()
    assert {r.v for r in etl.with_dimension(facts, dim.where("v <> 'b'"), {"k": "k"}, ["v"]).collect()} == {"a", None}


def test_names_meet_whatever_their_case(spark):
    io = spark.createDataFrame([("load", "Dwd_Order", "OUTPUT"), ("use", "dwd_order", "INPUT"), ("USE", "Ads_X", "OUTPUT")], "job string, table_name string, io_type string")
    assert [tuple(r) for r in graph.producers(io).collect()] == [("use", "dwd_order", "resolved", "load")]
    assert [(r.upstream, r.downstream) for r in graph.schedule_candidates(io).collect()] == [("load", "use")]
    known = spark.createDataFrame([("A",), ("a",), ("Bc",)], "name string")
    asked = spark.createDataFrame([("A",), ("BC",), ("x",)], "name string")
    assert {(r.name, r.resolved, r.status) for r in graph.resolve(asked, known).collect()} == {("A", "A", "exact"), ("BC", "Bc", "folded"), ("x", None, "unknown")}


def test_paths_have_no_bound_of_their_own(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(13)], "src string, dst string")
    assert graph.simple_paths(e, spark.createDataFrame([("n0",)], "node string")).count() == 14


def test_schedule_gaps_need_a_path(spark):
    io = spark.createDataFrame([("a", "t", "OUTPUT"), ("c", "t", "INPUT"), ("c", "u", "OUTPUT"), ("d", "u", "INPUT")], "job string, table_name string, io_type string")
    plan = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert [(r.upstream, r.downstream) for r in graph.schedule_gaps(io, plan).collect()] == [("c", "d")]


def test_declarations_hold_only_in_their_context(spark):
    facts = spark.createDataFrame([("a", "f", "equivalent", None, None), ("b", "g", None, "equivalent", "?")], "table_name string, local_fingerprint string, automatic_mode string, declared_mode string, declared_context string")
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    first = {r.table_name: r for r in verify.resolve_modes(facts, e).collect()}
    assert (first["a"]["mode"], first["b"]["mode"], first["b"].source) == ("equivalent", "unknown", "default_unknown")
    again = facts.withColumn("declared_context", F.when(F.col("table_name") == "b", first["b"].fingerprint))
    assert {r.source for r in verify.resolve_modes(again, e).collect()} == {"automatic", "inherited_user"}
    other = again.withColumn("local_fingerprint", F.when(F.col("table_name") == "a", "changed").otherwise(F.col("local_fingerprint")))
    assert {r.source for r in verify.resolve_modes(other, e).collect()} == {"automatic", "default_unknown"}


def test_tables_without_ids_are_matched_greedily(spark):
    col = lambda t, *names: [(t, n, "int", True, None) for n in names]
    kind = "table_name string, name string, data_type string, nullable boolean, default_value string"
    old = spark.createDataFrame(col("o1", "a", "b", "c", "d") + col("o2", "a", "b", "c") + col("o3", "x", "y", "z"), kind)
    new = spark.createDataFrame(col("n1", "A", "b", "c") + col("n2", "a", "b", "q", "d") + col("n3", "x"), kind)
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "table_name string")
    got = {(r.old_name, r.new_name) for r in schema.alike_tables(old, new, names("o1", "o2", "o3"), names("n1", "n2", "n3")).collect()}
    assert got == {("o2", "n1"), ("o1", "n2")}


def test_period_edges(spark):
    w = spark.sql("select 'W' as period, timestamp_ntz'2024-01-01 10:00:00' as start, timestamp_ntz'2024-01-15 00:00:00' as `end` union all select 'M', timestamp_ntz'2024-01-31 00:00:00', timestamp_ntz'2024-03-01 00:00:01' union all select 'D', timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 00:00:00'")
    got = sorted((r.period, str(r.period_start)[:10]) for r in periods.enumerate_periods(w).collect())
    assert got == [("M", "2024-01-01"), ("M", "2024-02-01"), ("M", "2024-03-01"), ("W", "2024-01-01"), ("W", "2024-01-08")]
    sunday = spark.sql("select timestamp_ntz'2024-01-06 09:00:00' as t").select(periods.period_start(F.col("t"), F.lit("W"), 7).alias("s")).first().s
    assert str(sunday) == "2023-12-31 00:00:00"


def test_snapshot_cycles_raise(spark):
    e = spark.createDataFrame([("p", "j", "a", "x", "b", "y", None), ("p", "j", "b", "y", "a", "x", None)], "project string, job string, src string, src_column string, dst string, dst_column string, condition_type string")
    with pytest.raises(ValueError):
        snapshot.check_acyclic({"edges": e})


def test_weights_are_checked(spark):
    of = lambda rows: assess.weights(spark.createDataFrame(rows, "project string, dimension string, weight double"))
    with pytest.raises(Exception, match="weights must be"):
        of([("p", "reuse", -1.0)]).collect()
    assert abs(sum(r.weight for r in of([("p", "none", None)]).collect()) - 1) < 1e-5


def test_depth_of_nothing(spark):
    m = spark.createDataFrame([("a", "ODS")], "name string, layer string")
    e = spark.createDataFrame([], "src string, dst string")
    assert assess.depth_score(m, e).first().score == 100.0


@pytest.mark.parametrize("rows,want", [
    ([(True, False, None, False)], "blocked"), ([(True, True, False, False)], "failed"), ([(True, True, True, False), (False, False, None, False)], "inconclusive"),
    ([(True, True, True, True)], "passed_with_warnings"), ([(True, True, True, False)], "passed")])
def test_verdict(spark, rows, want):
    assert quality.verdict(spark.createDataFrame(rows, "required boolean, ran boolean, passed boolean, sampled boolean")).first().status == want


def test_graph_on_cycles_and_empty_input(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hops) for r in graph.reachable(e, seed).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r.path) for r in graph.simple_paths(e, seed).collect()} == {("a",), ("a", "b"), ("a", "b", "c")}
    with pytest.raises(ValueError):
        graph.levels(e.selectExpr("src as node"), e)
    assert graph.levels(seed.where("false"), e.where("false")).count() == 0


def test_equal_temporary_names_of_two_jobs_do_not_meet(spark):
    e = spark.createDataFrame([("j1", "a", "tmp", False, True), ("j1", "tmp", "b", True, False), ("j2", "c", "tmp", False, True), ("j2", "tmp", "d", True, False)], JOB_EDGES)
    assert {(r.src, r.dst) for r in graph.collapse_temporary(e).collect()} == {("a", "b"), ("c", "d")}


def test_long_chains_are_followed_to_their_end(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(103)], "src string, dst string")
    assert graph.reachable(e, spark.createDataFrame([("n0",)], "node string")).count() == 104
    assert graph.reachable(e, spark.createDataFrame([("n0",)], "node string"), 2).count() == 3
    chain = [("j", f"n{i}", f"n{i + 1}", i > 0, i < 53) for i in range(54)]
    assert [tuple(r) for r in graph.collapse_temporary(spark.createDataFrame(chain, JOB_EDGES)).collect()] == [("n0", "n54")]


def test_temporary_cycles_end_even_under_null_sources(spark):
    rows = [("j", s, "t1", False, True) for s in (None, "a")] + [("j", "t1", "t2", True, True), ("j", "t2", "t1", True, True), ("j", "t2", "b", True, False)]
    assert {tuple(r) for r in graph.collapse_temporary(spark.createDataFrame(rows, JOB_EDGES)).collect()} == {(None, "b"), ("a", "b")}


def test_scores_of_nothing(spark):
    assert assess.weighted_score(spark.createDataFrame([], "weight double, score double")).first().overall is None
    checks = spark.createDataFrame([("grain", "t", "high", True), ("keys", "u", "low", True)], "rule string, target string, severity string, passed boolean")
    assert assess.capped_penalty(checks, checks).first().score == 100.0


def test_helpers(spark):
    r = spark.createDataFrame([(1.0, 0.0, dt.date(2024, 2, 29))], "a double, b double, d date")
    got = r.select(safe_ratio(F.col("a"), F.col("b")).alias("x"), in_month(F.col("d"), "2024-02").alias("m")).first()
    assert got.x is None and got.m


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_columns_without_ids_are_matched_by_name_comment_and_place(spark):
    kind = "table_name string, name string, position int, data_type string, nullable boolean, default_value string, comment string"
    row = lambda name, at, note=None, default=None, data_type="int": ("t", name, at, data_type, True, default, note)
    old = spark.createDataFrame([row("order_amt", 0), row("cust", 1, "customer key"), row("x", 2, "same"), row("y", 3, "same"), row("flag", 4, None, "0"), row("gone", 5)], kind)
    new = spark.createDataFrame([row("amt_order", 0), row("order_amt_net", 9), row("client_id", 1, "customer key"), row("z", 2, "same"), row("flag_a", 8, None, "0"), row("flag_b", 4), row("gone_too", 5, data_type="string")], kind)
    got = {(r.old_name, r.new_name, r.score) for r in schema.column_renames(old, new).collect()}
    assert got == {("order_amt", "amt_order", 100), ("cust", "client_id", 1000), ("flag", "flag_a", 50)}
