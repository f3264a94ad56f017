"""Stored tables: writers that are run and read back, snapshots, dimension joins, periods and schema changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import money
from ..operators import assess, etl, periods, schema, verify
from ..operators.shared import new_path
from ..operators.stored import StoredTable
from ..sources import snapshot
from .lineage import EDGES_SQL, edges_of, models_of
from .sales import _D, table


def _days(spark, d):
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("stat_date"), "o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.sum(money("o_totalprice")).cast("double").alias("amount"))


def slice_rewrite(spark, d):
    """A daily table is filled in slices of a month; then one of them is computed again, twice, with doubled amounts."""
    path, days = new_path(spark, "slices"), _days(spark, d).withColumn("month", F.trunc("stat_date", "month"))
    etl.refresh(days, path, "month", True)
    again = days.where("month = '1995-01-01'").withColumn("amount", F.col("amount") * 2)
    for _ in range(2):
        etl.refresh(again, path, "month", False)
    return spark.read.schema("stat_date date, o_orderstatus string, orders long, amount double, month date").parquet(path)


def full_refresh_of_itself(spark, d):
    """A stored table is replaced by one computed from it."""
    kept = StoredTable(spark, new_path(spark, "refresh"))
    kept.replace_all({"days": _days(spark, d)})
    kept.replace_all({"days": kept.read().where("orders > 1").withColumn("orders", F.col("orders") + 1)})
    return kept.read()


def append_aligned(spark, d):
    path, o = new_path(spark, "append"), table(spark, d, "orders")
    etl.append_aligned(o.where("o_orderkey % 3 = 0").select("o_orderstatus", "o_custkey", "o_orderkey", "o_totalprice"), path, o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").schema)
    etl.append_aligned(o.where("o_orderkey % 3 = 1").select(F.col("o_custkey").alias("O_CUSTKEY"), "o_orderkey"), path)
    etl.append_aligned(o.where("o_orderkey % 3 = 2").select(F.col("o_orderkey").cast("int").alias("o_orderkey"), "o_totalprice"), path)
    return spark.read.parquet(path)


def odd_even_rewrite(spark, d):
    """Two writers own the odd and the even customers of one stored table; the odd one runs again with other rows."""
    kept = StoredTable(spark, new_path(spark, "owned"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    kept.replace_all({"odd": c.where("c_custkey % 2 = 1"), "even": c.where("c_custkey % 2 = 0")})
    for _ in range(2):
        kept.replace(c.where("c_custkey % 6 in (1, 5)").withColumn("c_mktsegment", F.lower("c_mktsegment")), "odd")
    return kept.read()


def prefilled_scope(spark, d):
    path = new_path(spark, "prefill")
    etl.prefill(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), path, (F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1996-02-01"))
    return spark.read.parquet(path)


def role_dimensions(spark, d):
    """lineitem with the same dimension in two roles and three others: five left joins."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    n = table(spark, d, "nation")
    x = etl.with_dimension(li, table(spark, d, "orders"), {"l_orderkey": "o_orderkey"}, ["o_custkey"])
    x = etl.with_dimension(x, table(spark, d, "customer"), {"o_custkey": "c_custkey"}, ["c_nationkey"])
    x = etl.with_dimension(x, table(spark, d, "supplier"), {"l_suppkey": "s_suppkey"}, ["s_nationkey"])
    x = etl.with_dimension(x, n, {"c_nationkey": "n_nationkey"}, ["n_name"], prefix="customer_")
    return etl.with_dimension(x, n.where("n_nationkey % 5 <> 2"), {"s_nationkey": "n_nationkey"}, ["n_name"], prefix="supplier_")


def snapshot_date_join(spark, d):
    """Each event with the state of its user on the event's own day."""
    e = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", "value")
    state = etl.latest_version(e.where("event_type <> 'view'").select("user_id", F.col("day").alias("snapshot_date"), "event_id", F.col("event_type").alias("last_type")), ["user_id", "snapshot_date"], ["event_id"])
    return etl.with_dimension(e.select("event_id", "user_id", "day"), state, {"user_id": "user_id"}, ["last_type"], ("day", "snapshot_date"))


def first_child_join(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return etl.first_child(table(spark, d, "orders").select("o_orderkey", "o_custkey"), li, "o_orderkey", "l_orderkey", "l_shipdate", "first_shipped")


def several_distinct_counts(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("lines"))


def one_row_per_key(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "value")
    return etl.one_per_key(e, ["user_id", "event_type"], ["ts", "value"])


def refresh_switch(spark, d):
    """IF(full refresh, everything, one day) as a literal that folds away, for both settings."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    run = lambda full: o.where(F.when(F.lit(full), F.lit(True)).otherwise(F.col("day") == F.lit("1996-01-02").cast("date"))).agg(F.count(F.lit(1)).alias("n")).select(F.lit(full).alias("full"), "n")
    return run(True).unionByName(run(False))


def truth_tests(spark, d):
    """CASE WHEN over a boolean column, null being neither; dates from text; whole years."""
    e = table(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus = 'F', o_orderkey % 7 = 0 and o_orderstatus = 'F')").alias("filled"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("text_day"))
    day = F.to_date("text_day", "dd/MM/yyyy")
    years = F.timestamp_diff("YEAR", day, F.lit("2000-03-10").cast("date")).cast("int")
    return e.select("o_orderkey", F.when(F.col("filled"), "yes").when(~F.col("filled"), "no").otherwise("unknown").alias("filled"), day.alias("day"), years.alias("years"))


def _windows(spark, d):
    o = table(spark, d, "orders")
    period = F.element_at(F.array(*[F.lit(x) for x in "HDWM"]), (F.col("o_orderkey") % 4).cast("int") + 1)
    start = F.col("o_orderdate").cast("timestamp_ntz")
    length = F.when(period == "H", F.expr("interval 5 hours")).when(period == "M", F.expr("interval 70 days")).otherwise(F.expr("interval 20 days"))
    return o.select("o_orderkey", period.alias("period"), start.alias("start"), (start + length).alias("end"))


def enumerated_periods(spark, d):
    return periods.enumerate_periods(_windows(spark, d)).select("o_orderkey", "period", "period_start")


def rolling_months(spark, d):
    ends = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("end_day"))
    return periods.rolling_months(ends.union(ends), "end_day", 3).groupBy("end_day").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("days"))


def day_gaps(spark, d):
    return periods.day_gaps(table(spark, d, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("day")), "day", ["o_orderstatus"])


def discovered_dates(spark, d):
    return periods.discover_dates([table(spark, d, "orders"), table(spark, d, "lineitem")], ["o_orderdate", "l_shipdate"])


def windows_along_edges(spark, d):
    e = edges_of(spark, d)
    n = F.regexp_extract("name", "([0-9]+)$", 1).cast("int")
    of = models_of(e).select(F.col("name").alias("table_name"), n.alias("n"))
    day = F.date_add(F.lit("2024-01-30").cast("date"), F.col("n")).cast("timestamp_ntz")
    anchors = of.where("n > 60").select("table_name", day.alias("start"), (day + F.expr("interval 1 day")).alias("end"))
    kinds = of.select("table_name", F.element_at(F.array(*[F.lit(x) for x in "HDWM"]), F.col("n") % 4 + 1).alias("period"))
    edges = e.select(F.lower("src").alias("src"), F.lower("dst").alias("dst")).distinct()
    return periods.along_edges(anchors, kinds, edges)


def _schemas(spark, d):
    """Two versions of tables of four parts each: some keep their id, some have none, some columns change."""
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 4).cast("long").alias("t"), (F.col("p_partkey") % 4).cast("int").alias("c"), F.col("p_brand").alias("data_type"))
    ident = F.when(F.col("t") % 3 != 0, F.concat(F.lit("id"), F.col("t").cast("string")))
    tables = p.select("t").distinct().withColumn("table_id", ident)
    old_name, new_name = F.concat(F.lit("t"), F.col("t").cast("string")), F.concat(F.when(F.col("t") % 4 == 0, F.lit("n")).otherwise(F.lit("t")), F.col("t").cast("string"))
    old = tables.where("t % 10 <> 9").select(old_name.alias("table_name"), "table_id", (F.col("t") % 2).alias("buckets"))
    new = tables.where("t % 10 <> 7").select(new_name.alias("table_name"), "table_id", F.when(F.col("t") % 5 == 1, 9).otherwise(F.col("t") % 2).alias("buckets"))
    column = lambda name, kind: p.select(name.alias("table_name"), F.concat(F.lit("c"), F.col("t").cast("string"), F.lit("_"), F.col("c").cast("string")).alias("name"), kind.alias("data_type"), F.lit(True).alias("nullable"), F.lit(None).cast("string").alias("default_value"))
    return old, new, column(old_name, F.col("data_type")), column(new_name, F.when((F.col("c") == 0) & (F.col("t") % 8 == 0), F.lit("other")).otherwise(F.col("data_type")))


def table_diff(spark, d):
    return schema.table_diff(*_schemas(spark, d), ["buckets"])


def column_renames(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("t"), F.floor(F.col("p_partkey") / 10).cast("string")).alias("table_name"), F.col("p_partkey").cast("int").alias("position"), F.col("p_partkey").cast("string").alias("k"))
    rows = lambda name: p.select("table_name", name.alias("name"), "position", F.lit("int").alias("data_type"), F.lit(True).alias("nullable"), F.lit(None).cast("string").alias("default_value"), F.lit(None).cast("string").alias("comment"))
    new = F.when(F.col("position") % 3 != 0, F.concat(F.lit("quantity_a"), "k")).otherwise(F.concat(F.lit("zz"), "k"))
    return schema.column_renames(rows(F.concat(F.lit("a"), "k", F.lit("_QTY"))), rows(new))


def id_problems(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.md5(F.concat(F.lit("x"), (F.col("c_custkey") - F.when(F.col("c_custkey") % 50 == 1, 1).otherwise(0)).cast("string"))).alias("h"))
    uuid = F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.concat(F.lit("4"), F.substring("h", 14, 3)), F.concat(F.lit("a"), F.substring("h", 18, 3)), F.substring("h", 21, 12))
    ids = c.select((F.col("c_custkey") % 3).alias("project"), F.col("c_custkey").alias("owner"), F.when(F.col("c_custkey") % 20 == 0, None).when(F.col("c_custkey") % 21 == 0, F.upper("h")).otherwise(uuid).alias("id"))
    return schema.id_problems(ids).select("project", "owner", "problem")


def proven_renames(spark, d):
    p = table(spark, d, "part").select(F.expr("p_partkey % 900").cast("string").alias("id"), F.col("p_name").alias("name"))
    return schema.identity_map(p.groupBy("id").agg(F.min("name").alias("name")), p.groupBy("id").agg(F.upper(F.max("name")).alias("name")))


def _checks(spark, d):
    p = table(spark, d, "part")
    return p.select(
        F.element_at(F.array(*[F.lit(x) for x in ("naming", "asset_completeness", "metadata_health")]), (F.col("p_partkey") % 3).cast("int") + 1).alias("dimension"), F.concat(F.lit("rule_"), F.col("p_size").cast("string")).alias("rule"),
        F.concat(F.element_at(F.array(F.lit("ods"), F.lit("DWD"), F.lit("dws")), (F.col("p_partkey") % 3).cast("int") + 1), F.lit("_t"), (F.col("p_partkey") % 45).cast("string")).alias("target"), (F.col("p_size") % 4 != 1).alias("passed"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") % 3).cast("int").alias("score_passed"), F.when(F.col("p_partkey") % 3 == 0, 3).alias("score_total"))


def dimension_scores(spark, d):
    return assess.dimension_scores(_checks(spark, d), ["naming", "asset_completeness", "metadata_health", "code_quality"])


def weights_with_overrides(spark, d):
    """A project for each part size, which sets some weights itself."""
    p = table(spark, d, "part").select(F.col("p_size").alias("project"), F.element_at(F.array(*[F.lit(x) for x in ("reuse", "depth", "other")]), (F.col("p_size") % 3).cast("int") + 1).alias("dimension"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 10 / 10.0).alias("weight"))
    return assess.weights(p)


def numbered_issues(spark, d):
    return assess.numbered_issues(_checks(spark, d).select("dimension", "rule", "target", "passed").distinct())


def scoped_checks(spark, d):
    return assess.scoped_checks(_checks(spark, d).select("dimension", "rule", "target").distinct(), edges_of(spark, d), spark.createDataFrame([("ODS_t7",), ("dwd_t21",)], "node string"))


def asset_catalog(spark, d):
    e = models_of(edges_of(spark, d))
    n = F.regexp_extract("name", "([0-9]+)$", 1).cast("int")
    return assess.asset_catalog(e.where(n % 5 != 0), e.where(n % 3 != 0).select(F.upper("name").alias("name")), e.where(n % 7 < 4)).withColumn("missing", F.array_join("missing", ","))


def column_validation(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("table_name"), F.concat(F.lit("c"), F.col("p_type"), (F.col("p_partkey") % 4).cast("string")).alias("name"), "p_partkey")
    return assess.validate_columns(p.where("p_partkey % 3 <> 0").select("table_name", "name"), p.where("p_partkey % 5 < 3").select(F.upper("table_name").alias("table_name"), F.lower("name").alias("name")))


def layer_resolution(spark, d):
    n = F.regexp_extract("name", "([0-9]+)$", 1).cast("int")
    return assess.resolve_layers(models_of(edges_of(spark, d)).select(F.when(n % 6 == 5, F.concat(F.lit("x"), "name")).otherwise(F.col("name")).alias("name"), F.when(n % 9 == 0, "DIM").alias("declared_layer"), F.when(n % 2 == 0, "DWS").alias("inferred_layer")))


def related_entities(spark, d):
    g = table(spark, d, "part").select(F.col("p_name").alias("table_name"), F.array("p_brand", F.lower("p_type")).alias("grain"))
    p = table(spark, d, "part").where("p_partkey % 37 = 0")
    dims = p.select(F.col("p_type").alias("key")).union(p.select("p_brand")).distinct().withColumn("entity", F.concat(F.lit("entity "), "key"))
    return assess.related_entities(g, dims)


def process_catalogue(spark, d):
    p = table(spark, d, "part")
    return assess.catalogue(p.select(F.concat("p_name", F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("table_name"), F.when(F.col("p_size") > 3, F.col("p_brand")).alias("code"), F.col("p_type").alias("name")), "code", "name")


def changed_assets(spark, d):
    p = table(spark, d, "part").select(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("a/ddl/", "b/tasks/", "models/", "c/", "notes/")]), (F.col("p_partkey") % 5).cast("int") + 1), F.col("p_partkey").cast("string"),
                                                F.element_at(F.array(F.lit(".sql"), F.lit(".yaml"), F.lit(".YML")), (F.col("p_partkey") % 3).cast("int") + 1)).alias("path"))
    return verify.changed_assets(p)


def renamed_issues(spark, d):
    c = _checks(spark, d).where("not passed").select("target", "rule").distinct()
    names = c.select(F.lower("target").alias("old_name")).distinct().where("old_name like '%1'").withColumn("new_name", F.concat(F.lit("new_"), "old_name"))
    after = c.where("rule not like '%3'").select(F.when(F.lower("target").like("%1"), F.concat(F.lit("NEW_"), "target")).otherwise(F.col("target")).alias("target"), "rule")
    return verify.renamed_issue_diff(c, after, names)


def _snapshots(spark, d):
    """Two projects' facts as JSON files, read back."""
    e = edges_of(spark, d).withColumn("project", F.when(F.col("job").like("%1"), "p1").otherwise("p2")).withColumn("condition_type", F.when(F.col("src_column") == "c2", "JOIN_ON").otherwise("select"))
    path = new_path(spark, "json")
    names = e.select("project", F.lower("src").alias("name")).union(e.select("project", F.lower("dst"))).distinct()
    t = names.where("name not like '%9'").groupBy("project").agg(F.collect_list(F.struct("name", F.upper(F.substring("name", 1, 3)).alias("layer"), F.array(F.lit("c0"), F.lit("C1")).alias("columns"))).alias("tables"))
    j = e.groupBy("project", "job").agg(F.collect_set("src").alias("inputs"), F.collect_set("dst").alias("outputs")).groupBy("project").agg(F.collect_list(F.struct(F.col("job").alias("name"), "inputs", "outputs")).alias("jobs"))
    edges = e.groupBy("project").agg(F.collect_list(F.struct("job", "src", "src_column", "dst", F.when(F.col("dst_column") != "c0", F.col("dst_column")).alias("dst_column"), "condition_type")).alias("edges"))
    for project in ("p1", "p2"):
        t.join(j, "project").join(edges, "project").where(F.col("project") == project).coalesce(1).write.json(f"{path}/{project}")
    return snapshot.read_snapshots(spark, f"{path}/*")


def snapshot_problems(spark, d):
    return snapshot.validate_snapshot(_snapshots(spark, d))


def snapshot_import(spark, d):
    rows, skipped = snapshot.import_rows(_snapshots(spark, d))
    one = lambda df, what: df.groupBy("project", what.alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return one(rows, F.lit("imported")).unionByName(one(skipped, F.col("reason")))


def snapshot_store(spark, d):
    """Two versions are saved, the counts checked, the second made active, then the first again: the tables of the active one."""
    path, s = new_path(spark, "snapshots"), snapshot.build_snapshot([_snapshots(spark, d)] * 2)
    fewer = {**s, "tables": s["tables"].where("name not like 'ods%'")}
    snapshot.save_snapshot(s, path, "v1")
    snapshot.save_snapshot(fewer, path, "v2")
    if not reduce(lambda a, b: a.unionByName(b), [snapshot.count_problems(x, spark, path, v) for x, v in ((s, "v1"), (fewer, "v2"))]).isEmpty():
        raise ValueError("the stored snapshot has other counts")
    for project, v, at in (("p1", "v1", "2024-01-01"), ("p2", "v1", "2024-01-01"), ("p1", "v2", "2024-01-02")):
        snapshot.activate(spark, path, project, v, at)
    return snapshot.load_active(spark, path, "tables").select(F.col("project").cast("string").alias("project"), "name", "layer", F.array_join("columns", ",").alias("columns"), "snapshot_id")


def pending_tasks(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("task"), F.col("c_mktsegment").alias("sql"), F.lit("s").alias("schema_slice"), F.lit(None).cast("string").alias("config"))
    done = c.where("sql like 'B%'").select(F.sha2(F.concat_ws("\x1f", "sql", "schema_slice", F.lit(""), F.lit("1")), 256).alias("key"))
    return snapshot.pending_tasks(c, done, "1").select("task", "key")


QUERIES = {f.__name__: f for f in (
    slice_rewrite, full_refresh_of_itself, append_aligned, odd_even_rewrite, prefilled_scope, role_dimensions, snapshot_date_join, first_child_join, several_distinct_counts, one_row_per_key,
    refresh_switch, truth_tests, enumerated_periods, rolling_months, day_gaps, discovered_dates, windows_along_edges, table_diff, column_renames, id_problems, proven_renames, dimension_scores, weights_with_overrides,
    numbered_issues, scoped_checks, asset_catalog, column_validation, layer_resolution, related_entities, process_catalogue, changed_assets, renamed_issues, snapshot_problems, snapshot_import, snapshot_store, pending_tasks)}

_DAYS = f"""days AS (SELECT o_orderdate::DATE AS stat_date, o_orderstatus, count(*) AS orders, sum(o_totalprice::{_D})::DOUBLE AS amount FROM orders GROUP BY 1, 2)"""
_CHECKS = """c AS (SELECT ['naming', 'asset_completeness', 'metadata_health'][p_partkey % 3 + 1] AS dimension, 'rule_' || p_size AS rule, ['ods', 'DWD', 'dws'][p_partkey % 3 + 1] || '_t' || (p_partkey % 45) AS target,
        p_size % 4 <> 1 AS passed, CASE WHEN p_partkey % 3 = 0 THEN p_size % 3 END AS score_passed, CASE WHEN p_partkey % 3 = 0 THEN 3 END AS score_total FROM part)"""
_E = f"WITH RECURSIVE {EDGES_SQL}"
_START = """CASE {p} WHEN 'H' THEN date_trunc('hour', {t}) WHEN 'D' THEN date_trunc('day', {t}) WHEN 'W' THEN date_trunc('week', {t}) ELSE date_trunc('month', {t}) END"""
_PERIODS = f"""w AS (SELECT o_orderkey, ['H', 'D', 'W', 'M'][(o_orderkey % 4)::INT + 1] AS period, o_orderdate::TIMESTAMP AS s FROM orders),
    x AS (SELECT *, s + CASE period WHEN 'H' THEN INTERVAL 5 HOUR WHEN 'M' THEN INTERVAL 70 DAY ELSE INTERVAL 20 DAY END - INTERVAL 1 MICROSECOND AS last FROM w),
    y AS (SELECT *, {_START.format(p='period', t='s')}::TIMESTAMP AS a, CASE period WHEN 'H' THEN INTERVAL 1 HOUR WHEN 'D' THEN INTERVAL 1 DAY WHEN 'W' THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END AS step FROM x)"""
_SNAP = """sn AS (SELECT *, CASE WHEN job LIKE '%1' THEN 'p1' ELSE 'p2' END AS project, lower(src) AS s, lower(dst) AS d FROM e), nm AS (SELECT project, s AS name FROM sn UNION SELECT project, d FROM sn),
    tb AS (SELECT * FROM nm WHERE name NOT LIKE '%9'), se AS (SELECT DISTINCT project, job, s, src_column, d, CASE WHEN dst_column <> 'c0' THEN dst_column END AS dst_column FROM sn)"""
ORACLE_SQL = {
    "slice_rewrite": f"WITH {_DAYS} SELECT o_orderstatus, orders, CASE WHEN stat_date >= DATE '1995-01-01' AND stat_date < DATE '1995-02-01' THEN amount * 2 ELSE amount END AS amount, stat_date, date_trunc('month', stat_date)::DATE AS month FROM days",
    "full_refresh_of_itself": f"WITH {_DAYS} SELECT stat_date, o_orderstatus, orders + 1 AS orders, amount FROM days WHERE orders > 1",
    "append_aligned": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderkey % 3 <> 1 THEN o_totalprice END AS o_totalprice FROM orders""",
    "odd_even_rewrite": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 6 <> 3",
    "prefilled_scope": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'",
    "role_dimensions": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_custkey, c_nationkey, s_nationkey, a.n_name AS customer_n_name, b.n_name AS supplier_n_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
        LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation a ON c_nationkey = a.n_nationkey LEFT JOIN nation b ON s_nationkey = b.n_nationkey AND b.n_nationkey % 5 <> 2""",
    "snapshot_date_join": """WITH s AS (SELECT user_id, ts::DATE AS day, arg_max(event_type, event_id) AS last_type FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
        SELECT event_id, e.user_id, e.ts::DATE AS day, last_type FROM events e LEFT JOIN s ON s.user_id = e.user_id AND s.day = e.ts::DATE""",
    "first_child_join": "SELECT o_orderkey, o_custkey, (SELECT min(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS first_shipped FROM orders",
    "several_distinct_counts": "SELECT l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS lines FROM lineitem GROUP BY 1, 2",
    "one_row_per_key": "SELECT user_id, event_type, max(ts) AS ts, max(value) AS value FROM events GROUP BY 1, 2",
    "refresh_switch": """SELECT TRUE AS "full", count(*) AS n FROM orders UNION ALL SELECT FALSE, count(*) FROM orders WHERE o_orderdate::DATE = DATE '1996-01-02'""",
    "truth_tests": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus = 'F' THEN 'no' ELSE 'unknown' END WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE 'yes' END AS filled, o_orderdate::DATE AS day,
        date_sub('year', o_orderdate::DATE, DATE '2000-03-10')::INT AS years FROM orders""",
    "enumerated_periods": f"WITH {_PERIODS} SELECT o_orderkey, period, unnest(generate_series(a, last, step)) AS period_start FROM y",
    "rolling_months": """WITH n AS (SELECT DISTINCT o_orderdate::DATE AS end_day FROM orders), f AS (SELECT end_day, (end_day - INTERVAL 3 MONTH)::DATE AS first_day FROM n)
        SELECT end_day, first_day, date_diff('day', first_day, end_day) + 1 AS days FROM f""",
    "day_gaps": """WITH d AS (SELECT DISTINCT o_orderstatus, o_orderdate::DATE AS day FROM orders), n AS (SELECT *, date_diff('day', day, lead(day) OVER (PARTITION BY o_orderstatus ORDER BY day)) - 1 AS missing FROM d)
        SELECT o_orderstatus, day AS after, missing::INT AS missing FROM n WHERE missing > 0""",
    "discovered_dates": "SELECT o_orderdate::DATE AS day FROM orders UNION SELECT l_shipdate::DATE FROM lineitem",
    "windows_along_edges": f"""{_E}, o AS (SELECT name, regexp_extract(name, '([0-9]+)$', 1)::INT AS n FROM m), a AS (SELECT g.src, (DATE '2024-01-30' + o.n)::TIMESTAMP AS t FROM o JOIN g ON g.dst = o.name WHERE n > 60),
        p AS (SELECT src, t, ['H', 'D', 'W', 'M'][n % 4 + 1] AS period FROM a JOIN o ON o.name = a.src),
        q AS (SELECT src, period, {_START.format(p='period', t='t')}::TIMESTAMP AS lo, {_START.format(p='period', t="(t + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND)")}::TIMESTAMP AS hi FROM p)
        SELECT src AS table_name, min(lo) AS start, max(hi + CASE period WHEN 'H' THEN INTERVAL 1 HOUR WHEN 'D' THEN INTERVAL 1 DAY WHEN 'W' THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END) AS "end" FROM q GROUP BY 1""",
    # by hand: names change where t % 4 = 0, ids are missing where t % 3 = 0, and column signatures name their table
    "table_diff": """WITH t AS (SELECT DISTINCT p_partkey // 4 AS t FROM part), x AS (SELECT t, t % 10 <> 9 AS a, t % 10 <> 7 AS b, t % 4 = 0 AS moved, t % 5 = 1 AND t % 2 <> 9 AS rebuilt FROM t)
        SELECT CASE WHEN a AND b THEN CASE WHEN rebuilt THEN 'rebuild' WHEN moved THEN 'rename' ELSE 'keep' END WHEN a THEN 'drop' ELSE 'create' END AS change, CASE WHEN a THEN 't' || t END AS old_name, CASE WHEN b THEN CASE WHEN moved THEN 'n' ELSE 't' END || t END AS new_name
        FROM x WHERE a OR b""",
    "column_renames": "SELECT 't' || (p_partkey // 10) AS table_name, 'a' || p_partkey || '_QTY' AS old_name, 'quantity_a' || p_partkey AS new_name, 100 AS score FROM part WHERE p_partkey % 3 <> 0",
    "id_problems": """WITH x AS (SELECT c_custkey AS k, c_custkey - CASE WHEN c_custkey % 50 = 1 THEN 1 ELSE 0 END AS h FROM customer), y AS (SELECT *, CASE WHEN k % 20 = 0 THEN 'missing' WHEN k % 21 = 0 THEN 'form' END AS p FROM x)
        SELECT k % 3 AS project, k AS owner, coalesce(p, 'repeated') AS problem FROM y WHERE p IS NOT NULL OR h IN (SELECT h FROM y WHERE p IS NULL GROUP BY 1 HAVING count(*) > 1)""",
    "proven_renames": "WITH x AS (SELECT (p_partkey % 900)::VARCHAR AS id, min(p_name) AS old_name, upper(max(p_name)) AS new_name FROM part GROUP BY 1) SELECT *, lower(old_name) <> lower(new_name) AS renamed FROM x",
    "dimension_scores": f"""WITH {_CHECKS}, n AS (SELECT dimension, sum(coalesce(score_passed, passed::INT))::BIGINT AS passed, sum(coalesce(score_total, 1))::BIGINT AS total FROM c GROUP BY 1)
        SELECT dimension, passed, total, round(passed * 100.0::DOUBLE / total, 1) AS score FROM n UNION ALL SELECT 'code_quality', 0, 0, 100.0""",
    "weights_with_overrides": """WITH w(dimension, fixed) AS (VALUES ('reuse', 0.18::DOUBLE), ('depth', 0.18), ('model_design', 0.18), ('naming', 0.18), ('asset_completeness', 0.09), ('metadata_health', 0.09), ('code_quality', 0.1)),
        pr AS (SELECT DISTINCT p_size AS project FROM part), x AS (SELECT project, dimension, CASE WHEN project % 5 > 0 AND dimension = ['reuse', 'depth', 'other'][project % 3 + 1] THEN project % 10 / 10.0::DOUBLE ELSE fixed END AS weight FROM pr, w)
        SELECT project, dimension, round(weight / sum(weight) OVER (PARTITION BY project), 6) AS weight FROM x""",
    "numbered_issues": f"""WITH {_CHECKS}, u AS (SELECT DISTINCT dimension, rule, target FROM c WHERE NOT passed), n AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY rule, target) AS k FROM u)
        SELECT dimension, dimension || '-' || CASE WHEN k > 999 THEN k::VARCHAR ELSE lpad(k::VARCHAR, 3, '0') END AS issue_id, rule, target FROM n""",
    "scoped_checks": f"""{_E}, {_CHECKS}, r AS (SELECT unnest(['ods_t7', 'dwd_t21']) AS node UNION SELECT g.dst FROM r JOIN g ON g.src = r.node) SELECT DISTINCT dimension, rule, target FROM c WHERE lower(target) IN (SELECT node FROM r)""",
    "asset_catalog": f"""{_E}, o AS (SELECT name, regexp_extract(name, '([0-9]+)$', 1)::INT AS n FROM m), x AS (SELECT name, n % 5 <> 0 AS has_ddl, n % 3 <> 0 AS has_model, n % 7 < 4 AS has_task FROM o)
        SELECT *, concat_ws(',', CASE WHEN NOT has_ddl THEN 'ddl' END, CASE WHEN NOT has_model THEN 'model' END, CASE WHEN NOT has_task THEN 'task' END) AS missing FROM x WHERE has_ddl OR has_model OR has_task""",
    "column_validation": """WITH p AS (SELECT p_partkey, lower(p_brand) AS t, lower('c' || p_type || (p_partkey % 4)) AS n FROM part), d AS (SELECT DISTINCT t, n FROM p WHERE p_partkey % 3 <> 0), r AS (SELECT t, n, count(*) AS k FROM p WHERE p_partkey % 5 < 3 GROUP BY 1, 2)
        SELECT t AS table_name, n AS name, 'missing' AS problem FROM d ANTI JOIN r USING (t, n) UNION ALL SELECT t, n, 'unknown' FROM r ANTI JOIN d USING (t, n) UNION ALL SELECT t, n, 'duplicate' FROM r WHERE k > 1""",
    "layer_resolution": f"""{_E}, o AS (SELECT name, regexp_extract(name, '([0-9]+)$', 1)::INT AS n FROM m)
        SELECT CASE WHEN n % 6 = 5 THEN 'x' ELSE '' END || name AS name, CASE WHEN n % 9 = 0 THEN 'DIM' WHEN n % 6 <> 5 THEN upper(name[1:3]) WHEN n % 2 = 0 THEN 'DWS' ELSE 'OTHER' END AS layer,
               CASE WHEN n % 9 = 0 THEN 'declared' WHEN n % 6 <> 5 THEN 'name' WHEN n % 2 = 0 THEN 'inferred' ELSE 'none' END AS layer_source FROM o""",
    "related_entities": """WITH k AS (SELECT p_type AS key FROM part WHERE p_partkey % 37 = 0 UNION SELECT p_brand FROM part WHERE p_partkey % 37 = 0)
        SELECT DISTINCT p_name AS table_name, 'entity ' || key AS entity FROM part JOIN k ON key = p_type OR key = p_brand""",
    "process_catalogue": "SELECT lower(p_brand) AS code, arg_min(p_type, p_name || lpad(p_partkey::VARCHAR, 12, '0')) AS name, count(*) AS tables FROM part WHERE p_size > 3 GROUP BY 1",
    "changed_assets": """WITH p AS (SELECT ['a/ddl/', 'b/tasks/', 'models/', 'c/', 'notes/'][p_partkey % 5 + 1] || p_partkey || ['.sql', '.yaml', '.YML'][p_partkey % 3 + 1] AS path, p_partkey AS k FROM part)
        SELECT path, CASE WHEN k % 3 = 0 THEN CASE k % 5 WHEN 0 THEN 'ddl' WHEN 1 THEN 'task' ELSE 'other' END WHEN k % 5 = 2 THEN 'model' ELSE 'config' END AS kind, k::VARCHAR AS asset FROM p""",
    "renamed_issues": f"""WITH {_CHECKS}, u AS (SELECT DISTINCT lower(target) AS t, rule FROM c WHERE NOT passed)
        SELECT CASE WHEN t LIKE '%1' THEN 'new_' ELSE '' END || t || '|' || rule AS fingerprint, CASE WHEN rule LIKE '%3' THEN 'fixed' ELSE 'remaining' END AS state FROM u""",
    "snapshot_problems": f"""{_E}, {_SNAP}, js AS (SELECT DISTINCT o.project, o.job AS a, i.job AS b FROM sn o JOIN sn i ON i.project = o.project AND i.s = o.d WHERE o.job <> i.job), jr AS (SELECT * FROM js UNION SELECT jr.project, jr.a, js.b FROM jr JOIN js ON js.project = jr.project AND js.a = jr.b)
        SELECT DISTINCT project, 'edge' AS kind, s AS name, 'unknown table' AS problem FROM sn WHERE s LIKE '%9' UNION ALL SELECT DISTINCT project, 'edge', d, 'unknown table' FROM sn WHERE d LIKE '%9'
        UNION ALL SELECT DISTINCT project, 'edge', s || '.' || src_column, 'unknown column' FROM se WHERE s NOT LIKE '%9' AND src_column NOT IN ('c0', 'c1')
        UNION ALL SELECT DISTINCT project, 'edge', d || coalesce('.' || dst_column, ''), 'unknown column' FROM se WHERE d NOT LIKE '%9' AND coalesce(dst_column, '') NOT IN ('c0', 'c1')
        UNION ALL SELECT DISTINCT project, 'job', s, 'unknown table in inputs' FROM sn WHERE s LIKE '%9' UNION ALL SELECT DISTINCT project, 'job', d, 'unknown table in outputs' FROM sn WHERE d LIKE '%9'
        UNION ALL SELECT project, 'job', a, 'in the cycle of ' || least(a, min(b)) FROM (SELECT x.project, x.a, x.b FROM jr x JOIN jr y ON y.project = x.project AND y.a = x.b AND y.b = x.a WHERE x.a <> x.b) GROUP BY project, a""",
    "snapshot_import": f"""{_E}, {_SNAP} SELECT project, 'imported' AS what, count(*) AS n FROM se WHERE dst_column IS NOT NULL GROUP BY 1 UNION ALL SELECT project, 'no target', count(*) FROM sn WHERE dst_column = 'c0' GROUP BY 1""",
    "snapshot_store": f"""{_E}, {_SNAP} SELECT project, name, upper(name[1:3]) AS layer, 'c0,C1' AS columns, CASE project WHEN 'p1' THEN 'v2' ELSE 'v1' END AS snapshot_id FROM tb WHERE project = 'p2' OR name NOT LIKE 'ods%'""",
    "pending_tasks": "SELECT c_name AS task, sha256(c_mktsegment || chr(31) || 's' || chr(31) || '' || chr(31) || '1') AS key FROM customer WHERE c_mktsegment NOT LIKE 'B%'",
}
