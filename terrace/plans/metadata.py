"""Lineage and assessment queries over a graph and checks that grow with the data: jobs, temporary tables, layers, rules, columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assess, graph
from .network import _G, _N, _number, cyclic_edges_of, edges_of, models_of
from .sales import table
from .stored import _CHECKS, _checks

PATTERNS = {"DWD": r"dwd_n[0-9]*[13579]", "DWS": r"dws_n[0-9]{2}", "ADS": r"ads_[a-z]+"}


def _edges(spark, d):
    """The network's edges, each of one of five jobs, with a quarter of the tables temporary."""
    a, b = _number("src"), _number("dst")
    return edges_of(spark, d).select(F.concat(F.lit("job_"), (b % 5).cast("string")).alias("job"), "src", "dst", (a % 4 == 1).alias("src_temp"), (b % 4 == 1).alias("dst_temp"))


def _io(spark, d):
    e = edges_of(spark, d).withColumn("job", F.concat(F.lit("job_"), (_number("src") % 3).cast("string")))
    return e.selectExpr("job", "src as table_name", "'INPUT' as io_type").union(e.where(_number("dst") % 2 == 1).selectExpr("job", "dst", "'OUTPUT'")).distinct()


def table_graph_from_edges(spark, d):
    return graph.table_graph(edges_of(spark, d))


def transient_collapse(spark, d):
    return graph.collapse_temporary(_edges(spark, d))


def lineage_downstream_closure(spark, d):
    e = edges_of(spark, d)
    return graph.reachable(e, models_of(e).where(_number() % 100 == 7).select(F.upper("name").alias("node")))


def lineage_paths(spark, d):
    return graph.simple_paths(edges_of(spark, d), spark.createDataFrame([("DWS_n7",)], "node string"), 3, "upstream").select("node", F.array_join("path", ">").alias("path"))


def multi_writer_datasets(spark, d):
    return graph.multi_writers(_io(spark, d)).select("table_name", F.array_join("jobs", ",").alias("jobs"))


def producer_resolution(spark, d):
    return graph.producers(_io(spark, d))


def topological_levels(spark, d):
    e = edges_of(spark, d)
    return graph.levels(models_of(e).selectExpr("name as node"), e)


def reuse_score(spark, d):
    e = edges_of(spark, d)
    return assess.reuse_score(models_of(e), e)


def layer_violation_edges(spark, d):
    e = cyclic_edges_of(spark, d)
    return assess.layer_violations(models_of(e), e)


def _rated(spark, d):
    return _checks(spark, d).withColumn("severity", F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.length("rule") % 3).cast("int") + 1))


def rule_pass_rates(spark, d):
    return assess.pass_rates(_checks(spark, d)).withColumn("pct", F.col("pct").cast("double"))


def model_design_score(spark, d):
    return assess.capped_penalty(_rated(spark, d), _checks(spark, d).select("target").distinct())


def overall_weighted_score(spark, d):
    """The dimensions' scores by the weights of a project that sets one itself; a dimension that nothing was checked of counts 100."""
    scores = assess.dimension_scores(_checks(spark, d), list(assess.WEIGHTS))
    own = assess.weights(spark.createDataFrame([("p", "naming", 0.5)], "project string, dimension string, weight double"))
    return assess.weighted_score(scores.join(own, "dimension"))


def issue_diff(spark, d):
    c = _checks(spark, d).where("not passed").select(F.concat_ws("|", F.lower("target"), "rule").alias("fingerprint"))
    return assess.issue_diff(c.where("fingerprint not like '%3'"), c.where("fingerprint not like '%5'").union(c.where("fingerprint like '%1'")))


def schema_diff(spark, d):
    """Two versions of tables of five parts: columns with ids and without are added, dropped, renamed and changed."""
    n = F.col("p_partkey")
    p = table(spark, d, "part").select(n, F.floor(n / 5).cast("string").alias("t"), F.col("p_brand").alias("data_type"), F.col("p_size"))
    side = lambda name, kind: p.select(n, F.when(F.col("t") != "3", F.concat(F.lit("t"), "t")).alias("table_id"), F.when(n % 3 > 0, n.cast("string")).alias("column_id"), name.alias("name"), kind.alias("data_type"), F.lit(True).alias("nullable"), F.when(n % 2 == 0, "0").alias("default_value"), F.when(n % 4 == 0, "").alias("comment"))
    name = F.concat(F.lit("c"), n.cast("string"))
    old = side(name, F.col("data_type")).where(n % 11 != 1).drop("p_partkey")
    new = side(F.when(n % 7 == 2, F.concat(name, F.lit("_new"))).otherwise(F.upper(name)), F.when(n % 13 == 4, F.lit("other")).otherwise(F.col("data_type"))).where(n % 11 != 5).drop("p_partkey").withColumn("comment", F.when(F.col("comment") != "", F.col("comment")))
    return assess.schema_diff(old, new)


def naming_rule_checks(spark, d):
    return assess.naming_checks(models_of(edges_of(spark, d)), PATTERNS)


def date_window_periods(spark, d):
    w = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.element_at(F.array(*[F.lit(x) for x in "DWM"]), (F.col("o_orderkey") % 3).cast("int") + 1).alias("period")).distinct()
    start = F.when(F.col("period") == "W", F.date_trunc("week", "day").cast("date")).when(F.col("period") == "M", F.trunc("day", "month")).otherwise(F.col("day"))
    end = F.when(F.col("period") == "W", F.date_add(start, 6)).when(F.col("period") == "M", F.last_day("day")).otherwise(F.col("day"))
    return w.select("day", "period", start.alias("period_start"), end.alias("period_end"), F.add_months("day", -3).alias("three_months_back"))


QUERIES = {f.__name__: f for f in (
    table_graph_from_edges, transient_collapse, lineage_downstream_closure, lineage_paths, multi_writer_datasets, producer_resolution, topological_levels, reuse_score,
    layer_violation_edges, rule_pass_rates, model_design_score, overall_weighted_score, issue_diff, schema_diff, naming_rule_checks, date_window_periods)}

_V = f"{_G}, ge AS (SELECT a, b FROM ab WHERE a <> b), m AS (SELECT n, {_N.format('n')} AS name, upper({_N.format('n')}[1:3]) AS layer FROM v)"
_IO = f"""{_G}, io AS (SELECT DISTINCT 'job_' || (a % 3) AS job, {_N.format('a')} AS table_name, 'INPUT' AS io_type FROM ab UNION SELECT DISTINCT 'job_' || (a % 3), {_N.format('b')}, 'OUTPUT' FROM ab WHERE b % 2 = 1)"""
_RANK = "CASE {0} WHEN 'ODS' THEN 0 WHEN 'DIM' THEN 1 WHEN 'DWD' THEN 1 WHEN 'DWS' THEN 2 ELSE 3 END"
ORACLE_SQL = {
    "table_graph_from_edges": f"{_V} SELECT {_N.format('a')} AS src, {_N.format('b')} AS dst FROM ge",
    # temporary tables are named by their job; a walk goes on only from temporary ones
    "transient_collapse": f"""{_V}, k AS (SELECT {_N.format('a')} || CASE WHEN a % 4 = 1 THEN '@job_' || (b % 5) ELSE '' END AS s, {_N.format('b')} || CASE WHEN b % 4 = 1 THEN '@job_' || (b % 5) ELSE '' END AS t, a % 4 = 1 AS src_temp, b % 4 = 1 AS dst_temp FROM ab),
        walk AS (SELECT s AS src, t, dst_temp FROM k WHERE NOT src_temp UNION SELECT w.src, k.t, k.dst_temp FROM walk w JOIN k ON w.t = k.s WHERE w.dst_temp)
        SELECT DISTINCT src, t AS dst FROM walk WHERE NOT dst_temp""",
    "lineage_downstream_closure": f"{_V}, r AS (SELECT n, 0 AS hops FROM v WHERE n % 100 = 7 UNION SELECT ge.b, r.hops + 1 FROM r JOIN ge ON r.n = ge.a) SELECT {_N.format('n')} AS node, min(hops)::INT AS hops FROM r GROUP BY n",
    "lineage_paths": f"""{_V}, p AS (SELECT 7::BIGINT AS n, ['dws_n7'] AS path UNION ALL SELECT ge.a, list_append(p.path, {_N.format('ge.a')}) FROM p JOIN ge ON p.n = ge.b WHERE len(p.path) <= 3)
        SELECT {_N.format('n')} AS node, array_to_string(path, '>') AS path FROM p""",
    "multi_writer_datasets": f"{_IO} SELECT table_name, string_agg(job, ',' ORDER BY job) AS jobs FROM io WHERE io_type = 'OUTPUT' GROUP BY 1 HAVING count(*) > 1",
    "producer_resolution": f"""{_IO}, x AS (SELECT i.job, i.table_name, coalesce(bool_or(o.job = i.job), FALSE) AS own, count(DISTINCT o.job) FILTER (o.job <> i.job) AS n, min(o.job) FILTER (o.job <> i.job) AS only_one
            FROM io i LEFT JOIN io o ON o.io_type = 'OUTPUT' AND o.table_name = i.table_name WHERE i.io_type = 'INPUT' GROUP BY 1, 2)
        SELECT job, table_name, CASE WHEN own THEN 'own' WHEN n = 1 THEN 'resolved' WHEN n = 0 THEN 'missing' ELSE 'ambiguous' END AS status, CASE WHEN NOT own AND n = 1 THEN only_one END AS producer FROM x""",
    "topological_levels": f"{_V}, r AS (SELECT n, 0 AS lv FROM v UNION SELECT ge.b, r.lv + 1 FROM r JOIN ge ON r.n = ge.a) SELECT {_N.format('n')} AS node, max(lv)::INT AS level FROM r GROUP BY n",
    "reuse_score": f"""{_V} SELECT round(coalesce(avg(round(least(100.0::DOUBLE, coalesce(k, 0) * 100.0::DOUBLE / 3), 1)), 0), 1) AS score
        FROM m LEFT JOIN (SELECT a, count(*) AS k FROM ge GROUP BY 1) ON n = a WHERE layer IN ('DWD', 'DWS', 'DIM')""",
    "layer_violation_edges": f"""{_V}, cy AS (SELECT a, b FROM ge UNION SELECT c_custkey // 3, c_custkey FROM customer WHERE c_custkey % 7 = 3), k AS (SELECT *, {_RANK.format('layer')} AS r FROM m)
        SELECT x.name AS src, y.name AS dst, CASE WHEN y.r < x.r THEN 'reverse' ELSE 'skip' END AS kind FROM cy JOIN k x ON x.n = a JOIN k y ON y.n = b WHERE (y.r < x.r OR y.r > x.r + 1) AND NOT (x.layer = 'DIM' AND y.layer = 'ADS')""",
    "rule_pass_rates": f"WITH {_CHECKS} SELECT rule, count(*) FILTER (passed) AS passed, count(*) AS total, round(count(*) FILTER (passed) * 100.0::DOUBLE / count(*), 1) AS pct FROM c GROUP BY 1",
    "model_design_score": f"""WITH {_CHECKS}, w AS (SELECT target, least(3.0::DOUBLE, sum(CASE length(rule) % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END)) AS w FROM c WHERE NOT passed GROUP BY 1)
        SELECT greatest(0.0::DOUBLE, 100.0::DOUBLE * (1 - coalesce(sum(w), 0) / (SELECT count(DISTINCT target) FROM c))) AS score FROM w""",
    "overall_weighted_score": f"""WITH {_CHECKS}, n AS (SELECT dimension, round(sum(coalesce(score_passed, passed::INT)) * 100.0::DOUBLE / sum(coalesce(score_total, 1)), 1) AS score FROM c GROUP BY 1),
        w(dimension, weight) AS (VALUES ('reuse', 0.18::DOUBLE), ('depth', 0.18), ('model_design', 0.18), ('naming', 0.5), ('asset_completeness', 0.09), ('metadata_health', 0.09), ('code_quality', 0.1)), x AS (SELECT dimension, round(weight / sum(weight) OVER (), 6) AS weight FROM w)
        SELECT round(sum(weight * coalesce(score, 100)) / sum(weight), 2) AS overall FROM x LEFT JOIN n USING (dimension)""",
    "issue_diff": f"""WITH {_CHECKS}, f AS (SELECT DISTINCT lower(target) || '|' || rule AS fingerprint FROM c WHERE NOT passed)
        SELECT fingerprint, CASE WHEN fingerprint LIKE '%3' THEN 'new' WHEN fingerprint LIKE '%5' THEN 'fixed' ELSE 'remaining' END AS state FROM f""",
    # by hand: columns whose number isn't a multiple of three have an id; the others go by name, and a new name makes them a drop and an add
    "schema_diff": """WITH p AS (SELECT p_partkey AS n, CASE WHEN p_partkey // 5 <> 3 THEN 't' || (p_partkey // 5) END AS table_id, CASE WHEN p_partkey % 3 > 0 THEN p_partkey::VARCHAR END AS column_id, 'c' || p_partkey AS o,
            CASE WHEN p_partkey % 7 = 2 THEN 'c' || p_partkey || '_new' ELSE 'C' || p_partkey END AS w, p_partkey % 11 <> 1 AS was, p_partkey % 11 <> 5 AS "is", p_partkey % 7 = 2 AS ren, p_partkey % 13 = 4 AS mod FROM part)
        SELECT table_id, column_id, CASE WHEN NOT was THEN 'add' WHEN NOT "is" THEN 'drop' WHEN ren AND mod THEN 'rename_modify' WHEN ren THEN 'rename' ELSE 'modify' END AS change, CASE WHEN was THEN o END AS old_name, CASE WHEN "is" THEN w END AS new_name
        FROM p WHERE (was OR "is") AND (NOT was OR NOT "is" OR ren OR mod) AND NOT (column_id IS NULL AND ren AND was AND "is")
        UNION ALL SELECT table_id, column_id, 'drop', o, NULL FROM p WHERE column_id IS NULL AND ren AND was AND "is" UNION ALL SELECT table_id, column_id, 'add', NULL, w FROM p WHERE column_id IS NULL AND ren AND was AND "is" """,
    "naming_rule_checks": f"{_V} SELECT name, layer, CASE layer {' '.join(f'''WHEN '{k}' THEN regexp_full_match(lower(name), '{p}')''' for k, p in PATTERNS.items())} ELSE TRUE END AS passed FROM m",
    "date_window_periods": """SELECT DISTINCT day, period, CASE period WHEN 'W' THEN date_trunc('week', day)::DATE WHEN 'M' THEN date_trunc('month', day)::DATE ELSE day END AS period_start,
               CASE period WHEN 'W' THEN date_trunc('week', day)::DATE + 6 WHEN 'M' THEN last_day(day) ELSE day END AS period_end, (day - INTERVAL 3 MONTH)::DATE AS three_months_back
        FROM (SELECT o_orderdate::DATE AS day, ['D', 'W', 'M'][(o_orderkey % 3)::INT + 1] AS period FROM orders)""",
}
