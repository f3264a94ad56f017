"""Lineage queries over edges made from lineitem: 76 tables in four layers, names in either case, 40 jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assess, graph, verify
from .sales import table

LAYERS = ("ods", "dwd", "dws", "ads")


def _table_name(i):
    prefix = F.element_at(F.array(*[F.lit(x) for x in LAYERS]), F.least(F.floor(i / 15), F.lit(3)).cast("int") + 1)
    return F.concat(prefix, F.lit("_t"), i.cast("string"))


def edges_of(spark, d):
    """job, src, src_column, dst, dst_column, src_temp and dst_temp: an edge leads to one of the nine tables from the eighth on;
    two thirds of the tables have one writer."""
    a, b = F.col("l_partkey") % 60, F.col("l_partkey") % 60 + 8 + F.col("l_suppkey") % 9
    name = lambda i: F.when(F.col("l_linenumber") % 2 == 1, F.upper(_table_name(i))).otherwise(_table_name(i))
    e = table(spark, d, "lineitem").select(
        F.concat(F.lit("job_"), (F.when(b % 3 == 0, F.col("l_partkey")).otherwise(b) % 40).cast("string")).alias("job"), name(a).alias("src"), F.concat(F.lit("c"), (F.col("l_linenumber") % 3).cast("string")).alias("src_column"),
        name(b).alias("dst"), F.concat(F.lit("c"), (F.col("l_quantity").cast("int") % 3).cast("string")).alias("dst_column"), (a % 9 == 4).alias("src_temp"), (b % 9 == 4).alias("dst_temp"))
    return e.distinct()


def models_of(edges):
    n = graph.table_graph(edges)
    names = n.select(F.col("src").alias("name")).union(n.select("dst")).distinct()
    return names.withColumn("layer", F.upper(F.substring_index("name", "_", 1)))


def io_of(edges):
    return edges.selectExpr("job", "src as table_name", "'INPUT' as io_type").union(edges.selectExpr("job", "dst", "'OUTPUT'")).distinct()


def _seed(spark, name="DWD_t20"):
    return spark.createDataFrame([(name,)], "node string")


def lineage_upstream_closure(spark, d):
    return graph.reachable(edges_of(spark, d), _seed(spark), direction="upstream")


def lineage_both_ways(spark, d):
    return graph.reachable(edges_of(spark, d), _seed(spark), 2, "both")


def lineage_bounded_subgraph(spark, d):
    return graph.bounded_subgraph(edges_of(spark, d), "Dws_T33", 2, "upstream")


def lineage_path_test(spark, d):
    n = models_of(edges_of(spark, d)).select("name")
    pairs = n.where("name like '%0'").select(F.col("name").alias("src")).join(n.where("name like '%5'").select(F.col("name").alias("dst")), F.substring("src", 1, 1) == F.substring("dst", 1, 1))
    return graph.path_exists(edges_of(spark, d), pairs)


def lineage_upstream_paths(spark, d):
    return graph.simple_paths(edges_of(spark, d), _seed(spark), 3, "upstream").select("node", F.array_join("path", ">").alias("path"))


def lineage_column_paths(spark, d):
    return graph.column_paths(edges_of(spark, d), "dwd_t20", "C1", 2).select("node", F.array_join("path", ">").alias("path"))


def lineage_levels(spark, d):
    e = edges_of(spark, d)
    return graph.levels(models_of(e).select(F.col("name").alias("node")), e)


def column_collapse(spark, d):
    return graph.collapse_columns(edges_of(spark, d)).withColumn("path", F.array_join("path", ">"))


def table_collapse(spark, d):
    return graph.collapse_temporary(edges_of(spark, d))


def edge_jobs(spark, d):
    return graph.edge_evidence(edges_of(spark, d)).withColumn("jobs", F.array_join("jobs", ","))


def self_reading_jobs(spark, d):
    e = edges_of(spark, d)
    return graph.self_edges(e.union(e.where("src_column = 'c1'").withColumn("dst", F.lower("src"))))


def multi_output_jobs(spark, d):
    e = edges_of(spark, d)
    return graph.multi_outputs(io_of(e), e.where("dst_temp").select(F.col("dst").alias("table_name"))).withColumn("tables", F.array_join("tables", ","))


def input_producers(spark, d):
    return graph.producers(io_of(edges_of(spark, d)))


def schedule_candidates(spark, d):
    return graph.schedule_candidates(io_of(edges_of(spark, d))).withColumn("tables", F.array_join("tables", ","))


def _schedule(spark):
    steps = spark.range(40).withColumn("to", F.explode(F.array(F.col("id") + 1, F.col("id") + 7))).where("to < 40")
    return steps.select(F.concat(F.lit("JOB_"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("job_"), F.col("to").cast("string")).alias("dst"))


def schedule_gaps(spark, d):
    return graph.schedule_gaps(io_of(edges_of(spark, d)), _schedule(spark)).withColumn("tables", F.array_join("tables", ","))


def unsafe_consumers(spark, d):
    e = edges_of(spark, d).where("src_column = 'c1' and dst_column = 'c1'")
    jobs = io_of(e).select("job").distinct().where("job like '%1' or job like '%3'")
    return graph.unsafe_consumers(io_of(e), jobs, e.where("dst_temp").select(F.col("dst").alias("table_name")))


def selected_dependencies(spark, d):
    e = edges_of(spark, d)
    return graph.induced(e, models_of(e).where("layer in ('DWD', 'DWS')").select(F.col("name").alias("node")))


def edge_snapshot_diff(spark, d):
    e = graph.folded(edges_of(spark, d), "src", "dst").groupBy("src", "dst").agg(F.min("job").alias("job"), F.min("src_column").alias("src_column"))
    old = e.where("src not like '%7'")
    new = e.where("dst not like '%3'").withColumn("job", F.when(F.col("src").like("%5"), F.lit("other")).otherwise(F.col("job")))
    return graph.edge_diff(old, new, ["src", "dst"], ["job", "src_column"])


def project_stats(spark, d):
    e = edges_of(spark, d)
    return graph.project_stats(models_of(e), e, io_of(e))


def name_resolution(spark, d):
    e = edges_of(spark, d)
    known = e.select(F.col("src").alias("name")).union(e.select("dst")).distinct()
    asked = known.where("name like '%1'").select(F.initcap("name").alias("name")).union(known.where("name like '%2'").select("name")).union(spark.createDataFrame([("nowhere",)], "name string"))
    return graph.resolve(asked, known.where("name not like 'DWD%'"))


def middle_depth_score(spark, d):
    e = edges_of(spark, d)
    return assess.depth_score(models_of(e), e)


def middle_depth(spark, d):
    e = edges_of(spark, d)
    return assess.depth_scores(models_of(e), e)


def dependency_classes(spark, d):
    e = edges_of(spark, d)
    return assess.dependency_classes(models_of(e), e.union(e.where("src_column = 'c0'").withColumns({"src": F.col("dst"), "dst": F.col("src")})))


def reuse_score_lineitem(spark, d):
    e = edges_of(spark, d)
    return assess.reuse_score(models_of(e), e)


def table_contexts(spark, d):
    e = edges_of(spark, d)
    out = assess.table_contexts(models_of(e), e, e.select(F.col("src").alias("table_name"), F.col("src_column").alias("name")))
    return out.withColumns({c: F.array_join(c, ",") for c in ("upstream", "downstream", "columns")})


def _typed(e):
    return e.withColumn("transformation", F.when(F.col("src_column") == "c0", "SUM").when(F.col("dst_column") == "c1", "passthrough").otherwise("constant"))


def _metrics(spark, d):
    return edges_of(spark, d).where("src_column = 'c2' and upper(src) like 'ODS%'").select(F.col("src").alias("table_name"), F.col("src_column").alias("column")).distinct()


def metric_fixpoint(spark, d):
    return assess.propagate_metrics(_typed(edges_of(spark, d)), _metrics(spark, d))


def metric_promotion(spark, d):
    return assess.promote_metrics(_typed(edges_of(spark, d)), edges_of(spark, d).where("dst_column = 'c1'").select(F.col("dst").alias("table_name"), F.col("dst_column").alias("column")))


def base_metrics(spark, d):
    m = edges_of(spark, d).where("src_column = 'c1' and dst_column = 'c2'")
    m = m.select(F.col("src").alias("table_name"), F.col("src_column").alias("column")).union(m.select("dst", "dst_column"))
    return assess.base_metrics(edges_of(spark, d).where("job like '%7'"), m)


def _facts(spark, d):
    n = F.regexp_extract("name", "([0-9]+)$", 1).cast("int")
    return models_of(edges_of(spark, d)).select(
        F.col("name").alias("table_name"), F.md5("name").alias("local_fingerprint"), F.when(n % 3 == 0, "equivalent").when(n % 3 == 1, "changed").alias("automatic_mode"),
        F.when(n % 10 == 7, "equivalent").when(n % 10 == 9, "changed").alias("declared_mode"), F.when(n % 20 == 9, "stale").alias("declared_context"), (n % 11 == 5).alias("is_direct"), (n % 2 == 0).alias("comparable"))


def semantic_modes(spark, d):
    return verify.resolve_modes(_facts(spark, d), edges_of(spark, d)).select("table_name", "mode", "source", F.col("fingerprint").rlike("^sha256:[0-9a-f]{64}$").alias("hashed"))


def validation_boundaries(spark, d):
    facts, e = _facts(spark, d), edges_of(spark, d)
    return verify.boundaries(verify.resolve_modes(facts, e), e, facts)


QUERIES = {f.__name__: f for f in (
    lineage_upstream_closure, lineage_both_ways, lineage_bounded_subgraph, lineage_path_test, lineage_upstream_paths, lineage_column_paths, lineage_levels, column_collapse, table_collapse,
    edge_jobs, self_reading_jobs, multi_output_jobs, input_producers, schedule_candidates, schedule_gaps, unsafe_consumers, selected_dependencies, edge_snapshot_diff, project_stats,
    name_resolution, middle_depth_score, middle_depth, dependency_classes, reuse_score_lineitem, table_contexts, metric_fixpoint, metric_promotion, base_metrics, semantic_modes, validation_boundaries)}

_NAME = "(CASE WHEN {0} < 15 THEN 'ods' WHEN {0} < 30 THEN 'dwd' WHEN {0} < 45 THEN 'dws' ELSE 'ads' END || '_t' || {0})"
_A, _B = "(l_partkey % 60)", "(l_partkey % 60 + 8 + l_suppkey % 9)"
_CASED = lambda i: f"CASE WHEN l_linenumber % 2 = 1 THEN upper({_NAME.format(i)}) ELSE {_NAME.format(i)} END"
EDGES_SQL = f"""e AS (SELECT DISTINCT 'job_' || (CASE WHEN {_B} % 3 = 0 THEN l_partkey ELSE {_B} END % 40) AS job, {_CASED(_A)} AS src, 'c' || (l_linenumber % 3) AS src_column, {_CASED(_B)} AS dst, 'c' || (l_quantity::INT % 3) AS dst_column,
        {_A} % 9 = 4 AS src_temp, {_B} % 9 = 4 AS dst_temp FROM lineitem),
    g AS (SELECT DISTINCT lower(src) AS src, lower(dst) AS dst FROM e WHERE lower(src) <> lower(dst)),
    m AS (SELECT name, upper(split_part(name, '_', 1)) AS layer FROM (SELECT src AS name FROM g UNION SELECT dst FROM g)),
    io AS (SELECT DISTINCT job, lower(src) AS table_name, 'INPUT' AS io_type FROM e UNION SELECT DISTINCT job, lower(dst), 'OUTPUT' FROM e)"""
_W = f"WITH RECURSIVE {EDGES_SQL}"
_RANK = lambda c: f"CASE {c} WHEN 'ODS' THEN 0 WHEN 'DIM' THEN 1 WHEN 'DWD' THEN 1 WHEN 'DWS' THEN 2 ELSE 3 END"
_SCHED = """wr AS (SELECT table_name, job FROM io WHERE io_type = 'OUTPUT'),
    rd AS (SELECT table_name, job FROM io WHERE io_type = 'INPUT' AND NOT EXISTS (SELECT 1 FROM wr WHERE wr.table_name = io.table_name AND wr.job = io.job)),
    cand AS (SELECT wr.job AS upstream, rd.job AS downstream, string_agg(DISTINCT rd.table_name, ',' ORDER BY rd.table_name) AS tables FROM rd JOIN wr USING (table_name) GROUP BY 1, 2)"""
_LASTING_C = """k AS (SELECT DISTINCT lower(src) || CASE WHEN src_temp THEN '@' || job ELSE '' END AS src, lower(dst) || CASE WHEN dst_temp THEN '@' || job ELSE '' END AS dst, lower(src) AS s0, lower(dst) AS d0,
        src_column, dst_column, src_temp, dst_temp FROM e)"""
_DEPTH = f"""lv AS (SELECT name AS node, (layer IN ('DWD', 'DWS', 'DIM'))::INT AS depth FROM m WHERE name NOT IN (SELECT dst FROM g)
        UNION SELECT g.dst, lv.depth + (m.layer IN ('DWD', 'DWS', 'DIM'))::INT FROM lv JOIN g ON g.src = lv.node JOIN m ON m.name = g.dst),
    dep AS (SELECT node AS name, max(depth)::INT AS depth FROM lv JOIN m ON m.name = node WHERE layer = 'ADS' GROUP BY 1),
    sc AS (SELECT *, CASE depth WHEN 2 THEN 100 WHEN 1 THEN 50 WHEN 0 THEN 0 ELSE 30 END AS score FROM dep)"""
# modes don't depend on the fingerprints here: the declared context is null or never right
_MODES = f"""f AS (SELECT name AS table_name, regexp_extract(name, '([0-9]+)$', 1)::INT AS n FROM m),
    dc AS (SELECT *, CASE WHEN n % 10 = 7 THEN 'equivalent' WHEN n % 10 = 9 AND n % 20 <> 9 THEN 'changed' END AS declared FROM f),
    -- a table without a declaration is unknown if it isn't equivalent automatically, or below a changed or unknown one
    bad AS (SELECT table_name FROM dc WHERE declared = 'changed' OR (declared IS NULL AND n % 3 <> 0)
        UNION SELECT dc.table_name FROM bad JOIN g ON g.src = bad.table_name JOIN dc ON dc.table_name = g.dst WHERE dc.declared IS NULL),
    md AS (SELECT dc.*, EXISTS (SELECT 1 FROM g JOIN bad ON bad.table_name = g.src WHERE g.dst = dc.table_name) AS risky FROM dc),
    rs AS (SELECT table_name, n, CASE WHEN declared IS NOT NULL THEN declared WHEN risky THEN 'unknown' WHEN n % 3 = 0 THEN 'equivalent' ELSE 'unknown' END AS mode,
                  CASE WHEN declared IS NOT NULL THEN 'user' WHEN risky THEN 'upstream_propagation' WHEN n % 3 = 0 THEN 'automatic' ELSE 'default_unknown' END AS source FROM md)"""
_TYPED = "ty AS (SELECT *, CASE WHEN src_column = 'c0' THEN 'SUM' WHEN dst_column = 'c1' THEN 'PASSTHROUGH' ELSE 'CONSTANT' END AS t, lower(src) || '.' || src_column AS s, lower(dst) || '.' || dst_column AS d FROM e)"
ORACLE_SQL = {
    "lineage_upstream_closure": f"{_W}, r AS (SELECT 'dwd_t20' AS node, 0 AS hops UNION SELECT g.src, r.hops + 1 FROM r JOIN g ON g.dst = r.node) SELECT node, min(hops)::INT AS hops FROM r GROUP BY 1",
    "lineage_both_ways": f"""{_W}, u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), r AS (SELECT 'dwd_t20' AS node, 0 AS hops UNION SELECT u.dst, r.hops + 1 FROM r JOIN u ON u.src = r.node WHERE r.hops < 2)
        SELECT node, min(hops)::INT AS hops FROM r GROUP BY 1""",
    "lineage_bounded_subgraph": f"""{_W}, r AS (SELECT 'dws_t33' AS node, 0 AS hops UNION SELECT g.src, r.hops + 1 FROM r JOIN g ON g.dst = r.node WHERE r.hops < 2), n AS (SELECT node, min(hops) AS hops FROM r GROUP BY 1)
        SELECT src, dst, (hops + 1)::INT AS hops, hops + 1 > 2 AS hidden FROM g JOIN n ON n.node = g.dst""",
    "lineage_path_test": f"""{_W}, pr AS (SELECT a.name AS src, b.name AS dst FROM m a JOIN m b ON a.name[1] = b.name[1] WHERE a.name LIKE '%0' AND b.name LIKE '%5'),
        r AS (SELECT DISTINCT src AS origin, src AS node FROM pr UNION SELECT r.origin, g.dst FROM r JOIN g ON g.src = r.node)
        SELECT src, dst, EXISTS (SELECT 1 FROM r WHERE r.origin = pr.src AND r.node = pr.dst) AS reached FROM pr""",
    "lineage_upstream_paths": f"""{_W}, p AS (SELECT 'dwd_t20' AS node, ['dwd_t20'] AS path UNION ALL SELECT g.src, list_append(p.path, g.src) FROM p JOIN g ON g.dst = p.node WHERE NOT list_contains(p.path, g.src) AND len(p.path) <= 3)
        SELECT node, array_to_string(path, '>') AS path FROM p""",
    "lineage_column_paths": f"""{_W}, ce AS (SELECT DISTINCT lower(src) || '.' || src_column AS s, lower(dst) || '.' || dst_column AS d FROM e),
        p AS (SELECT 'dwd_t20.c1' AS node, ['dwd_t20.c1'] AS path UNION ALL SELECT ce.s, list_append(p.path, ce.s) FROM p JOIN ce ON ce.d = p.node WHERE NOT list_contains(p.path, ce.s) AND len(p.path) <= 2)
        SELECT node, array_to_string(path, '>') AS path FROM p""",
    "lineage_levels": f"{_W}, r AS (SELECT name AS node, 0 AS lv FROM m UNION SELECT g.dst, r.lv + 1 FROM r JOIN g ON r.node = g.src) SELECT node, max(lv)::INT AS level FROM r GROUP BY 1",
    "column_collapse": f"""{_W}, {_LASTING_C}, w AS (SELECT src, src_column, dst, dst_column, d0, dst_temp, []::VARCHAR[] AS path FROM k WHERE NOT src_temp
        UNION ALL SELECT w.src, w.src_column, k.dst, k.dst_column, k.d0, k.dst_temp, list_append(w.path, w.d0 || '.' || w.dst_column) FROM w JOIN k ON k.src = w.dst AND k.src_column = w.dst_column WHERE w.dst_temp)
        SELECT DISTINCT src, src_column, dst, dst_column, array_to_string(path, '>') AS path FROM w WHERE NOT dst_temp""",
    "table_collapse": f"""{_W}, {_LASTING_C}, w AS (SELECT src, dst, dst_temp FROM k WHERE NOT src_temp UNION SELECT w.src, k.dst, k.dst_temp FROM w JOIN k ON k.src = w.dst WHERE w.dst_temp)
        SELECT DISTINCT src, dst FROM w WHERE NOT dst_temp""",
    "edge_jobs": f"{_W} SELECT lower(src) AS src, lower(dst) AS dst, string_agg(DISTINCT job, ',' ORDER BY job) AS jobs, count(DISTINCT job) AS n_jobs FROM e GROUP BY 1, 2",
    "self_reading_jobs": f"{_W} SELECT DISTINCT job, lower(src) AS table_name FROM e WHERE src_column = 'c1'",
    "multi_output_jobs": f"""{_W} SELECT job, string_agg(table_name, ',' ORDER BY table_name) AS tables FROM io WHERE io_type = 'OUTPUT' AND table_name NOT IN (SELECT lower(dst) FROM e WHERE dst_temp)
        GROUP BY 1 HAVING count(*) > 1""",
    "input_producers": f"""{_W}, x AS (SELECT i.job, i.table_name, coalesce(bool_or(o.job = i.job), FALSE) AS own, count(DISTINCT o.job) FILTER (o.job <> i.job) AS n, min(o.job) FILTER (o.job <> i.job) AS only_one
            FROM io i LEFT JOIN io o ON o.io_type = 'OUTPUT' AND o.table_name = i.table_name WHERE i.io_type = 'INPUT' GROUP BY 1, 2)
        SELECT job, table_name, CASE WHEN own THEN 'own' WHEN n = 1 THEN 'resolved' WHEN n = 0 THEN 'missing' ELSE 'ambiguous' END AS status, CASE WHEN NOT own AND n = 1 THEN only_one END AS producer FROM x""",
    "schedule_candidates": f"{_W}, {_SCHED} SELECT * FROM cand",
    # the schedule is a chain of jobs by number
    "schedule_gaps": f"{_W}, {_SCHED} SELECT * FROM cand WHERE split_part(upstream, '_', 2)::INT >= split_part(downstream, '_', 2)::INT",
    "unsafe_consumers": f"""{_W}, z AS (SELECT * FROM e WHERE src_column = 'c1' AND dst_column = 'c1'), zo AS (SELECT DISTINCT lower(dst) AS t, job FROM z), zi AS (SELECT DISTINCT lower(src) AS t, job FROM z),
        x AS (SELECT zi.job, zi.t, min(zo.job) AS producer FROM zi JOIN zo ON zo.t = zi.t GROUP BY 1, 2 HAVING count(*) = 1 AND min(zo.job) <> zi.job), pk AS (SELECT DISTINCT job FROM z WHERE job LIKE '%1' OR job LIKE '%3')
        SELECT job, t AS table_name, producer FROM x WHERE job IN (SELECT job FROM pk) AND producer NOT IN (SELECT job FROM pk) AND t IN (SELECT lower(dst) FROM z WHERE dst_temp)""",
    "selected_dependencies": f"{_W} SELECT g.src, g.dst, a.layer IN ('DWD', 'DWS') AS selected FROM g JOIN m a ON a.name = g.src JOIN m b ON b.name = g.dst WHERE b.layer IN ('DWD', 'DWS')",
    "edge_snapshot_diff": f"""{_W}, j AS (SELECT lower(src) AS src, lower(dst) AS dst FROM e GROUP BY 1, 2)
        SELECT src, dst, CASE WHEN src LIKE '%7' THEN 'added' WHEN dst LIKE '%3' THEN 'removed' ELSE 'changed' END AS change FROM j
        WHERE (src LIKE '%7' AND dst NOT LIKE '%3') OR (src NOT LIKE '%7' AND (dst LIKE '%3' OR src LIKE '%5'))""",
    "project_stats": f"""{_W} SELECT 'layer:' || layer AS fact, count(*) AS n FROM m GROUP BY 1 UNION ALL SELECT 'edges', count(*) FROM g UNION ALL SELECT 'jobs', count(DISTINCT job) FROM e
        UNION ALL SELECT 'multi_writer_tables', count(*) FROM (SELECT table_name FROM io WHERE io_type = 'OUTPUT' GROUP BY 1 HAVING count(*) > 1)""",
    "name_resolution": f"""{_W}, k AS (SELECT src AS name FROM e UNION SELECT dst FROM e), asked AS (SELECT upper(name[1]) || lower(name[2:3]) || lower(name[4:]) AS name FROM k WHERE name LIKE '%1' UNION SELECT name FROM k WHERE name LIKE '%2' UNION SELECT 'nowhere'),
        kn AS (SELECT * FROM k WHERE name NOT LIKE 'DWD%'), x AS (SELECT a.name, count(kn.name) AS n, min(kn.name) AS one, coalesce(bool_or(kn.name = a.name), FALSE) AS exact FROM asked a LEFT JOIN kn ON lower(kn.name) = lower(a.name) GROUP BY 1)
        SELECT name, CASE WHEN exact THEN name WHEN n = 1 THEN one END AS resolved, CASE WHEN exact THEN 'exact' WHEN n = 1 THEN 'folded' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status FROM x""",
    "middle_depth_score": f"{_W}, {_DEPTH} SELECT round(coalesce(avg(score), 100.0), 1)::DOUBLE AS score FROM sc",
    "middle_depth": f"{_W}, {_DEPTH} SELECT name, depth, score FROM sc",
    "dependency_classes": f"""{_W}, x AS (SELECT src, dst FROM g UNION SELECT lower(dst), lower(src) FROM e WHERE src_column = 'c0' AND lower(src) <> lower(dst)),
        y AS (SELECT x.*, {_RANK('b.layer')} - {_RANK('a.layer')} AS step FROM x JOIN m a ON a.name = x.src JOIN m b ON b.name = x.dst)
        SELECT src, dst, CASE WHEN step < 0 THEN 'reverse' WHEN step = 0 THEN 'same' WHEN step = 1 THEN 'next' ELSE 'skip' END AS kind FROM y""",
    "reuse_score_lineitem": f"""{_W} SELECT round(coalesce(avg(round(least(100.0::DOUBLE, coalesce(n, 0) * 100.0::DOUBLE / 3), 1)), 0), 1) AS score
        FROM m LEFT JOIN (SELECT src, count(*) AS n FROM g GROUP BY 1) ON name = src WHERE layer IN ('DWD', 'DWS', 'DIM')""",
    "table_contexts": f"""{_W} SELECT name, layer, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM g WHERE dst = name), '') AS upstream, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM g WHERE src = name), '') AS downstream,
        coalesce((SELECT string_agg(DISTINCT src_column, ',' ORDER BY src_column) FROM e WHERE lower(src) = name), '') AS columns FROM m""",
    "metric_fixpoint": f"""{_W}, {_TYPED}, r AS (SELECT DISTINCT s AS node FROM ty WHERE src_column = 'c2' AND s LIKE 'ods%' UNION SELECT ty.d FROM r JOIN ty ON ty.s = r.node WHERE t <> 'CONSTANT' AND lower(src) <> lower(dst))
        SELECT split_part(node, '.', 1) AS table_name, split_part(node, '.', 2) AS "column" FROM r""",
    "metric_promotion": f"""{_W}, {_TYPED}, mt AS (SELECT DISTINCT d FROM ty WHERE dst_column = 'c1')
        SELECT DISTINCT lower(src) AS table_name, src_column AS "column" FROM ty WHERE t = 'SUM' AND d IN (SELECT d FROM mt) AND s NOT IN (SELECT d FROM mt)""",
    "base_metrics": f"""{_W}, {_TYPED}, mt AS (SELECT s AS x FROM ty WHERE src_column = 'c1' AND dst_column = 'c2' UNION SELECT d FROM ty WHERE src_column = 'c1' AND dst_column = 'c2'),
        u AS (SELECT d, count(DISTINCT s) AS n, min(s) AS one FROM ty WHERE job LIKE '%7' AND s IN (SELECT x FROM mt) GROUP BY 1)
        SELECT split_part(x, '.', 1) AS table_name, split_part(x, '.', 2) AS "column", CASE WHEN n = 1 THEN one END AS base, CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM mt LEFT JOIN u ON d = x""",
    "semantic_modes": f"{_W}, {_MODES} SELECT table_name, mode, source, TRUE AS hashed FROM rs",
    "validation_boundaries": f"""{_W}, {_MODES}, wk AS (SELECT table_name FROM rs WHERE n % 11 = 5 OR source = 'user' UNION SELECT g.dst FROM wk JOIN rs ON rs.table_name = wk.table_name JOIN g ON g.src = rs.table_name WHERE rs.mode <> 'equivalent')
        SELECT table_name, CASE WHEN mode = 'equivalent' THEN 'authority' WHEN mode = 'unknown' AND n % 2 = 0 AND table_name NOT IN (SELECT src FROM g) THEN 'observational' ELSE 'passed' END AS boundary FROM rs WHERE table_name IN (SELECT table_name FROM wk)""",
}
