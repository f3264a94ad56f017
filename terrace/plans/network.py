"""Lineage queries over a graph that grows with the data: a table for each customer, some ten levels deep, with dimensions and cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assess, canonical, cycles, graph, periods, quality, verify
from .sales import table
from .stored import _START


def _name(n):
    prefix = F.when(n < 6, "ads").when((n < 200) & (n % 3 == 0), "dim").when(n < 40, "dws").when(n < 200, "dwd").otherwise("ods")
    return F.concat(prefix, F.lit("_n"), n.cast("string"))


def _number(c="name"):
    return F.regexp_extract(c, "([0-9]+)$", 1).cast("long")


def edges_of(spark, d):
    """src and dst: every customer's table feeds that of a third of its number, and one of about half of it for each order."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("a")).withColumn("b", F.expr("a div 3"))
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("a"), F.expr("o_custkey div 2 - o_orderkey % 2").cast("long").alias("b")).where("b >= 0 and b < a")
    return graph.settle(c.union(o).distinct().select(_name(F.col("a")).alias("src"), _name(F.col("b")).alias("dst")))


def cyclic_edges_of(spark, d):
    """The same, and some tables are fed by what they feed."""
    back = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("a")).where("a % 7 = 3")
    return edges_of(spark, d).union(back.select(_name(F.expr("a div 3")), _name(F.col("a"))))


def models_of(edges):
    return edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct().withColumn("layer", F.upper(F.substring("name", 1, 3)))


def network_cycle_members(spark, d):
    return cycles.components(cyclic_edges_of(spark, d))


def network_middle_depth(spark, d):
    e = cyclic_edges_of(spark, d)
    return assess.depth_scores(models_of(e), e)


def network_dependency_classes(spark, d):
    e = edges_of(spark, d)
    return assess.dependency_classes(models_of(e), e)


def _windows(spark, d):
    e = edges_of(spark, d)
    n = _number()
    of = models_of(e)
    day = F.date_add(F.lit("2024-01-15").cast("date"), (n * 9).cast("int")).cast("timestamp_ntz")
    anchors = of.where("layer = 'ADS'").select(F.upper("name").alias("table_name"), day.alias("start"), (day + F.expr("interval 1 day")).alias("end"))
    kinds = of.select(F.col("name").alias("table_name"), F.element_at(F.array(*[F.lit(x) for x in ("D", "W", "M", "D")], F.lit(None)), (n % 5).cast("int") + 1).alias("period"))
    return periods.along_lineage(anchors, kinds, e)


def network_windows(spark, d):
    return _windows(spark, d).withColumn("anchors", F.array_join("anchors", ","))


def network_execution_values(spark, d):
    return periods.execution_values(_windows(spark, d))


def network_compare_scopes(spark, d):
    of, n = models_of(edges_of(spark, d)), _number()
    slices = of.where(n % 4 != 3).select(F.col("name").alias("table_name"), F.lit("stat_date").alias("time_column"), F.element_at(F.array(*[F.lit(x) for x in "HDWM"]), (n % 4).cast("int") + 1).alias("period"))
    at = F.when(F.length("table_name") % 2 == 0, F.lit("2024-02-29 13:45:00").cast("timestamp_ntz"))
    return periods.compare_scopes(of.select(F.upper("name").alias("table_name")), slices, at)


def _history_facts(of, changed, declared):
    n = _number()
    mode = F.when(n % 4 == 1, "equivalent").when(n % 8 == 6, "changed")
    return of.select(F.col("name").alias("table_name"), F.concat(F.lit("id-"), "name").alias("table_id"), F.md5(F.concat("name", F.when(changed & (n % 13 == 4), F.lit("x")).otherwise(F.lit("")))).alias("local_fingerprint"),
                     F.when(n % 3 == 0, "equivalent").alias("automatic_mode"), F.when(declared, mode).alias("declared_mode"), F.lit(None).cast("string").alias("declared_context"))


def declaration_history(spark, d):
    """One run declares some tables' modes; in the next some tables are other ones, and nothing is declared: what was declared
    for a table in the same context still holds. An older run that said otherwise doesn't count."""
    e = edges_of(spark, d)
    of = models_of(e)
    first = verify.resolve_modes(_history_facts(of, F.lit(False), F.lit(True)), e).where("source = 'user'")
    kept = first.select(F.concat(F.lit("id-"), "table_name").alias("table_id"), F.col("fingerprint").alias("context"), "mode", F.lit("r1").alias("run_id"), F.lit(1).alias("at"))
    older = kept.select("table_id", "context", F.lit("unknown").alias("mode"), F.lit("r0").alias("run_id"), F.lit(0).alias("at"))
    return verify.resolve_modes(_history_facts(of, F.lit(True), F.lit(False)), e, kept.unionByName(older)).select("table_name", "mode", "source", "run_id", F.col("fingerprint").rlike("^sha256:[0-9a-f]{64}$").alias("hashed"))


def canonical_rows(spark, d):
    """Every customer as JSON, whatever the order of its columns, and the hash."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.struct(F.col("n_name").alias("z"), F.array(F.col("c_nationkey"), F.lit(None)).alias("a")).alias("place"), "c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit('"\\\t'), "c_name", F.lit("é\n"))).alias("c_name"), F.create_map("c_mktsegment", F.lit(True), F.lit("A"), F.lit(False)).alias("flags"))
    text = c.select("c_custkey", canonical.row_json(c.schema).alias("text"))
    return text.withColumn("hash", F.sha2("text", 256))


def row_compare_tolerance(spark, d):
    """lineitem by order and flag, where keys repeat: prices that differ by less than the tolerance are the same, others not."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("double").alias("price"))
    other = F.when(F.col("l_orderkey") % 5 == 0, F.col("price") + 1).when(F.col("l_orderkey") % 3 == 0, F.col("price") + 0.005).otherwise(F.col("price"))
    return quality.compare_keyed(li, li.withColumn("price", other), ["l_orderkey", "l_returnflag"]).withColumn("columns", F.array_join("columns", ","))


QUERIES = {f.__name__: f for f in (network_cycle_members, network_middle_depth, network_dependency_classes, network_windows, network_execution_values, network_compare_scopes, declaration_history, canonical_rows, row_compare_tolerance)}

_N = "(CASE WHEN {0} < 6 THEN 'ads' WHEN {0} < 200 AND {0} % 3 = 0 THEN 'dim' WHEN {0} < 40 THEN 'dws' WHEN {0} < 200 THEN 'dwd' ELSE 'ods' END || '_n' || {0})"
_G = """WITH RECURSIVE ab AS (SELECT c_custkey AS a, c_custkey // 3 AS b FROM customer UNION SELECT o_custkey, o_custkey // 2 - o_orderkey % 2 FROM orders WHERE o_custkey // 2 - o_orderkey % 2 BETWEEN 0 AND o_custkey - 1),
    v AS (SELECT a AS n FROM ab UNION SELECT b FROM ab)"""
# on numbers: cy the cyclic edges, re who reaches whom over a cycle's edges alone, sc the least name of each table's cycle
_C = f"""{_G}, cy AS (SELECT a, b FROM ab UNION SELECT c_custkey // 3, c_custkey FROM customer WHERE c_custkey % 7 = 3),
    re AS (SELECT a, b FROM cy UNION SELECT re.a, cy.b FROM re JOIN cy ON cy.a = re.b),
    two AS (SELECT x.a, x.b FROM re x JOIN re y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b),
    sc AS (SELECT a AS n, least({_N.format('a')}, min({_N.format('b')})) AS component FROM two GROUP BY 1)"""
_W = f"""{_G}, an AS (SELECT n, 'ads_n' || n AS anchor, (DATE '2024-01-15' + (n * 9)::INT)::TIMESTAMP AS s FROM v WHERE n < 6),
    rw AS (SELECT n, anchor, gs AS s, ge AS e FROM (SELECT n, anchor, {{own_s}} AS gs, {{own_e}} AS ge FROM (SELECT n, anchor, s, s + INTERVAL 1 DAY AS e FROM an) q)
        UNION SELECT n, anchor, {{own_s}}, {{own_e}} FROM (SELECT ab.a AS n, rw.anchor, rw.s, rw.e FROM rw JOIN ab ON ab.b = rw.n) q),
    io AS (SELECT n, anchor, s, e, max(e) OVER (PARTITION BY n ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT n, s, e, list(anchor) AS anchor FROM rw GROUP BY ALL) x),
    il AS (SELECT *, sum((reach IS NULL OR s > reach)::INT) OVER (PARTITION BY n ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM io),
    wd AS (SELECT n, min(s) AS s, max(e) AS e, array_to_string(list_sort(list_distinct(flatten(list(anchor)))), ',') AS anchors FROM il GROUP BY n, island)"""
_PER = "CASE n % 5 WHEN 1 THEN 'W' WHEN 2 THEN 'M' WHEN 4 THEN NULL ELSE 'D' END"
_LAST = "e - INTERVAL 1 MICROSECOND"
_OWN_S = "CASE n % 5 WHEN 1 THEN date_trunc('week', s) WHEN 2 THEN date_trunc('month', s) WHEN 4 THEN s ELSE date_trunc('day', s) END::TIMESTAMP"
_OWN_E = f"CASE n % 5 WHEN 1 THEN date_trunc('week', {_LAST}) + INTERVAL 7 DAY WHEN 2 THEN date_trunc('month', {_LAST}) + INTERVAL 1 MONTH WHEN 4 THEN e ELSE date_trunc('day', {_LAST}) + INTERVAL 1 DAY END::TIMESTAMP"
_W = _W.format(own_s=_OWN_S, own_e=_OWN_E)
_JSON = r"""replace(replace(replace(replace('"\' || chr(9) || c_name || 'é' || chr(10), '\', '\\'), '"', '\"'), chr(9), '\t'), chr(10), '\n')"""
ORACLE_SQL = {
    "network_cycle_members": f"{_C} SELECT {_N.format('n')} AS node, component FROM sc",
    "network_middle_depth": f"""{_C}, gr AS (SELECT n, coalesce(component, {_N.format('n')}) AS g FROM v LEFT JOIN sc USING (n)), ow AS (SELECT g, count(*) FILTER (n >= 6 AND n < 200) AS own FROM gr GROUP BY 1),
        ge AS (SELECT DISTINCT x.g AS a, y.g AS b FROM cy JOIN gr x ON x.n = cy.a JOIN gr y ON y.n = cy.b WHERE x.g <> y.g),
        dp AS (SELECT g, own AS depth FROM ow WHERE g NOT IN (SELECT b FROM ge) UNION SELECT ge.b, dp.depth + ow.own FROM dp JOIN ge ON ge.a = dp.g JOIN ow ON ow.g = ge.b),
        mx AS (SELECT g, max(depth)::INT AS depth FROM dp GROUP BY 1)
        SELECT {_N.format('n')} AS name, depth, CASE depth WHEN 2 THEN 100 WHEN 1 THEN 50 WHEN 0 THEN 0 ELSE 30 END AS score FROM gr JOIN mx USING (g) WHERE n < 6""",
    "network_dependency_classes": f"""{_G}, nm AS (SELECT n, {_N.format('n')} AS name FROM v), rk AS (SELECT *, name[1:3] AS layer, CASE name[1:3] WHEN 'ods' THEN 0 WHEN 'dim' THEN 1 WHEN 'dwd' THEN 1 WHEN 'dws' THEN 2 ELSE 3 END AS r FROM nm)
        SELECT DISTINCT x.name AS src, y.name AS dst, CASE WHEN x.layer = 'dim' AND y.layer = 'ads' THEN 'next' WHEN y.r < x.r THEN 'reverse' WHEN y.r = x.r THEN 'same' WHEN y.r = x.r + 1 THEN 'next' ELSE 'skip' END AS kind
        FROM ab JOIN rk x ON x.n = a JOIN rk y ON y.n = b WHERE a <> b""",
    "network_windows": f"{_W} SELECT {_N.format('n')} AS table_name, {_PER} AS period, s AS start, e AS \"end\", anchors FROM wd",
    "network_execution_values": f"""{_W}, st AS (SELECT n, s, {_LAST} AS last, CASE n % 5 WHEN 1 THEN INTERVAL 7 DAY WHEN 2 THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END AS step FROM wd WHERE n % 5 <> 4)
        SELECT DISTINCT {_N.format('n')} AS table_name, unnest(generate_series(s, last, step)) AS period_start FROM st""",
    "network_compare_scopes": f"""{_G}, nm AS (SELECT {_N.format('n')} AS table_name, CASE WHEN n % 4 <> 3 THEN ['H', 'D', 'W', 'M'][(n % 4 + 1)::INT] END AS period FROM v),
        x AS (SELECT *, CASE WHEN length(table_name) % 2 = 0 THEN TIMESTAMP '2024-02-29 13:45:00' END AS t FROM nm), y AS (SELECT *, period IS NOT NULL AND t IS NOT NULL AS sliced FROM x),
        z AS (SELECT *, CASE WHEN sliced THEN ({_START.format(p='period', t='t')})::TIMESTAMP END AS start FROM y)
        SELECT table_name, CASE WHEN sliced THEN 'time_slice' ELSE 'full_table' END AS mode, CASE WHEN sliced THEN 'stat_date' END AS "column", CASE WHEN sliced THEN period END AS period, start,
               start + CASE period WHEN 'H' THEN INTERVAL 1 HOUR WHEN 'D' THEN INTERVAL 1 DAY WHEN 'W' THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END AS "end", CASE WHEN period IS NULL THEN 'no_slice' WHEN t IS NULL THEN 'no_value' END AS why FROM z""",
    "declaration_history": f"""{_G}, dirty AS (SELECT n FROM v WHERE n % 13 = 4 UNION SELECT ab.b FROM dirty JOIN ab ON ab.a = dirty.n),
        dc AS (SELECT n, CASE WHEN n NOT IN (SELECT n FROM dirty) THEN CASE WHEN n % 4 = 1 THEN 'equivalent' WHEN n % 8 = 6 THEN 'changed' END END AS declared FROM v),
        bad AS (SELECT n FROM dc WHERE declared = 'changed' OR (declared IS NULL AND n % 3 <> 0) UNION SELECT dc.n FROM bad JOIN ab ON ab.a = bad.n JOIN dc ON dc.n = ab.b WHERE declared IS NULL),
        rk AS (SELECT dc.*, n IN (SELECT b FROM ab WHERE a IN (SELECT n FROM bad)) AS risky FROM dc)
        SELECT {_N.format('n')} AS table_name, CASE WHEN declared IS NOT NULL THEN declared WHEN NOT risky AND n % 3 = 0 THEN 'equivalent' ELSE 'unknown' END AS mode,
               CASE WHEN declared IS NOT NULL THEN 'inherited_user' WHEN risky THEN 'upstream_propagation' WHEN n % 3 = 0 THEN 'automatic' ELSE 'default_unknown' END AS source, CASE WHEN declared IS NOT NULL THEN 'r1' END AS run_id, TRUE AS hashed FROM rk""",
    "canonical_rows": f"""WITH t AS (SELECT c_custkey, '{{"c_custkey":' || c_custkey || ',"c_name":' || CASE WHEN c_custkey % 3 > 0 THEN '"' || {_JSON} || '"' ELSE 'null' END || ',"flags":{{"A":false,"' || c_mktsegment || '":true}},"place":{{"a":[' || c_nationkey || ',null],"z":"' || n_name || '"}}}}' AS text
            FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT *, sha256(text) AS hash FROM t""",
    "row_compare_tolerance": """SELECT l_orderkey, l_returnflag, CASE WHEN count(*) > 1 THEN 'repeated' ELSE 'both' END AS side, CASE WHEN count(*) > 1 THEN '' ELSE 'price' END AS columns FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY 1, 2""",
}
