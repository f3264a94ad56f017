"""Naming grammars, entity codes, metric references, candidate rules and cached task results, over models made from the parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ..operators import layers, rules, semantics
from ..operators.naming import Rule, Segment, Type, alignment, name_checks
from ..operators.shared import new_path
from ..sources.task_cache import TaskCache
from .sales import table

# The types of the segments of a table's name.
WORD = r"[A-Z][A-Z0-9]*"
AREA = Type("BUSINESS_AREA_CODE", patterns=("[A-Z0-9]+",))
DOMAIN = Type("DATA_DOMAIN_ID", patterns=("[0-9]{2}",))
PROCESS = Type("BIZ_PROCESS", patterns=(WORD,))
GRAIN = Type("GRAIN_ENTITY", patterns=(WORD,))
DESCRIPTION = Type("METRICS_DESC", patterns=(r"[A-Z][A-Z0-9_]*",), parts=True)
CONTENT = Type("DIM_DESC", patterns=(r"[A-Z][A-Z0-9_]*",), parts=True)
PERIOD = Type("TIME_PERIOD", allow=("D", "W", "M", "Q", "Y", "S"))
DWD_KIND = Type("DWD_GRANULARITY", allow=("I", "F", "A"))
DWS_KIND = Type("DWS_GRANULARITY", allow=("S", "F", "A"))
ROLE = Type("DIM_ROLE", allow=("BASE", "ADDT"))
ENTITY = Type("MODEL_ENTITY", patterns=(WORD,))
SHAPE = Type("DIM_CONTENT_TYPE", allow=("TAG", "INFO", "TREE"))
# The templates of each layer.
GRAMMAR = {
    "DWD": [Rule("TABLE_DWD", (Segment("M"), Segment(AREA), Segment(DOMAIN), Segment(PROCESS), Segment((PERIOD, DWD_KIND))), 30)],
    "DWS": [Rule("TABLE_DWS", (Segment("I"), Segment(AREA), Segment(GRAIN, 1, 2), Segment(DESCRIPTION), Segment((PERIOD, DWS_KIND))), 30)],
    "DIM": [Rule("TABLE_DIM", (Segment("DIM"), Segment(ROLE), Segment(ENTITY), Segment(CONTENT), Segment(SHAPE)), 30), Rule("TABLE_DIM_PM", (Segment("DIM"), Segment("PM"), Segment(CONTENT)), 14)],
}


def _text(c):
    return c.cast("string")


def _names(spark, d):
    """n, z, name and layer of each part: names of four kinds, some broken in one segment."""
    n, z, c = F.col("p_partkey"), _text(F.col("p_size")), F.concat
    pick = lambda i, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % len(v)).cast("int") + 1)
    dwd = c(F.lit("M_A"), z, F.lit("_"), F.when(n % 7 == 3, F.lit("xx")).otherwise(F.lpad(_text(n % 100), 2, "0")), F.lit("_P"), _text(n), F.lit("_"), F.when(n % 11 == 5, F.lit("ZZ")).otherwise(pick(n, "DI", "MF", "QA")))
    dws = c(F.lit("I_A"), z, F.lit("_E"), _text(n), F.when(n % 2 == 0, c(F.lit("_F"), z)).otherwise(F.lit("")), F.when(n % 7 == 3, F.lit("_sales")).otherwise(F.lit("_SALES")), F.lit("_AMT_MS"))
    dim = F.when(n % 4 < 2, c(F.lit("DIM_BASE_E"), _text(n), F.lit("_ALL_OF_"), pick(n, "TAG", "INFO"))).otherwise(c(F.lit("DIM_PM_CODE_"), _text(n)))
    layer = F.when(n % 50 == 49, "TMP").otherwise(pick(n, "DWD", "DWS", "DIM"))
    name = F.when(n % 3 == 0, dwd).when(n % 3 == 1, dws).otherwise(dim)
    return table(spark, d, "part").select(n.alias("n"), z.alias("z"), name.alias("name"), layer.alias("layer"))


def naming_grammar(spark, d):
    checks = name_checks(_names(spark, d), GRAMMAR)
    return checks.withColumn("segments", F.array_join(F.transform("segments", lambda s: F.concat_ws("=", s["type"], s["value"])), ";"))


def naming_alignment(spark, d):
    """What the names say of area and domain against what the models say."""
    names, n = _names(spark, d), F.col("n")
    domain = names.select("name", F.lit("DATA_DOMAIN_ID").alias("type"), F.array(F.lpad(_text((n + F.when(n % 5 == 0, 1).otherwise(0)) % 100), 2, "0")).alias("values"))
    area = names.where(n % 2 == 0).select("name", F.lit("BUSINESS_AREA_CODE").alias("type"), F.array(F.lit("OTHER"), F.concat(F.lit("A"), "z")).alias("values"))
    return alignment(name_checks(names, GRAMMAR), domain.unionByName(area)).withColumn("violations", F.array_join("violations", ","))


def dimension_entity_codes(spark, d):
    """Dimensions in chains of up to four, each fed by the one before; every third has a second key that isn't fed."""
    n = F.col("p_partkey")
    p = table(spark, d, "part").select(n.alias("n"))
    name = lambda i: F.concat(F.lit("dim_"), _text(i))
    code = F.when(F.col("n") % 5 == 0, "").otherwise(F.concat(F.lit("C"), _text(F.col("n") % 7)))
    dims = p.select(F.upper(name(F.col("n"))).alias("table_name"), code.alias("code"), F.when(F.col("n") % 3 == 0, F.array(F.lit("k1"), F.lit("K2"))).otherwise(F.array(F.lit("K1"))).alias("keys"))
    fed = p.where("n % 4 <> 0").select(name(F.col("n") - 1).alias("src"), F.explode(F.array(F.lit("k1"), F.lit("k2"), F.lit("other"))).alias("src_column"), name(F.col("n")).alias("dst")).withColumn("dst_column", F.upper("src_column"))
    return semantics.dimension_codes(dims, fed, spark.createDataFrame([("C1",), (" c2",)], "code string"))


def foreign_entity_codes(spark, d):
    """Facts with foreign entities whose keys come from the dimensions of the regions."""
    n = F.col("n")
    f = table(spark, d, "part").select(F.col("p_partkey").alias("n")).withColumn("r", n % 5).withColumn("q", F.when(n % 8 == 0, n % 5).otherwise((n + 2) % 5)).withColumn("q2", (F.col("q") + F.when(n % 4 == 3, 1).otherwise(0)) % 5).withColumn("table_name", F.concat(F.lit("f"), _text(n)))
    code = lambda c: F.concat(F.lit("R"), _text(F.col(c)))
    of = lambda nth, kind, code, keys: f.select("n", F.upper("table_name").alias("table_name"), F.lit(nth).alias("nth"), F.lit(kind).alias("type"), code.alias("code"), keys.alias("keys"))
    ents = of(0, "primary", F.when(n % 9 == 0, F.lower(code("r"))).otherwise(F.concat(F.lit("P"), _text(n))), F.array(F.lit("id")))
    ents = ents.unionByName(of(1, "Foreign", F.lit("X"), F.array(F.lit("a"))).where(n % 10 != 1)).unionByName(of(2, "foreign", F.lit("Y"), F.array(F.lit("b"), F.lit("C"))))
    ents = ents.unionByName(of(3, "foreign", F.lit("Z"), F.array(F.concat(F.lit("K"), _text(F.col("r"))))).where(n % 10 == 1)).drop("n")
    key = lambda c: F.concat(F.lit("k"), _text(F.col(c)))
    edge = lambda c, column, to: f.select("n", F.concat(F.lit("dim_"), _text(F.col(c))).alias("src"), column.alias("src_column"), F.col("table_name").alias("dst"), F.lit(to).alias("dst_column"))
    f = f.withColumn("r1", (F.col("r") + 1) % 5)
    edges = edge("r", key("r"), "a").unionByName(edge("r1", key("r1"), "a").where(n % 6 == 0)).unionByName(edge("q", F.lit("shared"), "b")).unionByName(edge("q2", key("q2"), "c")).drop("n")
    dims = table(spark, d, "region").select(F.concat(F.lit("DIM_"), _text(F.col("r_regionkey"))).alias("table_name"), F.concat(F.lit("R"), _text(F.col("r_regionkey"))).alias("code"), F.array(F.concat(F.lit("k"), _text(F.col("r_regionkey"))), F.lit("Shared")).alias("keys"))
    return semantics.foreign_codes(ents, dims, edges)


def metric_relations(spark, d):
    """Six derived metrics of each fact table that point at its own and its upstreams' metrics, rightly or not."""
    n, u = F.col("n"), F.concat(F.lit("db.u"), _text(F.col("n") % 10))
    t = table(spark, d, "part").select(F.col("p_partkey").alias("n")).withColumn("table_name", F.concat(F.lit("t"), _text(n)))
    w, g = (F.concat(F.lit(f"db.{x}"), _text(n % 10)) for x in "wg")
    one = lambda df, where, *cols: df.where(where).select(F.upper("table_name").alias("table_name"), *cols)
    met = lambda where, place, metric: one(t, where, place.alias("metric_table"), F.lit(metric).alias("metric"))
    atomic = met("true", F.col("table_name"), "amt").unionByName(met("n % 2 = 0", u, "cnt")).unionByName(met("n % 3 = 0", u, "amt"))
    up = one(t, "true", u.alias("metric_table")).unionByName(one(t, "true", w.alias("metric_table")))
    groups = one(t, "true", g.alias("metric_table")).unionByName(one(t, "n % 5 = 0", w.alias("metric_table")))
    lineage = one(t, "n % 4 = 0", F.lit("m4").alias("name"), F.lit("cnt").alias("base_metric"), w.alias("metric_table"))
    asked = [("m0", " ", None), ("m1", "AMT", None), ("m2", "cnt", None), ("m3", "cnt", F.substring_index(u, ".", -1)), ("m4", "cnt", w), ("m5", "cnt", F.lit("db.zz")), ("m6", "cnt", g)]
    derived = reduce(DataFrame.unionByName, [one(t, "true", F.lit(a).alias("name"), F.lit(b).alias("base_metric"), (F.lit(None).cast("string") if c is None else c).alias("base_table")) for a, b, c in asked])
    return semantics.metric_relation_problems(derived, atomic, up, groups, lineage)


def _candidates(spark, d):
    """A model for each part, with columns, entities, a grain and how it is run, of which some lack something."""
    n = F.col("p_partkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (n % len(v)).cast("int") + 1)
    column = lambda name, kind, comment: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), comment.cast("string").alias("comment"))
    entity = lambda code, kind, key: F.struct(code.cast("string").alias("code"), F.lit(kind).alias("type"), F.array(F.lit(key)).alias("keys"))
    some = lambda where, item: F.when(where, F.array(item)).otherwise(F.filter(F.array(item), lambda x: F.lit(False)))
    columns = F.concat(F.array(column("id", "bigint", F.lit("key")), column("stat_date", "date", F.lit("")), column("Amt", "double", F.when(n % 2 == 0, "x"))), some(n % 6 == 0, column("amt", "decimal(12,2)", F.lit("x"))))
    entities = F.concat(F.array(entity(F.lit("Part"), "primary", "ID")), some(n % 8 == 0, entity(F.lit("Other"), "primary", "id")), some(n % 9 == 0, entity(F.lit(None), "link", "nokey")))
    slices = F.when(n % 4 != 0, F.struct(F.lit("etl_date").alias("param"), F.when(n % 7 != 0, F.when(n % 13 == 0, "stat_dt").otherwise("STAT_DATE")).alias("column"), pick("D", "W", "M", "H", "X").alias("period")))
    grain = F.when(n % 10 != 0, F.struct(F.array(F.when(n % 11 == 0, "nobody").otherwise("part")).alias("entities"), F.when(n % 3 == 0, "stat_date").when(n % 3 == 1, "other_date").alias("time_column")))
    return table(spark, d, "part").select(
        F.concat(F.lit("t"), _text(n)).alias("name"), pick("ODS", "DWD", "DWS", "ADS", "DIM").alias("layer"), F.when(n % 31 == 0, "snapshot").when(n % 3 == 0, "full").when(n % 3 == 1, "incremental").alias("materialized"), slices.alias("slice"), columns.alias("columns"),
        entities.alias("entities"), grain.alias("grain"), F.when(n % 3 != 1, "pay").alias("process"), F.when(n % 17 != 0, F.lpad(_text(n % 100), F.when(n % 19 == 0, 1).otherwise(2), "0")).alias("domain"), F.when(n % 23 != 0, "about").otherwise(" ").alias("description"))


def candidate_rules() -> list[rules.Rule]:
    """Rules for a whole model: how it is run, its columns, entities, grain and catalogue entries."""
    c, low = F.col, F.lower
    declared = F.transform("columns", lambda x: low(x["name"]))
    codes = F.transform(F.filter("entities", lambda e: e["code"].isNotNull()), lambda e: low(e["code"]))
    lacks = lambda name: ~F.array_contains(declared, low(name))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    middle, incremental = c("layer").isin("DWD", "DWS", "DIM"), c("materialized") == "incremental"
    meta, asset, naming = "metadata_health", "asset_completeness", "naming"
    primary = F.size(F.filter("entities", lambda e: low(e["type"]) == "primary"))
    return [
        rules.Rule("execution_missing", meta, "high", rules.when(c("materialized").isNull(), "materialized")),
        rules.Rule("execution_unknown", meta, "high", rules.when(~c("materialized").isin("full", "incremental"), c("materialized"))),
        rules.Rule("slice_missing", meta, "high", rules.when(c("slice").isNull(), "slice"), incremental),
        rules.Rule("slice_needless", meta, "low", rules.when(c("slice").isNotNull(), "slice"), c("materialized") == "full"),
        rules.Rule("slice_period_unknown", meta, "high", rules.when(~c("slice.period").isin("H", "D", "W", "M"), c("slice.period"))),
        rules.Rule("slice_column_missing", meta, "medium", rules.when(c("slice").isNotNull() & c("slice.column").isNull(), "column")),
        rules.Rule("slice_column_undeclared", meta, "high", rules.when(lacks(c("slice.column")), c("slice.column"))),
        rules.Rule("column_without_comment", asset, "low", rules.those(c("columns"), lambda x: blank(x["comment"]), lambda x: x["name"])),
        rules.Rule("column_repeated", asset, "high", rules.repeated(F.transform("columns", lambda x: x["name"]))),
        rules.Rule("column_case", naming, "low", rules.those(c("columns"), lambda x: low(x["name"]) != x["name"], lambda x: x["name"])),
        rules.Rule("amount_not_exact", asset, "medium", rules.those(c("columns"), lambda x: low(x["name"]).contains("amt") & x["type"].isin("double", "float"), lambda x: x["name"])),
        rules.Rule("primary_entity_count", meta, "high", rules.when(primary != 1, primary), middle),
        rules.Rule("entity_without_code", meta, "medium", rules.those(c("entities"), lambda e: blank(e["code"]), lambda e: e["type"])),
        rules.Rule("entity_type_unknown", meta, "medium", rules.those(c("entities"), lambda e: ~low(e["type"]).isin("primary", "foreign"), lambda e: e["type"])),
        rules.Rule("entity_key_undeclared", meta, "high", F.array_distinct(F.filter(F.flatten(F.transform("entities", lambda e: e["keys"])), lacks))),
        rules.Rule("grain_missing", meta, "high", rules.when(c("grain").isNull(), "grain"), c("layer").isin("DWD", "DWS")),
        rules.Rule("grain_entity_unknown", meta, "high", rules.those(c("grain.entities"), lambda e: ~F.array_contains(codes, low(e)), lambda e: e)),
        rules.Rule("grain_time_undeclared", meta, "medium", rules.when(lacks(c("grain.time_column")), c("grain.time_column"))),
        rules.Rule("process_missing", meta, "medium", rules.when(c("process").isNull(), "process"), c("layer") == "DWD"),
        rules.Rule("domain_missing", meta, "medium", rules.when(c("domain").isNull(), "domain"), middle),
        rules.Rule("domain_form", naming, "low", rules.when(~c("domain").rlike("^[0-9]{2}$"), c("domain"))),
        rules.Rule("description_missing", asset, "low", rules.when(blank(c("description")), "description")),
    ]


def candidate_problems(spark, d):
    return rules.violations(_candidates(spark, d), "name", candidate_rules()).select("target", "rule", "severity", "item")


def candidate_status(spark, d):
    """One verdict of the whole candidate, and how often each rule holds."""
    checks = rules.checks(_candidates(spark, d), "name", candidate_rules())
    return checks.groupBy("dimension", "rule").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("passed").cast("long")).alias("passed"))


def cached_tasks(spark, d):
    """Two runs of a task for each customer: the second has another schema slice for some, and computes just those."""
    c = table(spark, d, "customer").select(F.col("c_name").alias("task"), F.concat(F.lit("select "), F.col("c_custkey").cast("string")).alias("sql"), F.col("c_mktsegment").alias("schema_slice"), F.lit(None).cast("string").alias("config"))
    cache = TaskCache(spark, new_path(spark, "cache"), "1", StructType().add("columns", StringType()).add("run", IntegerType()))
    compute = lambda run: lambda left: left.select("key", F.concat_ws("/", "sql", "schema_slice").alias("columns"), F.lit(run).alias("run"))
    cache.run(c, compute(1))
    later = c.withColumn("schema_slice", F.when(F.col("schema_slice").like("B%"), F.lower("schema_slice")).otherwise(F.col("schema_slice")))
    return cache.run(later, compute(2)).select("columns", "run", F.col("key").rlike("^sha256:").alias("hashed"))


def layer_candidates(spark, d):
    """The layers of a model for each part under two policies: a refresh of declared models, and new ones by direct rules."""
    n = F.col("p_partkey")
    pick = lambda i, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % len(v)).cast("int") + 1)
    candidate = F.struct(pick(n, "DWD", " dws ", "OTHER", "ADS", "Dim", "zzz", "").alias("layer"), pick(n, "fact", "DIMENSION", "other", "", "bridge", "x", None, "fact", "dimension").alias("table_type"), (F.col("p_size").cast("double") / 40).alias("confidence"))
    tables = table(spark, d, "part").select(
        _text(n).alias("name"), pick(n, "dwd", " DIM ", "ads", "x", None).alias("declared_layer"), pick(n, "fact", "Dimension", None).alias("declared_type"), pick(n, "DWS", None, "ODS", "bogus").alias("fallback_layer"),
        pick(n, "bridge", None).alias("fallback_type"), pick(n, "ods", "ADS ", "DWD", *[None] * 14).alias("fixed_layer"), F.when(n % 6 != 5, candidate).alias("candidate"))
    both = [layers.resolve(tables).withColumn("policy", F.lit("refresh")), layers.resolve(tables, "direct_rule", False, ("DWD", "DWS"), 0.8).withColumn("policy", F.lit("generate"))]
    return both[0].unionByName(both[1]).withColumn("warnings", F.array_join("warnings", ","))


QUERIES = {f.__name__: f for f in (layer_candidates, naming_grammar, naming_alignment, dimension_entity_codes, foreign_entity_codes, metric_relations, candidate_problems, candidate_status, cached_tasks)}

_NAMES = """nm AS (SELECT p_partkey AS n, p_size::VARCHAR AS z, CASE WHEN p_partkey % 50 = 49 THEN 'TMP' ELSE ['DWD', 'DWS', 'DIM'][p_partkey % 3 + 1] END AS layer, p_partkey % 3 AS kind, lpad((p_partkey % 100)::VARCHAR, 2, '0') AS dom,
        ['DI', 'MF', 'QA'][p_partkey % 3 + 1] AS dk, ['TAG', 'INFO'][p_partkey % 2 + 1] AS sh FROM part),
    na AS (SELECT *, CASE kind WHEN 0 THEN 'M_A' || z || '_' || CASE WHEN n % 7 = 3 THEN 'xx' ELSE dom END || '_P' || n || '_' || CASE WHEN n % 11 = 5 THEN 'ZZ' ELSE dk END
        WHEN 1 THEN 'I_A' || z || '_E' || n || CASE WHEN n % 2 = 0 THEN '_F' || z ELSE '' END || CASE WHEN n % 7 = 3 THEN '_sales' ELSE '_SALES' END || '_AMT_MS'
        ELSE CASE WHEN n % 4 < 2 THEN 'DIM_BASE_E' || n || '_ALL_OF_' || sh ELSE 'DIM_PM_CODE_' || n END END AS name, layer <> 'TMP' AND (kind = 2 OR (n % 7 <> 3 AND (kind = 1 OR n % 11 <> 5))) AS fits FROM nm)"""
#: rule, where it is broken, and the item; of a column list several rows
_BROKEN = [
    ("execution_missing", "n % 3 = 2 AND n % 31 <> 0", "'materialized'"), ("execution_unknown", "n % 31 = 0", "'snapshot'"), ("slice_missing", "n % 3 = 1 AND n % 31 <> 0 AND n % 4 = 0", "'slice'"), ("slice_needless", "n % 3 = 0 AND n % 31 <> 0 AND n % 4 <> 0", "'slice'"),
    ("slice_period_unknown", "n % 4 <> 0 AND n % 5 = 4", "'X'"), ("slice_column_missing", "n % 4 <> 0 AND n % 7 = 0", "'column'"), ("slice_column_undeclared", "n % 4 <> 0 AND n % 7 <> 0 AND n % 13 = 0", "'stat_dt'"), ("column_without_comment", "TRUE", "'stat_date'"), ("column_without_comment", "n % 2 = 1", "'Amt'"),
    ("column_repeated", "n % 6 = 0", "'amt'"), ("column_case", "TRUE", "'Amt'"), ("amount_not_exact", "TRUE", "'Amt'"), ("primary_entity_count", "n % 8 = 0 AND n % 5 IN (1, 2, 4)", "'2'"), ("entity_without_code", "n % 9 = 0", "'link'"), ("entity_type_unknown", "n % 9 = 0", "'link'"), ("entity_key_undeclared", "n % 9 = 0", "'nokey'"),
    ("grain_missing", "n % 10 = 0 AND n % 5 IN (1, 2)", "'grain'"), ("grain_entity_unknown", "n % 10 <> 0 AND n % 11 = 0", "'nobody'"), ("grain_time_undeclared", "n % 10 <> 0 AND n % 3 = 1", "'other_date'"), ("process_missing", "n % 5 = 1 AND n % 3 = 1", "'process'"), ("domain_missing", "n % 17 = 0 AND n % 5 IN (1, 2, 4)", "'domain'"),
    ("domain_form", "n % 17 <> 0 AND n % 19 = 0", "(n % 100)::VARCHAR[1]"), ("description_missing", "n % 23 = 0", "'description'"),
]
_BROKEN = [(r, w, i.replace("(n % 100)::VARCHAR[1]", "((n % 100)::VARCHAR)[1]")) for r, w, i in _BROKEN]
#: severity, dimension and of which rows each rule is asked
_ASKED = {
    "execution_missing": ("high", "metadata_health", "TRUE"), "execution_unknown": ("high", "metadata_health", "TRUE"), "slice_missing": ("high", "metadata_health", "n % 3 = 1 AND n % 31 <> 0"), "slice_needless": ("low", "metadata_health", "n % 3 = 0 AND n % 31 <> 0"), "slice_period_unknown": ("high", "metadata_health", "TRUE"),
    "slice_column_missing": ("medium", "metadata_health", "TRUE"), "slice_column_undeclared": ("high", "metadata_health", "TRUE"), "column_without_comment": ("low", "asset_completeness", "TRUE"), "column_repeated": ("high", "asset_completeness", "TRUE"), "column_case": ("low", "naming", "TRUE"), "amount_not_exact": ("medium", "asset_completeness", "TRUE"),
    "primary_entity_count": ("high", "metadata_health", "n % 5 IN (1, 2, 4)"), "entity_without_code": ("medium", "metadata_health", "TRUE"), "entity_type_unknown": ("medium", "metadata_health", "TRUE"), "entity_key_undeclared": ("high", "metadata_health", "TRUE"), "grain_missing": ("high", "metadata_health", "n % 5 IN (1, 2)"),
    "grain_entity_unknown": ("high", "metadata_health", "TRUE"), "grain_time_undeclared": ("medium", "metadata_health", "TRUE"), "process_missing": ("medium", "metadata_health", "n % 5 = 1"), "domain_missing": ("medium", "metadata_health", "n % 5 IN (1, 2, 4)"), "domain_form": ("low", "naming", "TRUE"), "description_missing": ("low", "asset_completeness", "TRUE"),
}
_ROWS = "p AS (SELECT p_partkey AS n FROM part)"
_PROBLEMS = " UNION ALL ".join(f"SELECT n, '{r}' AS rule, '{_ASKED[r][0]}' AS severity, {i} AS item FROM p WHERE {w}" for r, w, i in _BROKEN)
ORACLE_SQL = {
    "layer_candidates": """WITH r AS (SELECT p_partkey AS n, p_partkey % 6 <> 5 AS c, p_size / 40.0::DOUBLE AS conf, ['DWD', 'DIM', 'ADS', NULL, NULL][p_partkey % 5 + 1] AS dl, ['fact', 'dimension', NULL][p_partkey % 3 + 1] AS dt, ['DWS', NULL, 'ODS', NULL][p_partkey % 4 + 1] AS fl,
            ['bridge', NULL][p_partkey % 2 + 1] AS ft, CASE p_partkey % 17 WHEN 0 THEN 'ODS' WHEN 1 THEN 'ADS' END AS fx, ['DWD', 'DWS', 'OTHER', 'ADS', 'DIM', NULL, NULL][p_partkey % 7 + 1] AS cl, ['fact', 'dimension', 'other', NULL, 'bridge', NULL, NULL, 'fact', 'dimension'][p_partkey % 9 + 1] AS ct FROM part),
        x AS (SELECT n, c, 'refresh' AS policy, CASE WHEN c AND conf <= 1 THEN conf END AS conf, coalesce(dl, fl, 'OTHER') AS pl, coalesce(dt, ft, 'other') AS pt, fx, CASE WHEN c THEN cl END AS cl, CASE WHEN c THEN ct END AS ct, ['DWD', 'DWS', 'DIM'] AS ok, 0.5 AS least FROM r
            UNION ALL SELECT n, c, 'generate', CASE WHEN c AND conf <= 1 THEN conf END, coalesce(fl, dl, 'OTHER'), coalesce(ft, dt, 'other'), fx, CASE WHEN c THEN cl END, CASE WHEN c THEN ct END, ['DWD', 'DWS'], 0.8 FROM r),
        y AS (SELECT *, fx IS NULL AND coalesce(list_contains(ok, cl) AND conf >= least, FALSE) AS used FROM x),
        z AS (SELECT *, CASE WHEN fx IS NOT NULL THEN fx WHEN NOT used THEN pl WHEN ct = 'dimension' THEN 'DIM' ELSE cl END AS al FROM y)
        SELECT n::VARCHAR AS name, policy, CASE WHEN fx IS NOT NULL THEN coalesce(cl, fx) WHEN c THEN coalesce(cl, 'OTHER') ELSE pl END AS inferred_layer, al AS applied_layer, CASE WHEN used THEN coalesce(ct, pt) ELSE pt END AS table_type,
            CASE WHEN fx IS NOT NULL THEN 'fixed_boundary' WHEN used THEN 'candidate' WHEN policy = 'refresh' THEN 'declared' ELSE 'direct_rule' END AS source, CASE WHEN fx IS NOT NULL THEN 'fixed' WHEN policy = 'refresh' THEN 'strong' ELSE 'weak' END AS strength, conf AS confidence,
            concat_ws(',', CASE WHEN c AND fx IS NULL AND NOT used THEN 'candidate_unusable' END, CASE WHEN fx IS NULL AND al <> 'OTHER' AND NOT list_contains(ok, al) THEN 'outside_candidates' END) AS warnings FROM z""",
    "naming_grammar": f"""WITH {_NAMES} SELECT name, layer, CASE WHEN fits THEN ['TABLE_DWD', 'TABLE_DWS', CASE WHEN n % 4 < 2 THEN 'TABLE_DIM' ELSE 'TABLE_DIM_PM' END][kind + 1] END AS rule,
            CASE WHEN fits THEN CASE kind WHEN 0 THEN 'BUSINESS_AREA_CODE=A' || z || ';DATA_DOMAIN_ID=' || dom || ';BIZ_PROCESS=P' || n || ';TIME_PERIOD=' || dk[1] || ';DWD_GRANULARITY=' || dk[2]
                WHEN 1 THEN 'BUSINESS_AREA_CODE=A' || z || ';GRAIN_ENTITY=E' || n || ';METRICS_DESC=' || CASE WHEN n % 2 = 0 THEN 'F' || z || '_' ELSE '' END || 'SALES_AMT;TIME_PERIOD=M;DWS_GRANULARITY=S'
                ELSE CASE WHEN n % 4 < 2 THEN 'DIM_ROLE=BASE;MODEL_ENTITY=E' || n || ';DIM_DESC=ALL_OF;DIM_CONTENT_TYPE=' || sh ELSE 'DIM_DESC=CODE_' || n END END END AS segments,
            fits OR layer = 'TMP' AS passed, NOT fits OR length(name) <= CASE WHEN kind = 2 AND n % 4 >= 2 THEN 14 ELSE 30 END AS length_ok FROM na""",
    "naming_alignment": f"""WITH {_NAMES}, x AS (SELECT name, n % 5 <> 0 AS ok, 'DATA_DOMAIN_ID=' || dom AS what FROM na WHERE fits AND kind = 0 UNION ALL SELECT name, TRUE, '' FROM na WHERE fits AND kind < 2 AND n % 2 = 0)
        SELECT name, count(*) FILTER (ok) AS score_passed, count(*) AS score_total, coalesce(string_agg(what, ',') FILTER (NOT ok), '') AS violations FROM x GROUP BY 1""",
    "dimension_entity_codes": """WITH p AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 5 <> 0 THEN 'C' || (p_partkey % 7) END AS code, p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AND p_partkey > (SELECT min(p_partkey) FROM part) AS fed FROM part),
        g AS (SELECT *, sum((NOT fed)::INT) OVER (ORDER BY n) AS g FROM p), k AS (SELECT *, CASE code WHEN 'C1' THEN 'C1' WHEN 'C2' THEN 'c2' END AS known FROM g),
        c AS (SELECT g, count(DISTINCT known) AS n_known, min(known) AS one, min(code) FILTER (NOT fed) AS root FROM k GROUP BY 1 HAVING count(*) > 1),
        z AS (SELECT n, code, CASE WHEN n_known = 1 THEN one WHEN n_known = 0 THEN root END AS new_code FROM k JOIN c USING (g))
        SELECT 'dim_' || n AS table_name, code, new_code FROM z WHERE new_code IS NOT NULL AND lower(code) IS DISTINCT FROM lower(new_code)""",
    # by hand: the second entity's keys agree unless n % 4 = 3, the first one's code is ambiguous where n % 6 = 0
    "foreign_entity_codes": """WITH p AS (SELECT p_partkey AS n, p_partkey % 5 AS r, CASE WHEN p_partkey % 8 = 0 THEN p_partkey % 5 ELSE (p_partkey + 2) % 5 END AS q FROM part),
        x AS (SELECT n, 1 AS nth, 'X' AS code, r AS c FROM p WHERE n % 10 <> 1 AND n % 6 <> 0 UNION ALL SELECT n, 2, 'Y', q FROM p WHERE n % 4 <> 3 UNION ALL SELECT n, 3, 'Z', r FROM p WHERE n % 10 = 1),
        y AS (SELECT *, count(*) OVER (PARTITION BY n, c) AS k FROM x)
        SELECT 'f' || n AS table_name, nth, code, 'R' || c AS new_code FROM y WHERE k = 1 AND NOT (n % 9 = 0 AND c = n % 5)""",
    "metric_relations": """WITH p AS (SELECT p_partkey AS n, 't' || p_partkey AS table_name, p_partkey % 10 AS k FROM part)
        SELECT table_name, 'missing_base_metric' AS problem, 'm0' AS item FROM p UNION ALL SELECT table_name, CASE WHEN n % 3 = 0 THEN 'ambiguous_base_metric' ELSE 'missing_base_metric_table' END, CASE WHEN n % 3 = 0 THEN 'm1:AMT' ELSE 'm1' END FROM p
        UNION ALL SELECT table_name, CASE WHEN n % 2 = 0 THEN 'missing_base_metric_table' ELSE 'invalid_base_metric' END, CASE WHEN n % 2 = 0 THEN 'm2' ELSE 'm2:cnt' END FROM p
        UNION ALL SELECT table_name, CASE WHEN n % 3 = 0 THEN 'invalid_base_metric' ELSE 'invalid_base_metric_table' END, 'm3:u' || k || CASE WHEN n % 3 = 0 THEN '.cnt' ELSE '' END FROM p WHERE n % 2 = 1
        UNION ALL SELECT table_name, CASE WHEN n % 4 = 0 THEN 'invalid_base_metric' ELSE 'invalid_base_metric_table' END, 'm4:db.w' || k || CASE WHEN n % 4 = 0 THEN '.cnt' ELSE '' END FROM p WHERE n % 4 <> 0 OR n % 5 = 0
        UNION ALL SELECT table_name, 'invalid_base_metric_table', 'm5:db.zz' FROM p UNION ALL SELECT table_name, 'invalid_base_metric_table', 'm6:db.g' || k FROM p""",
    "candidate_problems": f"WITH {_ROWS} SELECT 't' || n AS target, rule, severity, item FROM ({_PROBLEMS})",
    "candidate_status": f"""WITH {_ROWS}, bad AS (SELECT DISTINCT n, rule FROM ({_PROBLEMS})), ask AS ({' UNION ALL '.join(f"SELECT n, '{r}' AS rule, '{dim}' AS dimension FROM p WHERE {w}" for r, (_, dim, w) in _ASKED.items())})
        SELECT dimension, ask.rule, count(*) AS total, count(*) FILTER (bad.n IS NULL) AS passed FROM ask LEFT JOIN bad ON bad.n = ask.n AND bad.rule = ask.rule GROUP BY 1, 2""",
    "cached_tasks": """SELECT 'select ' || c_custkey || '/' || CASE WHEN c_mktsegment LIKE 'B%' THEN lower(c_mktsegment) ELSE c_mktsegment END AS columns, CASE WHEN c_mktsegment LIKE 'B%' THEN 2 ELSE 1 END AS run, TRUE AS hashed FROM customer""",
}
