"""Warehouse assessment over metadata frames: scores, issue sets, schema changes and naming rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cycles import condensed
from .graph import CycleError, dealt, folded, levelled, levels, reachable, settle, table_graph

#: The weights of the dimensions.
WEIGHTS = {"reuse": 0.18, "depth": 0.18, "model_design": 0.18, "naming": 0.18, "asset_completeness": 0.09, "metadata_health": 0.09, "code_quality": 0.1}


def reuse_score(models: DataFrame, edges: DataFrame, full: int = 3) -> DataFrame:
    """Mean over middle-layer tables of min(100, downstream / full * 100), each to one digit; 0 without tables."""
    down = table_graph(edges).groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    each = folded(models, "name").where("layer in ('DWD', 'DWS', 'DIM')").join(down, "name", "left")
    score = F.round(F.least(F.lit(100.0), F.coalesce("n", F.lit(0)) * 100.0 / full), 1)
    return each.agg(F.round(F.coalesce(F.avg(score), F.lit(0.0)), 1).alias("score"))


def depth_scores(models: DataFrame, edges: DataFrame) -> DataFrame:
    """name, depth and score of each ADS table: the most DWD, DWS and DIM tables on a path that ends in it, itself aside.

    One pass over the levels of the graph: a table's depth is settled once those of its upstreams are. The tables of a cycle are
    one step of all its middle tables, each counted once.
    """
    e, known = settle(table_graph(edges)), settle(folded(models, "name").select(F.col("name").alias("node"), "layer"))
    nodes = settle(e.select(F.col("src").alias("node")).union(e.select("dst")).union(known.select("node")).distinct())
    own = nodes.join(dealt(known), "node", "left").withColumn("own", F.coalesce(F.col("layer").isin("DWD", "DWS", "DIM").cast("int"), F.lit(0)))
    try:
        own, at = own.withColumn("group", F.col("node")), levels(nodes, e)
    except CycleError:
        of, e = condensed(nodes, e)
        own, at = own.join(dealt(of), "node"), levels(of.select(F.col("group").alias("node")), e)
    own = settle(own)
    of = settle(own.groupBy(F.col("group").alias("node")).agg(F.sum("own").cast("int").alias("own")).join(dealt(at), "node").sortWithinPartitions("level"))
    most = of.agg(F.max("level")).first()[0]
    e = levelled(e, of, "dst")
    done = settle(of.where("level = 0").select("node", F.col("own").alias("depth")))
    for k in range(1, (most or 0) + 1):
        above = e.where(F.col("level") == k).join(dealt(done.select(F.col("node").alias("src"), "depth")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("depth").alias("above"))
        here = of.where(F.col("level") == k).join(dealt(above), "node").select("node", (F.col("own") + F.col("above")).alias("depth"))
        done = done.unionByName(settle(here))
    score = F.when(F.col("depth") == 2, 100).when(F.col("depth") == 1, 50).when(F.col("depth") == 0, 0).otherwise(30)
    return own.where("layer = 'ADS'").select(F.col("node").alias("name"), F.col("group").alias("node")).join(done, "node").select("name", "depth", score.alias("score"))


def depth_score(models: DataFrame, edges: DataFrame) -> DataFrame:
    """The mean of ``depth_scores`` to one digit; 100 without an ADS table."""
    return depth_scores(models, edges).agg(F.round(F.coalesce(F.avg("score"), F.lit(100.0)), 1).alias("score"))


def dimension_scores(checks: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, passed, total and score (per cent to one digit, 100 if nothing was checked). A check counts its segments,
    score_passed of score_total, where it has them, else itself."""
    spark = checks.sparkSession
    total = F.coalesce("score_total", F.lit(1))
    passed = F.coalesce("score_passed", F.col("passed").cast("int"), F.lit(0))
    n = checks.groupBy("dimension").agg(F.sum(passed).cast("long").alias("passed"), F.sum(total).cast("long").alias("total"))
    rows = spark.createDataFrame([(d,) for d in dimensions], "dimension string").join(n, "dimension", "left").na.fill(0, ["passed", "total"])
    return rows.withColumn("score", F.coalesce(F.round(F.col("passed") * 100.0 / F.nullif("total", F.lit(0)), 1), F.lit(100.0)).cast("double"))


def weights(overrides: DataFrame) -> DataFrame:
    """project, dimension and weight of every dimension: the fixed weights, those aside that the project overrides, to a sum of 1;
    overrides: project, dimension, weight (unknown dimensions are ignored; null: as fixed). A negative weight, or a project without any
    weight above 0, is an error."""
    spark = overrides.sparkSession
    fixed = spark.createDataFrame(list(WEIGHTS.items()), "dimension string, fixed double")
    own = overrides.groupBy("project", "dimension").agg(F.max("weight").cast("double").alias("own"))
    every = overrides.select("project").distinct().withColumn("fixed", F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.lit(v).alias("fixed")) for k, v in WEIGHTS.items()]))).select("project", "fixed.*")
    rows = every.join(own.join(F.broadcast(fixed.select("dimension")), "dimension", "left_semi"), ["project", "dimension"], "left").withColumn("weight", F.coalesce("own", "fixed"))
    total = F.sum("weight").over(Window.partitionBy("project"))  # a row for each dimension
    checked = F.when((F.min("weight").over(Window.partitionBy("project")) < 0) | (total <= 0), F.raise_error(F.lit("weights must be 0 or more, and not all 0")).cast("double")).otherwise(F.col("weight") / total)
    return rows.select("project", "dimension", F.round(checked, 6).alias("weight"))


def numbered_issues(checks: DataFrame) -> DataFrame:
    """dimension, issue_id (dimension-001, ...), rule and target of failed checks, numbered by rule and target."""
    nth = F.row_number().over(Window.partitionBy("dimension").orderBy("rule", "target"))
    name = F.concat(F.col("dimension"), F.lit("-"), F.lpad(nth.cast("string"), 3, "0"))
    return checks.where("not passed").select("dimension", F.when(nth > 999, F.concat_ws("-", "dimension", nth)).otherwise(name).alias("issue_id"), "rule", "target")


def dependency_classes(models: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst and kind of every edge between tables of known layers: reverse, same, next or skip, by layer rank; an
    application that reads a dimension skips nothing (next)."""
    of = folded(models, "name").select("name", "layer", _rank().alias("rank")).where("rank is not null")
    side = lambda c, layer, rank: of.select(F.col("name").alias(c), F.col("layer").alias(layer), F.col("rank").alias(rank))
    e = table_graph(edges).join(side("src", "from", "a"), "src").join(side("dst", "to", "b"), "dst")
    step = F.col("b") - F.col("a")
    fine = (step == 1) | ((F.col("from") == "DIM") & (F.col("to") == "ADS"))
    return e.select("src", "dst", F.when(fine, "next").when(step < 0, "reverse").when(step == 0, "same").otherwise("skip").alias("kind"))


def scoped_checks(checks: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """The checks whose target is a changed table (column node) or downstream of one."""
    scope = reachable(edges, changed).select(F.col("node").alias("__key"))
    return checks.join(scope, F.lower("target") == F.col("__key"), "left_semi")


def asset_catalog(ddl: DataFrame, models: DataFrame, tasks: DataFrame) -> DataFrame:
    """name, has_ddl, has_model, has_task and missing (sorted kinds) of every table (column name), whatever its case."""
    side = lambda df, flag: folded(df, "name").select("name", F.lit(True).alias(flag)).distinct()
    kinds = {"ddl": ddl, "model": models, "task": tasks}
    out = None
    for kind, df in kinds.items():
        one = side(df, f"has_{kind}")
        out = one if out is None else out.join(one, "name", "full")
    out = out.na.fill(False)
    lacks = F.filter(F.array(*[F.when(~F.col(f"has_{k}"), F.lit(k)) for k in kinds]), lambda x: x.isNotNull())
    return out.withColumn("missing", F.array_sort(lacks))


def validate_columns(declared: DataFrame, returned: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """table_name, name and problem of described columns against declared ones (both: table_name, name), whatever their
    case: unknown, duplicate, missing or unavailable (no column of the table is declared, so nothing can be said; no name).

    Only fact tables of the layers that group their metrics must describe every column: facts (table_name) are
    those; without it, all described tables are.
    """
    key = ["table_name", "key"]
    lower = lambda df: df.select(F.lower("table_name").alias("table_name"), F.lower("name").alias("key"))
    d = lower(declared).distinct().withColumn("declared", F.lit(True))
    r = lower(returned).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    there = (r if facts is None else facts.select(F.lower("table_name").alias("table_name"))).select("table_name").distinct().withColumn("whole", F.lit(True))
    known = d.select("table_name").distinct().withColumn("known", F.lit(True))
    both = d.join(r, key, "full").join(there, "table_name", "left").join(known, "table_name", "left")
    found = F.array(F.when(F.col("declared").isNull(), "unknown"), F.when(F.col("n") > 1, "duplicate"), F.when(F.col("n").isNull() & F.col("whole"), "missing"))
    rows = both.where("known").withColumn("problem", F.explode(F.filter(found, lambda x: x.isNotNull()))).select("table_name", F.col("key").alias("name"), "problem")
    none = both.where("known is null").select("table_name", F.lit(None).cast("string").alias("name"), F.lit("unavailable").alias("problem")).distinct()
    return rows.unionByName(none)


def resolve_layers(models: DataFrame) -> DataFrame:
    """name, layer and layer_source: a declared layer stands; else what was inferred, unless the name's prefix says
    another layer, which then wins; else OTHER. models: name, declared_layer, inferred_layer."""
    prefix = F.upper(F.regexp_extract(F.lower("name"), "^(ods|dwd|dim|dws|ads)_", 1))
    named = F.nullif(prefix, F.lit(""))
    layer = F.coalesce("declared_layer", named, "inferred_layer", F.lit("OTHER"))
    source = F.when(F.col("declared_layer").isNotNull(), "declared").when(named.isNotNull(), "name").when(F.col("inferred_layer").isNotNull(), "inferred").otherwise("none")
    return models.select("name", layer.alias("layer"), source.alias("layer_source"))


def promote_metrics(edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """table_name and column of the upstream columns that a consumer sums into one of its metrics, and that aren't metrics
    yet; edges: src, src_column, dst, dst_column, transformation; metrics: table_name, column."""
    e = folded(edges, "src", "src_column", "dst", "dst_column").where("upper(transformation) = 'SUM'")
    m = folded(metrics, "table_name", "column").distinct()
    used = e.join(m.withColumnsRenamed({"table_name": "dst", "column": "dst_column"}), ["dst", "dst_column"], "left_semi")
    return used.select(F.col("src").alias("table_name"), F.col("src_column").alias("column")).distinct().join(m, ["table_name", "column"], "left_anti")


def propagate_metrics(edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """table_name and column of all metrics once they have gone down every edge that passes or aggregates them, to the
    fixpoint; edges: src, src_column, dst, dst_column, transformation."""
    e = folded(edges, "src", "src_column", "dst", "dst_column").where("upper(transformation) in ('PASSTHROUGH', 'SUM', 'COUNT', 'AVG', 'MIN', 'MAX')")
    node = lambda t, c: F.concat_ws(".", t, c)
    steps = e.select(node("src", "src_column").alias("src"), node("dst", "dst_column").alias("dst"))
    seeds = folded(metrics, "table_name", "column").select(node("table_name", "column").alias("node"))
    found = reachable(steps, seeds).select("node")
    return found.select(F.substring_index("node", ".", 1).alias("table_name"), F.substring_index("node", ".", -1).alias("column"))


def base_metrics(edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """table_name, column, base (table.column) and status of each metric: unique if one upstream metric feeds it, else
    missing or ambiguous."""
    m = folded(metrics, "table_name", "column").distinct()
    e = folded(edges, "src", "src_column", "dst", "dst_column").join(m.withColumnsRenamed({"table_name": "src", "column": "src_column"}), ["src", "src_column"], "left_semi")
    up = e.groupBy(F.col("dst").alias("table_name"), F.col("dst_column").alias("column")).agg(F.collect_set(F.concat_ws(".", "src", "src_column")).alias("ups"))
    rows = m.join(up, ["table_name", "column"], "left")
    status = F.when(F.size("ups") == 1, "unique").when(F.size("ups") > 1, "ambiguous").otherwise("missing")
    return rows.select("table_name", "column", F.when(F.size("ups") == 1, F.col("ups")[0]).alias("base"), status.alias("status"))


def related_entities(grains: DataFrame, dimensions: DataFrame) -> DataFrame:
    """table_name and entity: the dimensions whose key a table's grain (array of columns) holds; dimensions: entity, key."""
    each = grains.select("table_name", F.explode("grain").alias("__column"))
    return each.join(dimensions.select("entity", F.lower("key").alias("__key")), F.lower("__column") == F.col("__key")).select("table_name", "entity").distinct()


def catalogue(models: DataFrame, code: str, name: str) -> DataFrame:
    """code, name and tables of each different code (a process or subject area): the first name by table, and how many tables."""
    first = F.min_by(name, F.struct(F.col(name).isNull(), "table_name"))
    return models.where(F.col(code).isNotNull()).groupBy(F.lower(code).alias("code")).agg(first.alias("name"), F.count(F.lit(1)).alias("tables"))


def table_contexts(models: DataFrame, edges: DataFrame, columns: DataFrame) -> DataFrame:
    """name, layer, upstream, downstream and columns (sorted arrays, empty without any) of each table."""
    e = table_graph(edges)
    gather = lambda df, by, what, to: df.groupBy(F.col(by).alias("name")).agg(F.array_sort(F.collect_set(what)).alias(to))
    out = folded(models, "name").select("name", "layer")
    for part in (gather(e, "dst", "src", "upstream"), gather(e, "src", "dst", "downstream"), gather(folded(columns, "table_name", "name"), "table_name", "name", "columns")):
        out = out.join(part, "name", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("upstream", "downstream", "columns")})


def _rank() -> Column:
    return F.when(F.col("layer") == "ODS", 0).when(F.col("layer").isin("DIM", "DWD"), 1).when(F.col("layer") == "DWS", 2).when(F.col("layer") == "ADS", 3)


def layer_violations(models: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges against the layer order (reverse) or over a layer (skip), by rank ODS 0, DIM and DWD 1, DWS 2, ADS 3."""
    return dependency_classes(models, edges).where("kind in ('reverse', 'skip')")


def pass_rates(checks: DataFrame) -> DataFrame:
    """Passed, total and percentage of each rule, and a score of 100 for what was never checked is the caller's."""
    n = checks.groupBy("rule").agg(F.sum(F.col("passed").cast("long")).alias("passed"), F.count(F.lit(1)).alias("total"))
    return n.withColumn("pct", F.round(F.col("passed") * 100.0 / F.col("total"), 1))


def capped_penalty(checks: DataFrame, tables: DataFrame, most: float = 3.0) -> DataFrame:
    """max(0, 100 * (1 - sum of min(weight per table, most) / number of tables)); severities weigh high 3, medium 2, low 1."""
    weight = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    each = checks.where("not passed").groupBy("target").agg(F.least(F.sum(weight).cast("double"), F.lit(most)).alias("w"))
    total = each.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).join(F.broadcast(tables.agg(F.count(F.lit(1)).alias("n"))))  # a row each
    return total.select(F.greatest(F.lit(0.0), 100.0 * (1 - F.coalesce(F.col("w") / F.nullif("n", F.lit(0)), F.lit(0.0)))).alias("score"))


def weighted_score(scores: DataFrame) -> DataFrame:
    """Weighted mean of dimension scores; null weights and scores are left out."""
    s = scores.where("score is not null and weight is not null")
    return s.agg(F.round(F.sum(F.col("weight") * F.col("score")) / F.nullif(F.sum("weight"), F.lit(0)), 2).alias("overall"))


def issue_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """fingerprint and state: fixed, remaining or new; repeated fingerprints count once."""
    a, b = before.select("fingerprint", F.lit(1).alias("a")).distinct(), after.select("fingerprint", F.lit(1).alias("b")).distinct()
    state = F.when(F.col("b").isNull(), "fixed").when(F.col("a").isNull(), "new").otherwise("remaining")
    return a.join(b, "fingerprint", "full").select("fingerprint", state.alias("state"))


FACTS = ["data_type", "nullable", "default_value", "comment"]


def column_changed(before: str = "o_", after: str = "n_") -> Column:
    """Did a column's type, nullability, default or comment change? A missing comment is an empty one; letters' case doesn't
    make another type."""
    same = F.lower(before + "data_type").eqNullSafe(F.lower(after + "data_type")) & F.coalesce(before + "nullable", F.lit(True)).eqNullSafe(F.coalesce(after + "nullable", F.lit(True)))
    same = same & F.col(before + "default_value").eqNullSafe(F.col(after + "default_value"))
    return ~(same & (F.coalesce(before + "comment", F.lit("")) == F.coalesce(after + "comment", F.lit(""))))


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """table_id, column_id and change (add, drop, rename, modify, rename_modify) of the columns of two versions, and both names;
    columns: table_id, column_id, name, data_type, nullable, default_value, comment.

    Columns with an id are the same if their ids are; one without is the one of the same name (whatever its case) that has none
    on the other side either. A table without an id is that without one.
    """
    # what a column goes by: its id, else its name
    own = F.when(F.col("column_id").isNotNull(), F.struct(F.lit("id").alias("by"), F.col("column_id").alias("of"))).otherwise(F.struct(F.lit("name").alias("by"), F.lower("name").alias("of")))
    table = F.struct(F.col("table_id").isNotNull().alias("known"), F.coalesce("table_id", F.lit("")).alias("of"))
    side = lambda df, p: df.select(table.alias("table"), own.alias("own"), F.col("table_id").alias(p + "table"), F.col("column_id").alias(p + "id"), *[F.col(c).alias(p + c) for c in ["name", *FACTS]], F.lit(True).alias(p + "is"))
    both = side(old, "o_").join(side(new, "n_"), ["table", "own"], "full")
    renamed, modified = ~F.lower("o_name").eqNullSafe(F.lower("n_name")), column_changed()
    change = F.when(F.col("o_is").isNull(), "add").when(F.col("n_is").isNull(), "drop").when(renamed & modified, "rename_modify").when(renamed, "rename").when(modified, "modify")
    return both.select(F.coalesce("o_table", "n_table").alias("table_id"), F.coalesce("o_id", "n_id").alias("column_id"), change.alias("change"), F.col("o_name").alias("old_name"), F.col("n_name").alias("new_name")).where("change is not null")


def naming_checks(models: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """name, layer and passed: does the lower-case name match its layer's pattern; layers without one pass."""
    ok = F.lit(True)
    for layer, pattern in patterns.items():
        ok = F.when(F.col("layer") == layer, F.lower("name").rlike(f"^(?:{pattern})$")).otherwise(ok)
    return models.select("name", "layer", ok.alias("passed"))
