"""Entities and metrics of a layered warehouse: codes reconciled over key lineage, references of derived metrics resolved.

All are joins on names and column edges, with one row a key or a reference; names are the same whatever their case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cycles import components
from .graph import dealt, folded, settle, table_graph


def _keys(entities: DataFrame, *also: str) -> DataFrame:
    """A row for each different key column of each entity, with how many it has."""
    rows = folded(entities, "table_name").withColumn("keys", F.array_distinct(F.transform(F.coalesce("keys", F.array().cast("array<string>")), lambda k: F.lower(F.trim(k)))))
    return rows.select("table_name", *also, F.size("keys").alias("n_keys"), F.explode("keys").alias("key"))


def _columns(edges: DataFrame) -> DataFrame:
    return folded(edges, "src", "src_column", "dst", "dst_column").select("src", "src_column", "dst", "dst_column").distinct()


def dimension_codes(dimensions: DataFrame, edges: DataFrame, established: DataFrame) -> DataFrame:
    """table_name, code and new_code of each dimension whose primary entity's code must change.

    dimensions: table_name, code, keys (of the primary entity); edges: src, src_column, dst, dst_column; established: code.
    A dimension is the same entity as one above it if all its key columns come from key columns of that one. Dimensions that are so
    connected share one code: the only one of theirs that is established, or where none is, the only one among those that
    nothing in the group feeds. Where several compete, nothing changes.
    """
    dims = settle(folded(dimensions, "table_name").select("table_name", "code", "keys"))
    keys = settle(_keys(dims))
    met = _columns(edges).where("src <> dst").join(dealt(keys.select(F.col("table_name").alias("src"), F.col("key").alias("src_column"))), ["src", "src_column"]).join(
        dealt(keys.select(F.col("table_name").alias("dst"), F.col("key").alias("dst_column"), "n_keys")), ["dst", "dst_column"])
    full = met.groupBy("src", "dst", "n_keys").agg(F.count_distinct("dst_column").alias("n")).where("n = n_keys").select("src", "dst")
    full = settle(full)
    # both ways round, what is connected is a cycle
    of = settle(components(full.unionByName(full.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).withColumnRenamed("node", "table_name"))
    code = F.nullif(F.trim("code"), F.lit(""))
    rows = of.join(dealt(dims.select("table_name", code.alias("code"))), "table_name").withColumn("key", F.lower("code"))
    rows = rows.join(dealt(full.select(F.col("dst").alias("table_name"), F.lit(True).alias("fed")).distinct()), "table_name", "left")
    known = established.select(F.lower(F.trim("code")).alias("key"), F.trim("code").alias("as_known")).groupBy("key").agg(F.min("as_known").alias("as_known"))
    rows = settle(rows.join(known, "key", "left"))
    root = F.when(F.col("fed").isNull(), F.col("code"))
    groups = rows.groupBy("component").agg(F.count_distinct("as_known").alias("n_known"), F.min("as_known").alias("one_known"), F.count_distinct(root).alias("n_roots"), F.min(root).alias("one_root"))
    chosen = F.when(F.col("n_known") == 1, F.col("one_known")).when((F.col("n_known") == 0) & (F.col("n_roots") == 1), F.col("one_root"))
    out = rows.join(dealt(groups.select("component", chosen.alias("new_code")).where("new_code is not null")), "component")
    return out.where(~F.lower("code").eqNullSafe(F.lower("new_code"))).select("table_name", "code", "new_code")


def foreign_codes(entities: DataFrame, dimensions: DataFrame, edges: DataFrame) -> DataFrame:
    """table_name, nth, code and new_code of each foreign entity whose code must change; all changes of a table belong together.

    entities: table_name, nth, type (primary or foreign), code, keys, of tables that are no dimensions; dimensions: table_name, code, keys; edges: src,
    src_column, dst, dst_column. The codes that an entity can have are those of the dimensions whose keys feed each of its key
    columns, intersected over the columns. If that isn't one code, a direct upstream dimension with a key
    of that name decides, if each column has just one such code and they agree. A code that two entities
    of the table would get, or that one of them has already, is given to none.
    """
    ents = settle(folded(entities, "table_name").select("table_name", "nth", F.lower("type").alias("type"), F.trim("code").alias("code"), "keys"))
    of = settle(_keys(ents.where("type = 'foreign'"), "nth"))
    dims = settle(_keys(dimensions.withColumn("code", F.trim("code")), "code").where("code <> ''"))
    e = settle(_columns(edges))
    each = ["table_name", "nth", "n_keys"]

    fed = of.join(e.withColumnsRenamed({"dst": "table_name", "dst_column": "key"}), ["table_name", "key"]).join(dims.select(F.col("table_name").alias("src"), F.col("key").alias("src_column"), F.col("code").alias("found")), ["src", "src_column"])
    common = fed.groupBy(*each, "found").agg(F.count_distinct("key").alias("n")).where("n = n_keys")
    direct = common.groupBy("table_name", "nth").agg(F.count(F.lit(1)).alias("n"), F.min("found").alias("direct")).where("n = 1").drop("n")

    near = table_graph(e).withColumnsRenamed({"src": "dimension", "dst": "table_name"}).join(dims.select(F.col("table_name").alias("dimension"), "key", "code"), "dimension").select("table_name", "key", F.col("code").alias("found")).distinct()
    one = near.groupBy("table_name", "key").agg(F.count(F.lit(1)).alias("n"), F.min("found").alias("found")).where("n = 1").drop("n")
    named = of.join(one, ["table_name", "key"]).groupBy(*each).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("found").alias("codes"), F.min("found").alias("named")).where("n = n_keys and codes = 1").select("table_name", "nth", "named")

    found = ents.where("type = 'foreign'").join(direct, ["table_name", "nth"], "left").join(named, ["table_name", "nth"], "left").withColumn("new_code", F.coalesce("direct", "named"))
    found = settle(found.where(F.col("new_code").isNotNull() & ~F.lower("new_code").eqNullSafe(F.lower("code"))).select("table_name", "nth", "code", "new_code").withColumn("key", F.lower("new_code")))
    twice = found.groupBy("table_name", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    held = ents.where("code <> ''").select("table_name", F.lower("code").alias("key")).distinct()
    return found.join(twice.unionByName(held), ["table_name", "key"], "left_anti").select("table_name", "nth", "code", "new_code")


def _is(a: Column, b: Column) -> Column:
    """Do two table names mean one table: equal, or one is the other's last part."""
    last = lambda c: F.substring_index(c, ".", -1)
    return (a == b) | ((F.instr(a, ".") == 0) & (a == last(b))) | ((F.instr(b, ".") == 0) & (b == last(a)))


def metric_relation_problems(derived: DataFrame, atomic: DataFrame, upstream: DataFrame, groups: DataFrame, lineage: DataFrame) -> DataFrame:
    """table_name, problem and item of derived metrics that don't point at a known atomic metric.

    derived: table_name, name, base_metric, base_table of fact tables; atomic: table_name, metric_table, metric (what a table sees: its
    own and its upstreams' atomic metrics); upstream: table_name, metric_table (what feeds it); groups: table_name, metric_table (upstreams whose
    metrics are described); lineage: table_name, name, base_metric, metric_table (whose column of that name feeds the metric).

    A metric without a base is missing_base_metric. A named base table must be one of the known ones, else it is an
    invalid_base_metric_table; so is one without atomic metrics that doesn't feed this metric, while one that does is only an
    invalid_base_metric where its metrics are described. A base that its table doesn't have is an invalid_base_metric. Without a base table,
    a base that one table has is a missing_base_metric_table, one that several have is ambiguous_base_metric, and any other
    an invalid_base_metric.
    """
    low = lambda df, *names: folded(df, *names).select(*names).distinct()
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    rows = folded(derived, "table_name").select("table_name", text("name").alias("name"), text("base_metric").alias("base_metric"), text("base_table").alias("base_table")).where("name <> ''").distinct()
    rows = settle(rows.withColumns({"metric": F.lower("base_metric"), "asked": F.lower("base_table"), "key": F.lower("name")}))
    own, up, known = low(atomic, "table_name", "metric_table", "metric"), low(upstream, "table_name", "metric_table"), low(groups, "table_name", "metric_table")
    fed = low(lineage.withColumnsRenamed({"name": "key", "base_metric": "metric"}), "table_name", "key", "metric", "metric_table")
    row = lambda df, problem, item: df.select("table_name", F.lit(problem).alias("problem"), item.alias("item"))
    name, pair = F.col("name"), F.concat_ws(":", "name", "base_metric")
    out = [row(rows.where("metric = ''"), "missing_base_metric", name)]

    free = rows.where("metric <> '' and asked = ''").join(own, ["table_name", "metric"], "left").groupBy("table_name", "name", "base_metric").agg(F.count_distinct("metric_table").alias("n"))
    out += [row(free.where("n > 1"), "ambiguous_base_metric", pair), row(free.where("n = 0"), "invalid_base_metric", pair), row(free.where("n = 1"), "missing_base_metric_table", name)]

    tied = settle(rows.where("metric <> '' and asked <> ''"))
    places = own.select("table_name", "metric_table").unionByName(up).unionByName(known).distinct()
    near = tied.join(places, "table_name").where(_is(F.col("asked"), F.col("metric_table"))).select(*tied.columns, "metric_table")
    near = near.unionByName(tied.join(fed, ["table_name", "key", "metric"]).where(_is(F.col("asked"), F.col("metric_table"))).select(*tied.columns, "metric_table")).distinct()
    met = tied.join(near.groupBy(*tied.columns).agg(F.count(F.lit(1)).alias("n"), F.min("metric_table").alias("metric_table")), tied.columns, "left")
    flag = lambda df, on, to: met_on(df, on).withColumn(to, F.lit(True))
    met_on = lambda df, on: df.select(*on).distinct()
    at = ["table_name", "metric_table"]
    met = met.join(flag(own, at, "has"), at, "left").join(flag(own, [*at, "metric"], "there"), [*at, "metric"], "left").join(flag(up, at, "feeds"), at, "left").join(flag(known, at, "described"), at, "left").join(flag(fed, [*at, "key", "metric"], "traced"), [*at, "key", "metric"], "left")
    problem = F.when(F.coalesce("n", F.lit(0)) != 1, "invalid_base_metric_table").when(F.col("has").isNull() & (F.col("feeds").isNull() | F.col("traced").isNull()), "invalid_base_metric_table").when(
        F.col("has").isNull() & F.col("described").isNotNull(), "invalid_base_metric").when(F.col("has").isNotNull() & F.col("there").isNull(), "invalid_base_metric")
    met = met.withColumn("problem", problem).where("problem is not null")
    item = F.when(F.col("problem") == "invalid_base_metric", F.concat("name", F.lit(":"), "base_table", F.lit("."), "base_metric")).otherwise(F.concat_ws(":", "name", "base_table"))
    out.append(met.select("table_name", "problem", item.alias("item")))
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first.distinct()
