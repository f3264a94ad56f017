"""Refactor verification over frames: semantic modes along lineage, boundaries, changed assets and issue sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .assess import issue_diff
from .canonical import fingerprint
from .graph import dealt, folded, levels, reachable, settle, table_graph


def changed_assets(paths: DataFrame) -> DataFrame:
    """path, kind (ddl, task, model, config or other) and asset of each changed file."""
    p = F.lower("path")
    kind = F.when(p.rlike(r"(^|/)ddl/[^/]+\.sql$"), "ddl").when(p.rlike(r"(^|/)tasks/[^/]+\.sql$"), "task").when(p.rlike(r"(^|/)models/[^/]+\.ya?ml$"), "model").when(p.rlike(r"\.ya?ml$"), "config").otherwise("other")
    return paths.select("path", kind.alias("kind"), F.regexp_extract(p, r"([^/]+?)(\.[a-z]+)?$", 1).alias("asset"))


def downstream_impact(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """node and hops of all that changed tables (column node) feed, themselves with 0."""
    return reachable(edges, changed)


#: What a table's context says of each upstream.
_UPSTREAM = StructType([StructField(c, StringType()) for c in ("upstream_table_id", "upstream_semantic_context_fingerprint", "upstream_resolved_mode")])
UPSTREAM = _UPSTREAM.simpleString()
_CONTEXT = StructType([StructField("affected_upstreams", ArrayType(_UPSTREAM)), StructField("fingerprint_version", IntegerType()), StructField("local_change_fingerprint", StringType())])


def context_fingerprint(local, upstream):
    """The hash of the canonical JSON of a local fingerprint and the sorted UPSTREAM structs of its upstreams."""
    return fingerprint(F.struct(F.array_sort(upstream).alias("affected_upstreams"), F.lit(1).alias("fingerprint_version"), local.alias("local_change_fingerprint")), _CONTEXT)


def newest_declarations(history: DataFrame) -> DataFrame:
    """table_id, context and the mode and run_id of the newest run (by at, then run_id) that declared a valid mode for them; history: table_id,
    context, mode, run_id, at."""
    rows = history.where("table_id is not null and context is not null and mode in ('equivalent', 'changed', 'unknown')")
    last = rows.groupBy("table_id", "context").agg(F.max_by(F.struct("mode", "run_id"), F.struct("at", "run_id")).alias("last"))
    return last.select("table_id", "context", F.col("last.mode").alias("past_mode"), F.col("last.run_id").alias("past_run"))


def resolve_modes(facts: DataFrame, edges: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """table_name, mode, source, fingerprint and run_id (of a declaration from history) of each table; facts: table_name, local_fingerprint, automatic_mode,
    declared_mode, declared_context (the fingerprint that a declaration was made for; null: made now), and table_id where
    it isn't the name; history: as of ``newest_declarations``.

    By levels of the graph: a declaration holds if it is new (user) or its context is still the same (inherited_user); a table
    without one takes the newest of an earlier run over that was made for the same table and context (inherited_user); else a
    table below a changed or unknown one is unknown (upstream_propagation), else it is what was shown
    automatically if that is equivalent (automatic), else unknown (default_unknown).
    """
    if "table_id" not in facts.columns:
        facts = facts.withColumn("table_id", F.lower(F.trim("table_name")))
    facts = settle(folded(facts, "table_name"))
    spark = facts.sparkSession
    known = facts.select(F.col("table_name").alias("node"))
    e = table_graph(edges).join(dealt(known.withColumnRenamed("node", "src")), "src", "left_semi").join(dealt(known.withColumnRenamed("node", "dst")), "dst", "left_semi")
    e = settle(e)
    of_level = settle(levels(known, e))
    # facts, declarations and edges are written with their levels: each level reads its own rows alone
    ends = [dealt(of_level.select(F.col("node").alias(c), F.col("level").alias(f"{c}_level"))) for c in ("src", "dst")]
    e = settle(e.join(ends[0], "src").join(ends[1], "dst").sortWithinPartitions("src_level"))
    facts = settle(facts.join(dealt(of_level.withColumnRenamed("node", "table_name")), "table_name").sortWithinPartitions("level"))
    past = spark.createDataFrame([], "table_id string, context string, past_mode string, past_run string, level int")
    if history is not None:
        past = settle(newest_declarations(history).join(dealt(facts.select("table_id", "level").distinct()), "table_id").sortWithinPartitions("level"))
    none = F.array().cast(f"array<{UPSTREAM}>")
    sent = e.select("dst", "dst_level").withColumn("up", F.lit(None).cast(UPSTREAM)).where("false")
    done = None
    for k in range((of_level.agg(F.max("level")).first()[0] or 0) + 1):
        here = facts.where(F.col("level") == k).drop("level")
        ups = sent.where(F.col("dst_level") == k).groupBy(F.col("dst").alias("table_name")).agg(F.collect_list("up").alias("ups"))
        rows = here.join(dealt(ups), "table_name", "left").withColumn("ups", F.coalesce("ups", none))
        rows = rows.withColumn("fingerprint", context_fingerprint(F.col("local_fingerprint"), F.col("ups")))
        rows = rows.join(dealt(past.where(F.col("level") == k).drop("level").withColumnRenamed("context", "fingerprint")), ["table_id", "fingerprint"], "left")
        declared = F.col("declared_mode").isNotNull()
        fresh = declared & F.col("declared_context").isNull()
        kept = declared & (F.col("declared_context") == F.col("fingerprint"))
        found = ~declared & F.col("past_mode").isNotNull()
        risky = F.exists("ups", lambda u: u["upstream_resolved_mode"].isin("changed", "unknown"))
        same = F.coalesce(F.col("automatic_mode") == "equivalent", F.lit(False))
        source = F.when(fresh, "user").when(kept | found, "inherited_user").when(risky, "upstream_propagation").when(same, "automatic").otherwise("default_unknown")
        mode = F.when(fresh | kept, F.col("declared_mode")).when(found, F.col("past_mode")).when(risky, "unknown").when(same, "equivalent").otherwise("unknown")
        now = settle(rows.select("table_name", "table_id", mode.alias("mode"), source.alias("source"), "fingerprint", F.when(found, F.col("past_run")).alias("run_id")))
        done = now if done is None else done.unionByName(now)
        # what a table is goes along its edges once, to the levels below
        one = F.struct(F.col("table_id").alias("upstream_table_id"), F.col("fingerprint").alias("upstream_semantic_context_fingerprint"), F.col("mode").alias("upstream_resolved_mode"))
        down = e.where(F.col("src_level") == k).join(dealt(now.select(F.col("table_name").alias("src"), one.alias("up"))), "src")
        sent = sent.unionByName(settle(down.select("dst", "dst_level", "up").sortWithinPartitions("dst_level")))
    return done.drop("table_id")


def boundaries(resolved: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """table_name and boundary (authority, observational or passed) of the tables on the way down from the direct changes
    and user declarations; facts: table_name, is_direct, comparable.

    The walk stops at an equivalent table, which is an authority; a table without a downstream that is unknown and
    comparable is only observed.
    """
    facts = folded(facts, "table_name")
    rows = settle(folded(resolved, "table_name").join(facts.select("table_name", "is_direct", "comparable"), "table_name"))
    e = settle(table_graph(edges).join(rows.select(F.col("table_name").alias("dst")), "dst", "left_semi"))
    parents = e.select(F.col("src").alias("table_name")).distinct().withColumn("parent", F.lit(True))
    rows = rows.join(parents, "table_name", "left")
    leaf = F.col("parent").isNull() & (F.col("mode") == "unknown") & F.coalesce("comparable", F.lit(True))
    rows = settle(rows.withColumn("boundary", F.when(F.col("mode") == "equivalent", "authority").when(leaf, "observational").otherwise("passed")))
    front = settle(rows.where("is_direct or source in ('user', 'inherited_user')").select("table_name", "boundary"))
    seen = [front]
    while not front.isEmpty():
        go = front.where("boundary = 'passed'").select(F.col("table_name").alias("src")).join(e, "src").select(F.col("dst").alias("table_name")).distinct()
        front = settle(reduce(lambda left, s: left.join(s.select("table_name"), "table_name", "left_anti"), seen, rows.select("table_name", "boundary").join(go, "table_name")))
        seen.append(front)
    return reduce(DataFrame.unionByName, seen)


def renamed_issue_diff(before: DataFrame, after: DataFrame, renames: DataFrame) -> DataFrame:
    """``issue_diff`` of issues (target, rule) once the old targets have their new names; renames: old_name, new_name."""
    r = renames.select(F.lower("old_name").alias("key"), F.lower("new_name").alias("now"))
    old = before.withColumn("key", F.lower("target")).join(r, "key", "left").select(F.concat_ws("|", F.coalesce("now", "key"), "rule").alias("fingerprint"))
    return issue_diff(old, after.select(F.concat_ws("|", F.lower("target"), "rule").alias("fingerprint")))
