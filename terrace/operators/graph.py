"""Lineage graphs as edge DataFrames: closure, paths, levels, producers, schedules, collapse of temporary tables.

Names of tables, columns and jobs are the same whatever their case; results have them in lower case. Frontiers grow by
one join a step and are written to the shared folder between steps, so plans stay short and lost executors cost one
step. No walk has a depth of its own: it ends when nothing new is reached, or where the caller says.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def settle(df: DataFrame) -> DataFrame:
    return materialise(df, "graph")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join in a walk: both sides are shuffled, however small. Each of many steps would else send its
    rows to the driver for a broadcast."""
    return df.hint("merge")


def levelled(edges: DataFrame, of_level: DataFrame, end: str) -> DataFrame:
    """``edges`` with the ``level`` of their table at ``end`` (src or dst), written so that a level is read without the others."""
    return settle(edges.join(dealt(of_level.select(F.col("node").alias(end), "level")), end).sortWithinPartitions("level"))


def folded(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with its ``names`` columns trimmed and in lower case."""
    return df.withColumns({c: F.lower(F.trim(c)) for c in names})


def resolve(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, resolved and status of each of ``names`` (column name) among ``known`` (column name): exact, else the only one
    of another case (folded), else ambiguous or unknown."""
    k = known.select(F.col("name").alias("found")).distinct().groupBy(F.lower("found").alias("key")).agg(F.collect_set("found").alias("all"))
    met = names.select("name").distinct().withColumn("key", F.lower("name")).join(k, "key", "left")
    exact = F.array_contains("all", F.col("name"))
    status = F.when(exact, "exact").when(F.size("all") == 1, "folded").when(F.size("all") > 1, "ambiguous").otherwise("unknown")
    return met.select("name", F.when(exact, F.col("name")).when(F.size("all") == 1, F.col("all")[0]).alias("resolved"), status.alias("status"))


def table_graph(edges: DataFrame) -> DataFrame:
    """Distinct pairs (src, dst) of different tables."""
    return folded(edges, "src", "dst").where("src <> dst").select("src", "dst").distinct()


def self_edges(edges: DataFrame) -> DataFrame:
    """job and table of each job that reads what it writes."""
    return folded(edges, "job", "src", "dst").where("src = dst").select("job", F.col("src").alias("table_name")).distinct()


def edge_evidence(edges: DataFrame) -> DataFrame:
    """src, dst, the sorted jobs behind each edge and how many."""
    e = folded(edges, "job", "src", "dst").where("src <> dst").groupBy("src", "dst").agg(F.array_sort(F.collect_set("job")).alias("jobs"))
    return e.withColumn("n_jobs", F.size("jobs").cast("long"))


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None, direction: str = "downstream") -> DataFrame:
    """node and hops: what the seeds' (column node) edges lead to, by the fewest steps, of at most ``depth`` steps where
    it is given; direction: downstream, upstream or both. Cycles end by themselves."""
    edges = settle(_directed(edges, direction))
    seen = front = settle(folded(seeds.select("node"), "node").distinct().withColumn("hops", F.lit(0)))
    for k in itertools.count(1) if depth is None else range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = settle(step.withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)  # a union of written steps
    return seen


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    down = table_graph(edges)
    up = down.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = {"downstream": [down], "upstream": [up], "both": [down, up]}
    if direction not in ways:
        raise ValueError(f"not a direction: {direction!r}")
    return reduce(DataFrame.unionByName, ways[direction]).distinct()


def bounded_subgraph(edges: DataFrame, root: str, depth: int = 1, direction: str = "upstream") -> DataFrame:
    """src, dst, hops and hidden of the edges within ``depth`` steps of ``root``; hidden ones are those that lead on from
    the outermost tables, one step too far."""
    spark = edges.sparkSession
    near = reachable(edges, spark.createDataFrame([(root,)], "node string"), depth, direction)
    e, parts = table_graph(edges), []
    for way, here in (("upstream", "dst"), ("downstream", "src")):
        if direction in (way, "both"):
            parts.append(e.join(near.withColumnRenamed("node", here), here).select("src", "dst", (F.col("hops") + 1).alias("hops")))
    found = reduce(DataFrame.unionByName, parts).groupBy("src", "dst").agg(F.min("hops").alias("hops"))
    return found.withColumn("hidden", F.col("hops") > depth)


def path_exists(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst and reached of each of ``pairs``: is there a path, by one frontier for all distinct sources."""
    pairs = folded(pairs.select("src", "dst").distinct(), "src", "dst")
    edges = settle(table_graph(edges))
    seen = front = settle(pairs.select("src").distinct().withColumn("node", F.col("src")))
    while not front.isEmpty():
        step = front.withColumnRenamed("src", "origin").join(edges.withColumnRenamed("src", "node"), "node").select(F.col("origin").alias("src"), F.col("dst").alias("node"))
        front = settle(step.distinct().join(seen, ["src", "node"], "left_anti"))
        seen = seen.unionByName(front)
    # a table reaches itself only over a cycle
    ends = seen.where("src <> node").select("src", F.col("node").alias("dst"), F.lit(True).alias("reached"))
    return pairs.join(ends, ["src", "dst"], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))


def simple_paths(edges: DataFrame, seeds: DataFrame, depth: int | None = None, direction: str = "downstream") -> DataFrame:
    """node and path of every path without a repeated node from the seeds, of at most ``depth`` steps where it is given."""
    edges = settle(_directed(edges, direction))
    out = front = settle(folded(seeds.select("node"), "node").distinct().select("node", F.array("node").alias("path")))
    for _ in itertools.count() if depth is None else range(depth):
        step = front.join(edges, front["node"] == edges["src"]).where(~F.array_contains("path", F.col("dst")))
        front = settle(step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


class CycleError(ValueError):
    """The graph has a cycle; ``edges`` are those on it and behind it. ``cycles.components`` tells who is on it."""

    def __init__(self, edges: DataFrame):
        super().__init__(f"the graph has a cycle among or before: {', '.join(r[0] for r in edges.select('src').distinct().orderBy('src').limit(20).collect())}")
        self.edges = edges


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and level: 0 without an upstream, else one more than the highest upstream; a cycle is a ``CycleError``.

    A turn writes the edges that still have an edge before them; a table's level is the last turn that it is a target in.
    """
    nodes = settle(folded(nodes.select("node"), "node").distinct())
    left, turns = settle(table_graph(edges)), []
    for k in itertools.count(1):
        n = left.count()
        turns.append(left.select(F.col("dst").alias("node"), F.lit(k).alias("level")))
        if not n:
            last = reduce(DataFrame.unionByName, turns).groupBy("node").agg(F.max("level").alias("level"))
            return nodes.join(dealt(last), "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))
        rest = settle(left.join(dealt(left.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").select("src", "dst"))
        if rest.count() == n:
            raise CycleError(rest)
        left = rest


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst and selected of the edges into ``nodes``: is the upstream one of them too, or omitted."""
    picked = folded(nodes.select("node"), "node").distinct()
    into = table_graph(edges).join(picked.withColumnRenamed("node", "dst"), "dst", "left_semi")
    mark = picked.select(F.col("node").alias("src"), F.lit(True).alias("selected"))
    return into.join(mark, "src", "left").select("src", "dst", F.coalesce("selected", F.lit(False)).alias("selected"))


def edge_diff(before: DataFrame, after: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """keys and change (added, removed, changed) of edges of two snapshots; ``facts`` are compared null-safe."""
    one = lambda df, own: folded(df, *keys).groupBy(*keys).agg(F.max(F.struct(F.lit(1).alias("__one"), *facts)).alias(own))
    both = one(before, "old").join(one(after, "new"), keys, "full")
    same = reduce(Column.__and__, [F.col("old")[c].eqNullSafe(F.col("new")[c]) for c in facts], F.lit(True))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~same, "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def project_stats(models: DataFrame, edges: DataFrame, io: DataFrame) -> DataFrame:
    """fact and n: tables of each layer (layer:...), edges, jobs and tables that several jobs write."""
    layers = models.groupBy(F.concat(F.lit("layer:"), F.coalesce("layer", F.lit("OTHER"))).alias("fact")).agg(F.count(F.lit(1)).alias("n"))
    one = lambda df, fact: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(fact).alias("fact"), "n")
    return reduce(DataFrame.unionByName, [layers, one(table_graph(edges), "edges"), one(folded(io, "job").select("job").distinct(), "jobs"), one(multi_writers(io), "multi_writer_tables")])


def multi_writers(io: DataFrame) -> DataFrame:
    """Tables that several jobs write, with their sorted jobs; io: job, table_name, io_type."""
    out = folded(io, "job", "table_name").where("io_type = 'OUTPUT'").groupBy("table_name").agg(F.array_sort(F.collect_set("job")).alias("jobs"))
    return out.where(F.size("jobs") > 1)


def multi_outputs(io: DataFrame, temporary: DataFrame | None = None) -> DataFrame:
    """Jobs that write several tables, temporary ones (column table_name) aside, with the sorted tables."""
    out = folded(io, "job", "table_name").where("io_type = 'OUTPUT'")
    if temporary is not None:
        out = out.join(folded(temporary, "table_name").distinct(), "table_name", "left_anti")
    out = out.groupBy("job").agg(F.array_sort(F.collect_set("table_name")).alias("tables"))
    return out.where(F.size("tables") > 1)


def producers(io: DataFrame) -> DataFrame:
    """job, table_name, status and producer of each input: resolved, own (the job writes it itself), missing or ambiguous."""
    io = folded(io, "job", "table_name")
    made = io.where("io_type = 'OUTPUT'").select("table_name", F.col("job").alias("maker")).distinct()
    read = io.where("io_type = 'INPUT'").select("job", "table_name").distinct()
    met = read.join(made, "table_name", "left").groupBy("job", "table_name").agg(
        F.coalesce(F.max(F.col("maker") == F.col("job")), F.lit(False)).alias("own"),
        F.count_distinct(F.when(F.col("maker") != F.col("job"), F.col("maker"))).alias("n"),
        F.min(F.when(F.col("maker") != F.col("job"), F.col("maker"))).alias("only"),
    )
    status = F.when(F.col("own"), "own").when(F.col("n") == 1, "resolved").when(F.col("n") == 0, "missing").otherwise("ambiguous")
    return met.select("job", "table_name", status.alias("status"), F.when(status == "resolved", F.col("only")).alias("producer"))


def schedule_candidates(io: DataFrame) -> DataFrame:
    """upstream, downstream and the sorted tables behind each dependency of jobs: every writer of a table comes before its
    readers, and no order is inferred between writers of one table."""
    io = folded(io, "job", "table_name")
    made = io.where("io_type = 'OUTPUT'").select("table_name", F.col("job").alias("upstream")).distinct()
    read = io.where("io_type = 'INPUT'").select("table_name", F.col("job").alias("downstream")).distinct()
    # a job that writes the table too is one of its writers, not a consumer that waits for the others
    read = read.join(made.withColumnRenamed("upstream", "downstream"), ["table_name", "downstream"], "left_anti")
    return read.join(made, "table_name").groupBy("upstream", "downstream").agg(F.array_sort(F.collect_set("table_name")).alias("tables"))


def schedule_gaps(io: DataFrame, schedule: DataFrame) -> DataFrame:
    """The dependencies of ``schedule_candidates`` that the edges of ``schedule`` (src, dst: jobs) don't guarantee."""
    wanted = settle(schedule_candidates(io))
    held = path_exists(schedule, wanted.selectExpr("upstream as src", "downstream as dst")).where("reached")
    return wanted.join(held.selectExpr("src as upstream", "dst as downstream"), ["upstream", "downstream"], "left_anti")


def unsafe_consumers(io: DataFrame, selected: DataFrame, temporary: DataFrame) -> DataFrame:
    """job, table_name and producer of the temporary tables that a selected job (column job) reads while its resolved
    producer isn't selected: running it would read what is no longer there."""
    picked = folded(selected.select("job"), "job").distinct()
    temp = folded(temporary, "table_name").select("table_name").distinct()
    read = producers(io).where("status = 'resolved'").join(picked, "job", "left_semi").join(temp, "table_name", "left_semi")
    return read.join(picked.withColumnRenamed("job", "producer"), "producer", "left_anti").select("job", "table_name", "producer")


def collapse_temporary(edges: DataFrame) -> DataFrame:
    """src, dst between lasting tables, temporary ones bypassed within their job; edges: job, src, dst, src_temp, dst_temp.

    A temporary table is a node of its own in each job, so equal names in two jobs don't meet.
    """
    edges = folded(edges, "job", "src", "dst")
    name = lambda c: F.when(F.col(f"{c}_temp"), F.concat_ws("@", c, "job")).otherwise(F.col(c))
    e = settle(edges.select(name("src").alias("s"), name("dst").alias("d"), "src_temp", "dst_temp").distinct())
    seen = front = e.where("not src_temp").select(F.col("s").alias("src"), "d", "dst_temp")
    while True:
        step = front.where("dst_temp").select("src", F.col("d").alias("s")).join(e.select("s", "d", "dst_temp"), "s").select("src", "d", "dst_temp").distinct()
        front = settle(step.join(seen.select(F.col("src").alias("__src"), F.col("d").alias("__d")), F.col("src").eqNullSafe(F.col("__src")) & (F.col("d") == F.col("__d")), "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("not dst_temp").select("src", F.col("d").alias("dst")).distinct()


def collapse_columns(edges: DataFrame) -> DataFrame:
    """src, src_column, dst, dst_column and path between columns of lasting tables; edges also have src_column, dst_column.

    path: the columns of temporary tables on the way, in order; every way counts once, and none passes a column twice.
    """
    edges = folded(edges, "job", "src", "dst", "src_column", "dst_column")
    table = lambda c: F.when(F.col(f"{c}_temp"), F.concat_ws("@", c, "job")).otherwise(F.col(c))
    e = edges.select(*[table(c).alias(c) for c in ("src", "dst")], *[F.concat_ws(".", c, f"{c}_column").alias(f"{c}_node") for c in ("src", "dst")],
                     F.concat_ws(".", table("src"), "src_column").alias("s"), F.concat_ws(".", table("dst"), "dst_column").alias("d"), "src_column", "dst_column", "src_temp", "dst_temp")
    e = settle(e.distinct())
    start = e.where("not src_temp").select("src", "src_column", "dst", "dst_column", "dst_node", "dst_temp", "d", F.array().cast("array<string>").alias("path"), F.array("d").alias("past"))
    front, done = settle(start), []
    while not front.isEmpty():
        done.append(front.where("not dst_temp").select("src", "src_column", "dst", "dst_column", "path"))
        go = front.where("dst_temp").select("src", "src_column", F.col("d").alias("s"), F.concat("path", F.array("dst_node")).alias("path"), "past")
        step = go.join(e.select("s", "dst", "dst_column", "dst_node", "dst_temp", "d"), "s").where(~F.array_contains("past", F.col("d")))
        front = settle(step.select("src", "src_column", "dst", "dst_column", "dst_node", "dst_temp", "d", "path", F.concat("past", F.array("d")).alias("past")))
    if not done:
        return start.select("src", "src_column", "dst", "dst_column", "path")
    return reduce(DataFrame.unionByName, done).distinct()


def column_paths(edges: DataFrame, table: str, column: str, depth: int | None = None, direction: str = "upstream") -> DataFrame:
    """node and path of every path without a repeat over columns (table.column) from one column; edges: src, src_column, dst, dst_column."""
    e = edges.select(F.concat_ws(".", "src", "src_column").alias("src"), F.concat_ws(".", "dst", "dst_column").alias("dst"))
    return simple_paths(e, edges.sparkSession.createDataFrame([(f"{table}.{column}",)], "node string"), depth, direction)


def relations(conditions: DataFrame) -> DataFrame:
    """``conditions`` with the relation of its condition_type: join_on is join, where is filter, others are themselves."""
    kind = F.lower("condition_type")
    return conditions.withColumn("relation", F.when(kind == "join_on", "join").when(kind == "where", "filter").otherwise(kind))
