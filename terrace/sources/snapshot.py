"""Lineage snapshots: JSON in, checked frames, stored as partitioned tables with one active snapshot a project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.cycles import components
from ..operators.graph import folded, levels
from ..operators.shared import materialise

#: The form of a snapshot file.
FORM = """project string, tables array<struct<name:string,layer:string,columns:array<string>>>,
    jobs array<struct<name:string,inputs:array<string>,outputs:array<string>>>,
    edges array<struct<job:string,src:string,src_column:string,dst:string,dst_column:string,condition_type:string>>"""
KINDS = ("tables", "jobs", "edges")
#: Stands between a project and a name where both are one text.
_APART = "\x1f"


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A stored kind with project and id as the texts that they are: guessed types would make 42 of 0042."""
    row = StructType.fromDDL(FORM)[kind].dataType.elementType
    return spark.read.schema(StructType([*row, StructField("project", StringType()), StructField("snapshot_id", StringType())])).parquet(f"{path}/{kind}")


def read_snapshots(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """tables, jobs and edges, each with its project, of the JSON files under ``path`` (one object a file), and broken: the file
    and text of each one that isn't JSON of this form, for ``validate_snapshot`` to report."""
    read = spark.read.schema(f"{FORM}, __broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "__broken")
    top = read.json(path).withColumn("file", F.input_file_name())
    whole = top.where("__broken is null")
    out = {k: whole.select("project", F.explode(k).alias("row")).select("project", "row.*") for k in KINDS}
    return {**out, "broken": top.where("__broken is not null or project is null").select("file", F.substring("__broken", 1, 200).alias("text"))}


def build_snapshot(parts: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """One snapshot of several tasks' facts: names folded, rows once each, sorted; of a table the longest column list stays."""
    join = lambda kind: reduce(DataFrame.unionByName, [p[kind] for p in parts])
    tables = folded(join("tables"), "name").groupBy("project", "name").agg(F.max("layer").alias("layer"), F.max_by("columns", F.struct(F.size("columns"), F.array_join("columns", ","))).alias("columns"))
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)))))
    jobs = folded(join("jobs"), "name").groupBy("project", "name").agg(names("inputs").alias("inputs"), names("outputs").alias("outputs"))
    edges = folded(join("edges"), "job", "src", "src_column", "dst", "dst_column").distinct()
    return {"tables": tables.orderBy("project", "name"), "jobs": jobs.orderBy("project", "name"), "edges": edges.orderBy(*edges.columns)}


def validate_snapshot(snapshot: dict[str, DataFrame]) -> DataFrame:
    """project, kind, name and problem of what doesn't hold: files are readable, names present and once, edges and jobs refer to
    known tables and jobs, edges to known columns, no table and no job depends on itself over others (each member is named, with the
    least member of its cycle)."""
    tables, jobs, edges = (snapshot[k] for k in KINDS)
    t, j = folded(tables, "name"), folded(jobs, "name")
    e = folded(edges, "job", "src", "src_column", "dst", "dst_column")
    row = lambda df, kind, name, problem: df.select("project", F.lit(kind).alias("kind"), F.col(name).alias("name"), F.lit(problem).alias("problem"))
    found = []
    for kind, df in (("table", t), ("job", j)):
        found.append(row(df.where("name is null or name = ''"), kind, "name", "no name"))
        found.append(row(df.groupBy("project", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and name <> ''"), kind, "name", "repeated"))
    known = t.select("project", "name").distinct()
    for side in ("src", "dst"):
        there = e.join(known.withColumnRenamed("name", side), ["project", side], "left_semi")
        found.append(row(e.join(known.withColumnRenamed("name", side), ["project", side], "left_anti"), "edge", side, "unknown table").distinct())
        columns = t.select("project", F.col("name").alias(side), F.explode(F.transform("columns", F.lower)).alias(f"{side}_column"))
        lost = there.join(columns, ["project", side, f"{side}_column"], "left_anti").withColumn("name", F.concat_ws(".", side, f"{side}_column"))
        found.append(row(lost, "edge", "name", "unknown column").distinct())
    found.append(row(e.join(j.select("project", F.col("name").alias("job")), ["project", "job"], "left_anti"), "edge", "job", "unknown job").distinct())
    for side in ("inputs", "outputs"):
        uses = j.select("project", F.explode(F.transform(side, F.lower)).alias("name")).distinct()
        found.append(row(uses.join(known, ["project", "name"], "left_anti"), "job", "name", f"unknown table in {side}"))
    found.append(cycle_problems(snapshot))
    if "broken" in snapshot:
        found.append(snapshot["broken"].select(F.lit(None).cast("string").alias("project"), F.lit("file").alias("kind"), F.element_at(F.split("file", "/"), -1).alias("name"), F.lit("not a snapshot").alias("problem")))
    return reduce(DataFrame.unionByName, found)


def cycle_problems(snapshot: dict[str, DataFrame]) -> DataFrame:
    """project, kind, name and problem of every table and job that lies on a cycle; one graph holds all projects."""
    e, jobs = snapshot["edges"], folded(snapshot["jobs"], "name")
    uses = lambda side: jobs.select("project", "name", F.explode(F.transform(side, F.lower)).alias("table_name"))
    steps = uses("outputs").withColumnRenamed("name", "src").join(uses("inputs").withColumnRenamed("name", "dst"), ["project", "table_name"])
    in_project = lambda c: F.concat_ws(_APART, F.lower("project"), c)
    found = []
    for kind, df in (("table", e), ("job", steps)):
        on = components(df.select(in_project("src").alias("src"), in_project("dst").alias("dst"))).withColumn("key", F.substring_index("node", _APART, 1))
        names = df.select("project").distinct().withColumn("key", F.lower("project"))
        own = lambda c: F.substring_index(c, _APART, -1)
        found.append(on.join(names, "key").select("project", F.lit(kind).alias("kind"), own("node").alias("name"), F.concat(F.lit("in the cycle of "), own("component")).alias("problem")))
    return found[0].unionByName(found[1])


def check_acyclic(snapshot: dict[str, DataFrame]) -> None:
    """Raises an error that names them if the tables' edges have a cycle."""
    e = snapshot["edges"]
    levels(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), e)


def import_rows(snapshot: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(column edges as relational rows with an id, skipped rows with the reason): edges need a job and both ends."""
    e = folded(snapshot["edges"], "job", "src", "src_column", "dst", "dst_column")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = F.when(empty("job"), "no job").when(empty("src") | empty("src_column"), "no source").when(empty("dst") | empty("dst_column"), "no target")
    marked = e.withColumn("reason", reason)
    key = ["project", "job", "src", "src_column", "dst", "dst_column", "condition_type"]
    rows = marked.where("reason is null").drop("reason").distinct().withColumn("edge_id", F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in key]), 256))
    return rows, marked.where("reason is not null")


def save_snapshot(snapshot: dict[str, DataFrame], path: str, snapshot_id: str) -> None:
    """Adds the snapshot under ``path``, partitioned by project and id; saving an id again replaces it. It isn't active yet."""
    for kind in KINDS:
        rows = snapshot[kind].withColumn("snapshot_id", F.lit(snapshot_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "snapshot_id").parquet(f"{path}/{kind}")


def count_problems(snapshot: dict[str, DataFrame], spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    """kind, expected and stored where a stored snapshot has other numbers of rows than ``snapshot``."""
    one = lambda df, kind, to: df.agg(F.count(F.lit(1)).alias(to)).withColumn("kind", F.lit(kind))
    want = reduce(DataFrame.unionByName, [one(snapshot[k], k, "expected") for k in KINDS])
    have = reduce(DataFrame.unionByName, [one(_stored(spark, path, k).where(F.col("snapshot_id") == snapshot_id), k, "stored") for k in KINDS])
    return want.join(have, "kind").where("expected <> stored").select("kind", "expected", "stored")


def activate(spark: SparkSession, path: str, project: str, snapshot_id: str, at: str) -> None:
    """Makes the snapshot the project's active one from time ``at`` on: one more row of a small log, whose last row counts."""
    row = spark.createDataFrame([(project, snapshot_id, at)], "project string, snapshot_id string, at string")
    row.coalesce(1).write.mode("append").parquet(f"{path}/active")


def active_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """project and snapshot_id: the last activation of each project (by time, then id)."""
    log = spark.read.schema("project string, snapshot_id string, at string").parquet(f"{path}/active")
    nth = F.row_number().over(Window.partitionBy("project").orderBy(F.col("at").desc(), F.col("snapshot_id").desc()))
    return log.withColumn("nth", nth).where("nth = 1").select("project", "snapshot_id")


def load_active(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of ``kind`` of each project's active snapshot; the few pairs of project and id prune the scan's partitions."""
    live = F.broadcast(active_snapshots(spark, path))  # a row for each project
    return _stored(spark, path, kind).join(live, ["project", "snapshot_id"], "left_semi")


def pending_tasks(tasks: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """``tasks`` (task, sql, schema_slice, config) with their cache key, those aside whose key (column key) is in ``done``:
    what has to be read again."""
    key = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in ("sql", "schema_slice", "config")], F.lit(version)), 256)
    return materialise(tasks.withColumn("key", key), "tasks").join(done.select("key").distinct(), "key", "left_anti")
