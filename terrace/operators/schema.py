"""Schema evolution by identity over frames of tables and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Fixed value: the form of a version 4 UUID.
UUID4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
LEAST_ALIKE = 0.5
#: Short forms in column names and what they stand for.
TOKEN_ALIASES = {"amt": "amount", "cnt": "count", "disc": "discount", "dt": "date", "prod": "product", "qty": "quantity"}


def _signatures(columns: DataFrame, tables: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    each = F.concat_ws(":", F.lower("name"), F.lower(text("data_type")), text("nullable"), text("default_value"))
    return columns.join(tables.select("table_name"), "table_name", "left_semi").select("table_name", each.alias("signature")).distinct()


def alike_tables(old_columns: DataFrame, new_columns: DataFrame, dropped: DataFrame, created: DataFrame, least: float = LEAST_ALIKE) -> DataFrame:
    """old_name, new_name and score: the greedy match of dropped to created tables by the Jaccard similarity of their
    column signatures, best first (ties by name), of ``least`` at least.

    Tables meet over a signature that they share.
    """
    old, new = _signatures(old_columns, dropped), _signatures(new_columns, created)
    size = lambda s, name: s.groupBy(F.col("table_name").alias(name)).agg(F.count(F.lit(1)).alias(f"n_{name}"))
    both = old.withColumnRenamed("table_name", "old_name").join(new.withColumnRenamed("table_name", "new_name"), "signature")
    both = both.groupBy("old_name", "new_name").agg(F.count(F.lit(1)).alias("n")).join(size(old, "old_name"), "old_name").join(size(new, "new_name"), "new_name")
    pairs = both.select("old_name", "new_name", (F.col("n") / (F.col("n_old_name") + F.col("n_new_name") - F.col("n"))).alias("score")).where(F.col("score") >= least)
    return _greedy(pairs, ["old_name"], ["new_name"], [F.col("score").desc(), "old_name", "new_name"])


def _greedy(pairs: DataFrame, old: list[str], new: list[str], order: list) -> DataFrame:
    """The pairs that going through all of them in ``order`` would take, each old and each new side once.

    Each turn takes the pairs that come first for both their sides: just those that no earlier pair can displace.
    """
    left, taken = materialise(pairs, "greedy"), None
    while True:
        nth = lambda side: F.row_number().over(Window.partitionBy(*side).orderBy(*order))
        best = left.withColumn("__a", nth(old)).withColumn("__b", nth(new)).where("__a = 1 and __b = 1").drop("__a", "__b")
        best = materialise(best, "greedy")
        taken = best if taken is None else taken.unionByName(best)
        if best.isEmpty():
            return taken
        left = materialise(left.join(best.select(*old), old, "left_anti").join(best.select(*new), new, "left_anti"), "greedy")


def column_renames(dropped: DataFrame, added: DataFrame) -> DataFrame:
    """table_name, old_name, new_name and score of renamed columns without ids; both: table_name, name, position,
    data_type, nullable, default_value, comment.

    Columns of one table, type and nullability are candidates if half of their name tokens are the same, or if they share
    a comment that no other dropped or added column of the table has. An equal comment counts 1000, the tokens' Jaccard
    similarity up to 100, an equal default 10; then the nearer position wins, then the later name.
    """
    full = F.create_map(*[F.lit(x) for pair in TOKEN_ALIASES.items() for x in pair])
    words = F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda t: t != "")
    note, tokens = F.trim(F.coalesce("comment", F.lit(""))), F.array_distinct(F.transform(words, lambda t: F.coalesce(full[t], t)))

    def side(df, prefix):
        rows = df.withColumns({"note": note, "tokens": tokens})
        often = rows.where("note <> ''").groupBy("table_name", "note").agg(F.count(F.lit(1)).alias("notes"))
        rows = rows.join(often, ["table_name", "note"], "left")
        return rows.select("table_name", "data_type", "nullable", *[F.col(c).alias(f"{prefix}_{c}") for c in ("name", "position", "default_value", "note", "notes", "tokens")])

    both = side(dropped, "old").join(side(added, "new"), ["table_name", "data_type", "nullable"])
    united = F.size(F.array_union("old_tokens", "new_tokens"))
    likeness = F.when(united == 0, 1.0).otherwise(F.size(F.array_intersect("old_tokens", "new_tokens")) / F.nullif(united, F.lit(0)))
    same_note = (F.col("old_note") != "") & (F.col("old_note") == F.col("new_note"))
    own_note = same_note & (F.col("old_notes") == 1) & (F.col("new_notes") == 1)
    score = F.when(same_note, 1000).otherwise(0) + F.floor(likeness * 100).cast("int")
    default = F.when((F.col("old_default_value") != "") & (F.col("old_default_value") == F.col("new_default_value")), 10).otherwise(0)
    found = both.where((likeness >= 0.5) | own_note).select("table_name", "old_name", "new_name", score.alias("score"), (score + default).alias("rank"), F.abs(F.col("old_position") - F.col("new_position")).alias("gap"))
    order = [F.col("rank").desc(), "gap", F.col("score").desc(), F.col("old_name").desc(), F.col("new_name").desc()]
    return _greedy(found, ["table_name", "old_name"], ["table_name", "new_name"], order).select("table_name", "old_name", "new_name", "score")


def layout_changes(pairs: DataFrame, old: DataFrame, new: DataFrame, facts: list[str]) -> DataFrame:
    """``pairs`` (old_name, new_name) with rebuilt: does any of the physical ``facts`` (keys, distribution, partition) differ,
    so that the table must be dropped and made anew?"""
    o = old.select(F.col("table_name").alias("old_name"), F.struct(*facts).alias("o"))
    n = new.select(F.col("table_name").alias("new_name"), F.struct(*facts).alias("n"))
    return pairs.join(o, "old_name").join(n, "new_name").withColumn("rebuilt", ~F.col("o").eqNullSafe(F.col("n"))).drop("o", "n")


def table_diff(old: DataFrame, new: DataFrame, old_columns: DataFrame, new_columns: DataFrame, layout: tuple | list = ()) -> DataFrame:
    """change (keep, rename, rebuild, drop, create), old_name and new_name of every table; old, new: table_name, table_id
    and the ``layout`` facts; columns: table_name, name, data_type, nullable, default_value.

    A name on both sides is one table unless both ids are there and differ. Then equal ids are a rename, and tables
    without an id on either side are matched by ``alike_tables``.
    """
    o = old.select(F.col("table_name").alias("old_name"), F.col("table_id").alias("old_id"))
    n = new.select(F.col("table_name").alias("new_name"), F.col("table_id").alias("new_id"))
    kept = o.join(n, F.col("old_name") == F.col("new_name")).where("old_id is null or new_id is null or old_id = new_id").select("old_name", "new_name")
    gone, come = o.join(kept, "old_name", "left_anti"), n.join(kept, "new_name", "left_anti")
    moved = gone.join(come, F.col("old_id") == F.col("new_id")).select("old_name", "new_name")
    gone, come = gone.join(moved, "old_name", "left_anti"), come.join(moved, "new_name", "left_anti")
    bare = lambda df, c: df.where(f"{c}_id is null").select(F.col(f"{c}_name").alias("table_name"))
    alike = alike_tables(old_columns, new_columns, bare(gone, "old"), bare(come, "new")).select("old_name", "new_name")
    gone, come = gone.join(alike, "old_name", "left_anti"), come.join(alike, "new_name", "left_anti")
    pairs = kept.withColumn("change", F.lit("keep")).unionByName(moved.unionByName(alike).withColumn("change", F.lit("rename")))
    if layout:
        pairs = layout_changes(pairs, old, new, list(layout)).withColumn("change", F.when(F.col("rebuilt"), "rebuild").otherwise(F.col("change"))).drop("rebuilt")
    none = F.lit(None).cast("string")
    lost = gone.select("old_name", none.alias("new_name"), F.lit("drop").alias("change"))
    made = come.select(none.alias("old_name"), "new_name", F.lit("create").alias("change"))
    return pairs.unionByName(lost).unionByName(made).select("change", "old_name", "new_name")


def id_problems(ids: DataFrame) -> DataFrame:
    """project, owner, id and problem (missing, form, repeated) of stable ids; ids: project, owner, id. An id may occur
    once over all projects."""
    often = ids.where("id is not null").groupBy(F.lower("id").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = ids.withColumn("key", F.lower("id")).join(often, "key", "left")
    problem = F.when(F.col("id").isNull(), "missing").when(~F.col("key").rlike(UUID4), "form").when(F.col("n") > 1, "repeated")
    return marked.select("project", "owner", "id", problem.alias("problem")).where("problem is not null")


def identity_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, old_name, new_name and renamed of each id that exactly one row has on either side: proven renames."""
    one = lambda df, name: df.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias(name)).where("n = 1").drop("n")
    return one(old, "old_name").join(one(new, "new_name"), "id").withColumn("renamed", F.lower("old_name") != F.lower("new_name"))
