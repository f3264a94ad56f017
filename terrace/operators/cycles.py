"""Cycles of a lineage graph as rows: strongly connected components by trimming, colouring and walking back.

Tables without an edge in or out lie on no cycle and are trimmed, again and again. In what is left each table takes the least
name that reaches it as its colour; a cycle has one colour, so edges between colours go. The table that gave a colour its name
and all of that colour that lead back to it are a component; it is taken out, and the rest goes round again. Every step is a
join of the edges with one row a table, written before the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import dealt, folded, settle, table_graph


def _trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without those that can't lie on a cycle for want of an edge before or behind them."""
    n = edges.count()
    while n:
        left = edges.join(dealt(edges.select(F.col("dst").alias("src")).distinct()), "src", "left_semi")
        edges = settle(left.join(dealt(left.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").select("src", "dst"))
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least member) of every table that lies on a cycle of two tables or more."""
    left, found = settle(table_graph(edges)), []
    empty = left.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found, empty)
        colours = settle(left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))  # after trimming every table is a source
        while True:
            heard = left.join(dealt(colours.withColumnRenamed("node", "src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("heard"))
            new = settle(colours.join(dealt(heard), "node", "left").select("node", F.least("colour", F.coalesce("heard", "colour")).alias("colour"), (F.col("heard") < F.col("colour")).alias("changed")))
            colours = new.select("node", "colour")
            if new.where("changed").isEmpty():
                break
        ends = left.join(dealt(colours.select(F.col("node").alias("src"), F.col("colour").alias("a"))), "src").join(dealt(colours.select(F.col("node").alias("dst"), F.col("colour").alias("b"))), "dst")
        left = settle(ends.where("a = b").select("src", "dst", F.col("a").alias("colour")))
        front = seen = settle(colours.where("node = colour").select("node", "colour"))
        while not front.isEmpty():
            step = left.join(dealt(front.withColumnRenamed("node", "dst")), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = settle(step.join(dealt(seen.select("node")), "node", "left_anti"))
            seen = seen.unionByName(front)
        seen = settle(seen.select("node", F.col("colour").alias("component")))
        several = seen.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(seen.join(dealt(several.select("component")), "component", "left_semi").select("node", "component"))
        gone = seen.select(F.col("node").alias("src"))
        left = settle(left.join(dealt(gone), "src", "left_anti").join(dealt(gone.withColumnRenamed("src", "dst")), "dst", "left_anti").select("src", "dst"))


def condensed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node and the group that it is part of, edges between groups): every cycle becomes one group, named by its least member."""
    nodes = folded(nodes.select("node"), "node").distinct()
    of = settle(nodes.join(dealt(components(edges)), "node", "left").select("node", F.coalesce("component", "node").alias("group")))
    e = table_graph(edges).join(dealt(of.select(F.col("node").alias("src"), F.col("group").alias("a"))), "src").join(dealt(of.select(F.col("node").alias("dst"), F.col("group").alias("b"))), "dst")
    return of, settle(e.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
