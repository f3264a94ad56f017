"""Days, weeks, months and hours as columns: period bounds, enumeration, rolling windows and windows along lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import CycleError, dealt, folded, levelled, levels, settle, table_graph


def period_start(at: Column, period: Column, week_start: int = 1) -> Column:
    """Start of the H, D, W or M period that holds ``at``; weeks begin on ISO weekday ``week_start``."""
    day = F.date_trunc("day", at)
    back = F.pmod(F.weekday(at) + 1 - week_start, F.lit(7))
    return (
        F.when(period == "H", F.date_trunc("hour", at))
        .when(period == "D", day)
        .when(period == "W", F.date_trunc("day", F.date_sub(at.cast("date"), back).cast("timestamp_ntz")))
        .when(period == "M", F.date_trunc("month", at))
    ).cast("timestamp_ntz")


def period_next(start: Column, period: Column) -> Column:
    """Start of the period after the one that starts at ``start``."""
    plus = lambda text: start + F.expr(f"interval {text}")
    return F.when(period == "H", plus("1 hour")).when(period == "D", plus("1 day")).when(period == "W", plus("7 days")).when(period == "M", plus("1 month"))


def enumerate_periods(windows: DataFrame, week_start: int = 1) -> DataFrame:
    """A row with period_start for each period that the half-open window [start, end) of a row touches; windows have a
    period column. An empty window touches none."""
    first = period_start(F.col("start"), F.col("period"), week_start)
    step = F.when(F.col("period") == "H", F.expr("interval 1 hour")).when(F.col("period") == "W", F.expr("interval 7 days")).otherwise(F.expr("interval 1 day"))
    last = F.col("end") - F.expr("interval 1 microsecond")
    days = F.when(F.col("period") == "M", F.sequence(first, last, F.expr("interval 1 month"))).otherwise(F.sequence(first, last, step))
    return windows.where("start < `end`").withColumn("period_start", F.explode(days))


def rolling_months(ends: DataFrame, end: str, months: int, to: str = "day") -> DataFrame:
    """Each different date of column ``end`` with a row for every day of its inclusive window, which begins ``months``
    calendar months earlier (on the month's last day where it is shorter)."""
    return ends.select(end).where(F.col(end).isNotNull()).distinct().withColumn(to, F.explode(F.sequence(F.add_months(end, -months), F.col(end))))


def day_gaps(days: DataFrame, day: str, by: list[str]) -> DataFrame:
    """by, after and missing: where the days of each group aren't contiguous, and how many are missing there. A full
    refresh over a window is only allowed without such rows."""
    d = days.select(*by, day).where(F.col(day).isNotNull()).distinct()
    following = F.lead(day).over(Window.partitionBy(*by).orderBy(day))
    return d.withColumn("missing", F.date_diff(following, F.col(day)) - 1).where("missing > 0").select(*by, F.col(day).alias("after"), "missing")


def discover_dates(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """The different days of the given column of each table, to replay a full refresh slice by slice."""
    days = None
    for t, c in zip(tables, columns, strict=True):
        d = t.select(F.to_date(c).alias("day")).where("day is not null").distinct()
        days = d if days is None else days.unionByName(d)
    return days.distinct()


def along_edges(anchors: DataFrame, periods: DataFrame, edges: DataFrame, week_start: int = 1) -> DataFrame:
    """table_name, start and end that each upstream of an anchor window must cover, one step up.

    anchors: table_name, start, end (half-open); periods: table_name, period; edges: src, dst. A window grows to whole
    periods of the upstream, and windows of one upstream are merged to their hull.
    """
    up = edges.select("src", "dst").distinct().join(anchors.withColumnRenamed("table_name", "dst"), "dst")
    up = up.join(periods.withColumnRenamed("table_name", "src"), "src")
    low = period_start(F.col("start"), F.col("period"), week_start)
    last = period_start(F.col("end") - F.expr("interval 1 microsecond"), F.col("period"), week_start)
    grown = up.where("start < `end`").select(F.col("src").alias("table_name"), low.alias("start"), period_next(last, F.col("period")).alias("end"))
    return grown.groupBy("table_name").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _grown(windows: DataFrame, periods: DataFrame, week_start: int) -> DataFrame:
    """``windows`` with their table's period, each widened to whole ones; tables without a period keep theirs as they are."""
    rows = windows.join(dealt(periods), "table_name", "left")
    last = period_start(F.col("end") - F.expr("interval 1 microsecond"), F.col("period"), week_start)
    low = F.coalesce(period_start(F.col("start"), F.col("period"), week_start), "start")
    return rows.select("table_name", "period", low.alias("start"), F.coalesce(period_next(last, F.col("period")), "end").alias("end"), "anchors")


def _merged(windows: DataFrame) -> DataFrame:
    """``windows`` with those of a table that touch made one, with all their anchors."""
    order = Window.partitionBy("table_name").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = windows.withColumn("island", island).groupBy("table_name", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("anchors")))).alias("anchors"))
    return merged.drop("island")


def _walked(first: DataFrame, periods: DataFrame, edges: DataFrame, week_start: int) -> DataFrame:
    """The windows of all anchors, step by step until nothing new comes up: for graphs with a cycle, where there are no levels."""
    key = ["table_name", "start", "end", "anchors"]
    front = seen = settle(_grown(first.distinct(), periods, week_start).distinct())
    most, steps = edges.select("src").distinct().count(), 0
    while not front.isEmpty():
        if steps > most:
            raise ValueError("the graph has a cycle")
        up = edges.join(dealt(front.withColumnRenamed("table_name", "dst")), "dst").select(F.col("src").alias("table_name"), "start", "end", "anchors").distinct()
        front = settle(_grown(up, periods, week_start).distinct().join(dealt(seen.select(*key)), key, "left_anti"))
        seen, steps = seen.unionByName(front), steps + 1
    return seen


def along_lineage(anchors: DataFrame, periods: DataFrame, edges: DataFrame, week_start: int = 1) -> DataFrame:
    """table_name, period, start, end and anchors (sorted) of all that must be computed for the anchor windows, up the whole lineage.

    anchors: table_name, start, end (half-open); periods: table_name, period (H, D, W or M; tables that have none pass windows
    on as they are); edges: src, dst. A window is widened to whole periods of its table and so handed to every upstream, level by
    level, once all that the table feeds are done: a month above a day widens all that is above it. Windows of a table that touch are one, with all their anchors;
    others stay apart. Empty windows need nothing. A cycle would widen windows for ever and is an error.
    """
    edges = settle(table_graph(edges))
    periods = settle(folded(periods.select("table_name", "period"), "table_name").where("period is not null").distinct())
    first = folded(anchors, "table_name").where("start < `end`").select("table_name", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), F.array("table_name").alias("anchors"))
    first = settle(first.distinct())
    try:
        of_level = settle(levels(edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(first.select("table_name")), edges))
    except CycleError:
        return _merged(_walked(first, periods, edges, week_start))
    first = settle(first.join(dealt(of_level.withColumnRenamed("node", "table_name")), "table_name"))
    up, done = levelled(edges, of_level, "src"), None
    # windows that touch do so above as well, widened or not: they are handed on as one
    for k in range(first.agg(F.max("level")).first()[0] or 0, -1, -1):
        at = first.where(F.col("level") == k).drop("level")
        if done is not None:
            below = dealt(done.select(F.col("table_name").alias("dst"), "start", "end", "anchors"))
            at = at.unionByName(up.where(F.col("level") == k).join(below, "dst").select(F.col("src").alias("table_name"), "start", "end", "anchors"))
        here = settle(_merged(_grown(at, periods, week_start)))
        done = here if done is None else done.unionByName(here)
    return done


def execution_values(windows: DataFrame, week_start: int = 1) -> DataFrame:
    """table_name and period_start of each period that a table with a period must run for; windows: as of ``along_lineage``."""
    return enumerate_periods(windows.where("period is not null"), week_start).select("table_name", "period_start").distinct()


def compare_scopes(anchors: DataFrame, slices: DataFrame, at: Column, week_start: int = 1) -> DataFrame:
    """table_name, mode (time_slice or full_table), column, period, start, end and why a whole table is compared (no_slice:
    it isn't kept by time; no_value: ``at`` is null) of each anchor (table_name); slices: table_name, time_column, period."""
    s = folded(slices.select("table_name", "time_column", "period"), "table_name")
    rows = folded(anchors.select("table_name"), "table_name").distinct().join(s, "table_name", "left").withColumn("at", at.cast("timestamp_ntz"))
    sliced = F.col("period").isNotNull() & F.col("at").isNotNull()
    rows = rows.withColumn("start", F.when(sliced, period_start(F.col("at"), F.col("period"), week_start)))
    only = lambda c: F.when(sliced, F.col(c))
    return rows.select("table_name", F.when(sliced, "time_slice").otherwise("full_table").alias("mode"), only("time_column").alias("column"), only("period").alias("period"), "start",
                       period_next(F.col("start"), F.col("period")).alias("end"), F.when(F.col("period").isNull(), "no_slice").when(~sliced, "no_value").alias("why"))
