"""Tables filled from streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money
from ..operators.shared import new_path
from ..streaming.slices import SliceStream
from .sales import _D, table

ARRIVALS = 4


def _partial(rows):
    return rows.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(money("value")).cast("decimal(38,2)").alias("value"), F.max("ts").alias("last_at"))


def _merge(rows):
    return rows.groupBy("day", "event_type").agg(F.sum("events").alias("events"), F.sum("value").alias("value"), F.max("last_at").alias("last_at"))


def _arrived(spark, d):
    """The daily table of events that come in four arrivals, one a quarter of the month's days, each tenth event in the
    last one however old it is. The stream is started for each arrival and goes on where it ended."""
    path = new_path(spark, "streamed")
    events = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    arrival = F.when(F.col("event_id") % 10 == 0, ARRIVALS - 1).otherwise(F.floor((F.dayofmonth("ts") - 1) / 8))
    daily = SliceStream(f"{path}/daily", "day date, event_type string, events long, value decimal(38,2), last_at timestamp_ntz", "day", _partial, _merge)
    for k in range(ARRIVALS):
        events.where(arrival == k).write.mode("append").parquet(f"{path}/landing")
        daily.start(spark.readStream.schema(events.schema).parquet(f"{path}/landing")).awaitTermination()
    return daily


def streamed_slices(spark, d):
    return _arrived(spark, d).read(spark).withColumn("value", F.col("value").cast("double")).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


def reopened_slices(spark, d):
    return _arrived(spark, d).reopened(spark, 7)


QUERIES = {f.__name__: f for f in (streamed_slices, reopened_slices)}
ORACLE_SQL = {
    "streamed_slices": f"SELECT ts::DATE AS day, event_type, count(*) AS events, sum(value::{_D})::DOUBLE AS value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY 1, 2",
    "reopened_slices": """WITH a AS (SELECT DISTINCT ts::DATE AS day, CASE WHEN event_id % 10 = 0 THEN 3 ELSE (day(ts) - 1) // 8 END AS batch FROM events),
        x AS (SELECT day, batch, (SELECT max(b.day) FROM a AS b WHERE b.batch < a.batch) AS latest FROM a)
        SELECT day, batch::BIGINT AS batch, latest FROM x WHERE day < latest - INTERVAL 7 DAY""",
}
