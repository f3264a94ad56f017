"""Sales, customer and version queries of a layered warehouse, over orders, lineitem, part, customer and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashed, money, month_key, safe_ratio, surrogate_key, whole_months
from ..operators import etl
from ..operators.ranking import ntile_of

ETL_DATE = "1998-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _net():
    return money("l_extendedprice") * (1 - money("l_discount"))


def rfm_segmentation(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderdate") < F.lit(ETL_DATE).cast("timestamp_ntz"))
    c = o.groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("last_order"), F.count(F.lit(1)).alias("frequency"), F.sum(money("o_totalprice")).cast("double").alias("monetary"))
    c = c.withColumn("recency_days", F.date_diff(F.lit(ETL_DATE).cast("date"), "last_order")).withColumn("neg_recency", -F.col("recency_days"))
    c = ntile_of(c, 5, {"r_score": "neg_recency", "f_score": "frequency", "m_score": "monetary"}, "o_custkey")
    r, f, m = (F.col(x) for x in ("r_score", "f_score", "m_score"))
    segment = (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "high value").when((r >= 3) & (f >= 3) & (m >= 3), "keep").when((r >= 3) & ((f < 3) | (m < 3)), "develop")
        .when((r < 3) & (f >= 3) & (m >= 3), "win back").when((r < 3) & (f < 3) & (m < 3), "at risk").when((f <= 2) & (r >= 3) & (m >= 3), "promising").otherwise("general")
    )
    return c.select("o_custkey", "recency_days", "frequency", "monetary", "r_score", "f_score", "m_score", (r + f + m).alias("rfm_score"), segment.alias("segment"))


def product_sales_daily(spark, d):
    li = table(spark, d, "lineitem")
    return (
        li.groupBy("l_partkey", F.to_date("l_shipdate").alias("stat_date"))
        .agg(F.count_distinct("l_orderkey").alias("order_count"), F.sum(money("l_quantity")).cast("double").alias("sale_quantity"), F.sum(_net()).cast("double").alias("sale_amount"))
        .where("sale_amount >= 0")
    )


def product_topn_daily(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("stat_date"), "l_partkey").agg(F.sum(_net()).cast("double").alias("sale_amount"))
    top = etl.top_ranked(li, ["stat_date"], [F.col("sale_amount").desc()], 10)
    return top.join(table(spark, d, "part").select("p_partkey", "p_name"), top["l_partkey"] == F.col("p_partkey"), "left").select("stat_date", "l_partkey", "p_name", "sale_amount", "rank_num")


def sales_dashboard_growth(spark, d):
    day = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("stat_date")).agg(
        F.count(F.lit(1)).alias("total_orders"), F.count_distinct("o_custkey").alias("total_customers"), F.sum(money("o_totalprice")).cast("double").alias("total_amount"))
    day = etl.with_growth(etl.with_growth(day, "stat_date", "total_orders", "order_growth"), "stat_date", "total_amount", "amount_growth")
    return day.withColumns({"order_growth": F.coalesce("order_growth", F.lit(0.0)).cast("double"), "amount_growth": F.coalesce("amount_growth", F.lit(0.0)), "avg_order_amount": F.col("total_amount") / F.col("total_orders")})


def store_performance(spark, d):
    from pyspark.sql import Window

    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    m = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey", month_key("o_orderdate").alias("stat_month")).agg(
        F.count(F.lit(1)).alias("total_orders"), F.sum(money("o_totalprice")).cast("double").alias("total_amount"), F.count_distinct("o_custkey").alias("customer_count"))
    w = Window.partitionBy("stat_month")
    part = lambda c: F.col(c) * 1.0 / F.nullif(F.max(c).over(w), F.lit(0))
    score = F.round(part("total_orders") * 30.0 + part("total_amount") * 40.0 + part("customer_count") * 30.0, 2)
    m = m.withColumn("performance_score", F.coalesce(score.cast("double"), F.lit(0.0)))
    return m.join(n, m["c_nationkey"] == n["n_nationkey"], "left").select("c_nationkey", "n_name", "stat_month", "total_orders", "total_amount", "customer_count", "performance_score")


def segment_share_of_total(spark, d):
    seg = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_distinct("c_custkey").alias("customers"), F.sum(money("c_acctbal")).cast("double").alias("balance"))
    return etl.with_share(seg, "customers").withColumn("share_pct", F.col("share_pct").cast("double"))


def latest_version_snapshot(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return etl.latest_version(e, ["user_id", "event_type"], ["ts", "event_id"])


def daily_latest_version(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("snapshot_date"), "event_id", "ts", "value")
    return etl.latest_version(e, ["user_id", "snapshot_date"], ["ts", "event_id"])


def order_detail_wide(spark, d):
    li, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"], "left")
    cost = money("p_retailprice") * money("l_quantity")
    return rows.select("l_orderkey", "l_linenumber", "o_custkey", "p_brand", month_key("o_orderdate").alias("order_month"), _net().cast("double").alias("net_amount"), (_net() - cost).cast("double").alias("gross_profit"))


def customer_monthly_summary(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    orders = o.groupBy("o_custkey", month_key("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("orders"), F.sum(money("o_totalprice")).cast("double").alias("amount"))
    lines = li.join(o.select("o_orderkey", "o_custkey"), li["l_orderkey"] == F.col("o_orderkey"))
    shipped = lines.groupBy("o_custkey", month_key("l_shipdate").alias("month")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"))
    return orders.join(shipped, ["o_custkey", "month"], "left").select("o_custkey", "month", "orders", "amount", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("returned", F.lit(0)).alias("returned"))


def promotion_effect(spark, d):
    li = table(spark, d, "lineitem").withColumn("promotion", F.when(F.col("l_discount") >= 0.05, "deep").when(F.col("l_discount") > 0, "light"))
    g = li.groupBy("promotion").agg(F.count_distinct("l_orderkey").alias("orders"), F.sum(money("l_extendedprice")).alias("gross"), F.sum(money("l_extendedprice") * money("l_discount")).alias("given"))
    return g.select("promotion", "orders", F.col("gross").cast("double").alias("gross"), F.col("given").cast("double").alias("given"), safe_ratio(F.col("gross"), F.col("given")).alias("roi"))


def odd_even_multi_writer(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", money("o_totalprice").alias("amount"))
    sums = lambda rows: rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("amount").cast("double").alias("amount")).where(F.col("amount").isNotNull())
    odd = F.col("o_custkey") % 2 == 1
    return etl.merge_owned(sums(o.where(~odd)), sums(o.where(odd)), odd)


def date_spine(spark, d):
    return etl.date_spine(table(spark, d, "orders"), "o_orderdate")


def surrogate_keys(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", surrogate_key("c_custkey", "c_name", "c_mktsegment").alias("customer_sk"), hashed("c_name").alias("name_hash"))


def text_clean(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.upper(F.trim("p_name")).alias("name"), F.lower("p_brand").alias("brand"), F.regexp_replace("p_type", "[^A-Za-z]", "").alias("type_letters"))


def tenure_months(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))
    return o.withColumn("tenure", whole_months(F.col("first_day"), F.col("last_day")))


def day_features(spark, d):
    e = table(spark, d, "events")
    hour = F.hour("ts")
    part = F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")
    return e.select("event_id", F.dayofweek("ts").alias("day_of_week"), hour.alias("hour"), F.dayofweek("ts").isin(1, 7).alias("is_weekend"), part.alias("day_part"))


def inventory_alert(spark, d):
    """Stock of a part and supplier against the mean of the part's daily sales in the eight days up to the date."""
    li, p, s = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    week = li.where((F.col("l_shipdate") >= F.date_sub(F.lit(ETL_DATE).cast("date"), 7).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.date_add(F.lit(ETL_DATE).cast("date"), 1).cast("timestamp_ntz")))
    daily = week.groupBy("l_partkey", F.to_date("l_shipdate").alias("stat_date")).agg(F.sum(money("l_quantity")).cast("double").alias("sold"))
    velocity = daily.groupBy("l_partkey").agg(F.round(F.avg("sold"), 2).alias("velocity"))
    quantity = (F.sum(money("l_quantity")) - F.lit(50)).cast("double")
    stock = li.groupBy("l_partkey", "l_suppkey").agg(quantity.alias("quantity"), (F.max(money("l_quantity")) * 2).cast("double").alias("safety_stock"))
    rows = stock.join(velocity, "l_partkey", "left").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "left").join(s.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left")
    left = F.when((F.col("velocity") > 0) & (F.col("quantity") > 0), F.round(F.col("quantity") / F.col("velocity"), 1)).when(F.col("velocity").isNull() | (F.col("velocity") == 0), None).otherwise(0.0)
    alert = F.when(F.col("quantity") <= 0, "severe").when(F.col("quantity") <= F.col("safety_stock") * 0.5, "warning").when(F.col("quantity") <= F.col("safety_stock"), "watch").otherwise("normal")
    return rows.select("l_partkey", "l_suppkey", "p_brand", "s_name", "quantity", "safety_stock", "velocity", left.alias("days_left"), alert.alias("alert"))


def text_clean_documents(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.upper(F.trim("source")).alias("source"), F.lower("lang").alias("lang"), F.length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("long").alias("letters"))


QUERIES = {f.__name__: f for f in (
    rfm_segmentation, product_sales_daily, product_topn_daily, sales_dashboard_growth, store_performance, segment_share_of_total,
    latest_version_snapshot, daily_latest_version, order_detail_wide, customer_monthly_summary, promotion_effect, odd_even_multi_writer,
    date_spine, surrogate_keys, text_clean, text_clean_documents, tenure_months, day_features, inventory_alert)}

_D = "DECIMAL(18,2)"
_NET = f"l_extendedprice::{_D} * (1 - l_discount::{_D})"
ORACLE_SQL = {
    "rfm_segmentation": f"""
        WITH c AS (SELECT o_custkey, date_diff('day', max(o_orderdate)::DATE, DATE '{ETL_DATE}')::INT AS recency_days, count(*) AS frequency, sum(o_totalprice::{_D})::DOUBLE AS monetary
                   FROM orders WHERE o_orderdate < TIMESTAMP '{ETL_DATE}' GROUP BY 1),
        s AS (SELECT *, ntile(5) OVER (ORDER BY -recency_days, o_custkey)::INT AS r_score, ntile(5) OVER (ORDER BY frequency, o_custkey)::INT AS f_score, ntile(5) OVER (ORDER BY monetary, o_custkey)::INT AS m_score FROM c)
        SELECT *, r_score + f_score + m_score AS rfm_score,
               CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'high value' WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'keep' WHEN r_score >= 3 AND (f_score < 3 OR m_score < 3) THEN 'develop'
                    WHEN r_score < 3 AND f_score >= 3 AND m_score >= 3 THEN 'win back' WHEN r_score < 3 AND f_score < 3 AND m_score < 3 THEN 'at risk' WHEN f_score <= 2 AND r_score >= 3 AND m_score >= 3 THEN 'promising'
                    ELSE 'general' END AS segment FROM s""",
    "product_sales_daily": f"""
        SELECT l_partkey, l_shipdate::DATE AS stat_date, count(DISTINCT l_orderkey) AS order_count, sum(l_quantity::{_D})::DOUBLE AS sale_quantity, sum({_NET})::DOUBLE AS sale_amount
        FROM lineitem GROUP BY 1, 2 HAVING sum({_NET}) >= 0""",
    "product_topn_daily": f"""
        WITH s AS (SELECT l_shipdate::DATE AS stat_date, l_partkey, sum({_NET})::DOUBLE AS sale_amount FROM lineitem GROUP BY 1, 2),
        r AS (SELECT *, rank() OVER (PARTITION BY stat_date ORDER BY sale_amount DESC)::INT AS rank_num FROM s)
        SELECT stat_date, l_partkey, p_name, sale_amount, rank_num FROM r LEFT JOIN part ON l_partkey = p_partkey WHERE rank_num <= 10""",
    "sales_dashboard_growth": f"""
        WITH d AS (SELECT o_orderdate::DATE AS stat_date, count(*) AS total_orders, count(DISTINCT o_custkey) AS total_customers, sum(o_totalprice::{_D})::DOUBLE AS total_amount FROM orders GROUP BY 1),
        l AS (SELECT *, lag(total_orders) OVER (ORDER BY stat_date) AS po, lag(total_amount) OVER (ORDER BY stat_date) AS pa FROM d)
        SELECT stat_date, total_orders, total_customers, total_amount, (coalesce(round((total_orders - po) * 100.0::DOUBLE / nullif(po, 0), 2), 0) + 0.0)::DOUBLE AS order_growth,
               (coalesce(round((total_amount - pa) * 100.0::DOUBLE / nullif(pa, 0), 2), 0) + 0.0)::DOUBLE AS amount_growth, total_amount / total_orders AS avg_order_amount FROM l""",
    "store_performance": f"""
        WITH m AS (SELECT c_nationkey, strftime(o_orderdate, '%Y-%m') AS stat_month, count(*) AS total_orders, sum(o_totalprice::{_D})::DOUBLE AS total_amount, count(DISTINCT o_custkey) AS customer_count
                   FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
        s AS (SELECT *, coalesce(round(total_orders * 1.0::DOUBLE / nullif(max(total_orders) OVER w, 0) * 30.0::DOUBLE + total_amount * 1.0::DOUBLE / nullif(max(total_amount) OVER w, 0) * 40.0::DOUBLE
                     + customer_count * 1.0::DOUBLE / nullif(max(customer_count) OVER w, 0) * 30.0::DOUBLE, 2), 0.0) AS performance_score FROM m WINDOW w AS (PARTITION BY stat_month))
        SELECT c_nationkey, n_name, stat_month, total_orders, total_amount, customer_count, performance_score FROM s LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "segment_share_of_total": f"""
        SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, sum(c_acctbal::{_D})::DOUBLE AS balance,
               round(count(DISTINCT c_custkey) * 100.0::DOUBLE / sum(count(DISTINCT c_custkey)) OVER (), 2) AS share_pct FROM customer GROUP BY 1""",
    "latest_version_snapshot": "SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "daily_latest_version": "SELECT user_id, ts::DATE AS snapshot_date, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) = 1",
    "order_detail_wide": f"""
        SELECT l_orderkey, l_linenumber, o_custkey, p_brand, strftime(o_orderdate, '%Y-%m') AS order_month, ({_NET})::DOUBLE AS net_amount, ({_NET} - p_retailprice::{_D} * l_quantity::{_D})::DOUBLE AS gross_profit
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey""",
    "customer_monthly_summary": f"""
        WITH o AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, sum(o_totalprice::{_D})::DOUBLE AS amount FROM orders GROUP BY 1, 2),
        s AS (SELECT o_custkey, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
        SELECT o.*, coalesce(lines, 0) AS lines, coalesce(returned, 0) AS returned FROM o LEFT JOIN s USING (o_custkey, month)""",
    "promotion_effect": f"""
        SELECT CASE WHEN l_discount >= 0.05 THEN 'deep' WHEN l_discount > 0 THEN 'light' END AS promotion, count(DISTINCT l_orderkey) AS orders, sum(l_extendedprice::{_D})::DOUBLE AS gross,
               sum(l_extendedprice::{_D} * l_discount::{_D})::DOUBLE AS given, round(sum(l_extendedprice::{_D})::DOUBLE / nullif(sum(l_extendedprice::{_D} * l_discount::{_D})::DOUBLE, 0), 4) AS roi FROM lineitem GROUP BY 1""",
    "odd_even_multi_writer": f"SELECT o_custkey, count(*) AS orders, sum(o_totalprice::{_D})::DOUBLE AS amount FROM orders GROUP BY 1 HAVING sum(o_totalprice) IS NOT NULL",
    "date_spine": """
        SELECT day, year(day)::INT AS year, quarter(day)::INT AS quarter, month(day)::INT AS month, week(day)::INT AS week, dayofyear(day)::INT AS day_of_year, (dayofweek(day) + 1)::INT AS day_of_week, dayname(day) AS day_name, monthname(day) AS month_name,
               dayofweek(day) IN (0, 6) AS is_weekend, date_trunc('month', day)::DATE AS month_start, last_day(day) AS month_end, day AS made_date
        FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE AS day FROM orders)""",
    "surrogate_keys": """
        SELECT c_custkey, md5(concat_ws('||', coalesce(c_custkey::VARCHAR, '_null_'), coalesce(c_name, '_null_'), coalesce(c_mktsegment, '_null_'))) AS customer_sk, sha256(c_name) AS name_hash FROM customer""",
    "text_clean": "SELECT p_partkey, upper(trim(p_name)) AS name, lower(p_brand) AS brand, regexp_replace(p_type, '[^A-Za-z]', '', 'g') AS type_letters FROM part",
    "tenure_months": """
        WITH o AS (SELECT o_custkey, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders GROUP BY 1)
        SELECT *, ((year(last_day) * 12 + month(last_day)) - (year(first_day) * 12 + month(first_day)) - (day(last_day) < day(first_day))::INT)::INT AS tenure FROM o""",
    "day_features": """
        SELECT event_id, (dayofweek(ts) + 1)::INT AS day_of_week, hour(ts)::INT AS hour, dayofweek(ts) IN (0, 6) AS is_weekend,
               CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS day_part FROM events""",
    "inventory_alert": f"""
        WITH daily AS (SELECT l_partkey, l_shipdate::DATE AS stat_date, sum(l_quantity::{_D})::DOUBLE AS sold FROM lineitem
                       WHERE l_shipdate::DATE BETWEEN DATE '{ETL_DATE}' - 7 AND DATE '{ETL_DATE}' GROUP BY 1, 2),
        v AS (SELECT l_partkey, round(avg(sold), 2) AS velocity FROM daily GROUP BY 1),
        stock AS (SELECT l_partkey, l_suppkey, (sum(l_quantity::{_D}) - 50)::DOUBLE AS quantity, (max(l_quantity::{_D}) * 2)::DOUBLE AS safety_stock FROM lineitem GROUP BY 1, 2)
        SELECT l_partkey, l_suppkey, p_brand, s_name, quantity, safety_stock, velocity,
               CASE WHEN velocity > 0 AND quantity > 0 THEN round(quantity / velocity, 1) WHEN velocity IS NULL OR velocity = 0 THEN NULL ELSE 0.0::DOUBLE END AS days_left,
               CASE WHEN quantity <= 0 THEN 'severe' WHEN quantity <= safety_stock * 0.5::DOUBLE THEN 'warning' WHEN quantity <= safety_stock THEN 'watch' ELSE 'normal' END AS alert
        FROM stock LEFT JOIN v USING (l_partkey) LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""",
    "text_clean_documents": "SELECT doc_id, upper(trim(source)) AS source, lower(lang) AS lang, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS letters FROM documents",
}
