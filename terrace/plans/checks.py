"""Quality gates and comparisons of table versions, over lineitem, orders and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money
from ..operators import quality
from .sales import _D, table


def _changed(spark, d):
    """lineitem and a copy in which some prices are off, some rows are gone and some are doubled."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    price = F.when(F.col("l_orderkey") % 97 == 0, F.col("l_extendedprice") + 1).when(F.col("l_orderkey") % 89 == 0, F.col("l_extendedprice") + 0.001).otherwise(F.col("l_extendedprice"))
    other = li.where("l_orderkey % 101 <> 0").withColumn("l_extendedprice", price)
    return li, other


def balance_gate(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda flag: F.when(F.col("l_returnflag") == flag, money("l_extendedprice"))
    return quality.unbalanced(li, ["l_suppkey"], side("A"), side("R")).select("l_suppkey", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"))


def orphan_gate(spark, d):
    return quality.orphans(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", table(spark, d, "part").where("p_size > 5"), "p_partkey")


def aggregate_mismatch_gate(spark, d):
    again = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money("l_extendedprice")).cast("double").alias("o_totalprice"))
    return quality.aggregate_mismatch(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), again, ["o_orderkey"], ["o_totalprice"])


def count_compare(spark, d):
    a, b = _changed(spark, d)
    return quality.compare_counts(a, b)


def row_compare_multiset(spark, d):
    a, b = _changed(spark, d)
    return quality.compare_multisets(a, b)


def row_compare_keyed(spark, d):
    a, b = _changed(spark, d)
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    a, b = quality.dealt_alike(a, b, keys)
    first = lambda x: x.groupBy(*keys).agg(F.min("l_extendedprice").alias("l_extendedprice"))
    return quality.compare_keyed(first(a), first(b), keys).withColumn("columns", F.array_join("columns", ","))


def row_compare_positional(spark, d):
    a, b = _changed(spark, d)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    lines = lambda x: x.where("l_orderkey % 101 <> 0")  # noqa: E731  the copy lacks these orders
    return quality.compare_positions(lines(a), b, order).withColumn("columns", F.array_join("columns", ","))


def mismatch_counts(spark, d):
    return quality.column_counts(_mismatches(spark, d))


def _mismatches(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    other = o.withColumns({"o_totalprice": F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 5).otherwise(F.col("o_totalprice")), "o_orderstatus": F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))})
    return quality.compare_keyed(o, other, ["o_orderkey"])


def mismatch_details(spark, d):
    return quality.details(_mismatches(spark, d), ["o_orderkey"]).withColumn("columns", F.array_join("columns", ","))


def row_compare_repeated_keys(spark, d):
    """Versions with null and repeated keys: l_partkey isn't unique, and some keys are null."""
    a, b = _changed(spark, d)
    short = lambda x: x.select(F.expr("nullif(l_partkey % 500, 0)").alias("k"), "l_orderkey", "l_linenumber").where("l_orderkey % 50 < 3")
    return quality.compare_keyed(short(a), short(b).where("l_orderkey % 53 <> 0"), ["k"]).withColumn("columns", F.array_join("columns", ","))


def formatted_report(spark, d):
    return quality.formatted(table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("balance"), "c_mktsegment"))


def sampled_rows(spark, d):
    return quality.sampled(table(spark, d, "orders").select("o_totalprice", "o_orderkey", "o_custkey"), 50)


def comparison_verdict(spark, d):
    a, b = _changed(spark, d)
    n, rows = quality.compare_counts(a, b), quality.compare_multisets(a, b).agg(F.count(F.lit(1)).alias("n"))
    check = lambda ok, sampled: ok.select(F.lit(True).alias("required"), F.lit(True).alias("ran"), "passed", F.lit(sampled).alias("sampled"))
    return quality.verdict(check(n.select(F.col("equal").alias("passed")), False).union(check(rows.select((F.col("n") == 0).alias("passed")), True)))


def flat_checks(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(
        F.array(F.struct(F.lit("rows").alias("check_name"), F.count(F.lit(1)).alias("value")), F.struct(F.lit("customers").alias("check_name"), F.count_distinct("o_custkey").alias("value"))).alias("checks"))
    return quality.flat_checks(o)


QUERIES = {f.__name__: f for f in (balance_gate, orphan_gate, aggregate_mismatch_gate, count_compare, row_compare_multiset, row_compare_keyed, row_compare_positional,
    mismatch_counts, mismatch_details, row_compare_repeated_keys, formatted_report, sampled_rows, comparison_verdict, flat_checks)}

_CHANGED = """a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem),
        b AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice + 1 WHEN l_orderkey % 89 = 0 THEN l_extendedprice + 0.001::DOUBLE ELSE l_extendedprice END AS l_extendedprice
              FROM lineitem WHERE l_orderkey % 101 <> 0)"""
ORACLE_SQL = {
    "balance_gate": f"""
        SELECT * FROM (SELECT l_suppkey, sum(l_extendedprice::{_D}) FILTER (l_returnflag = 'A')::DOUBLE AS debit, sum(l_extendedprice::{_D}) FILTER (l_returnflag = 'R')::DOUBLE AS credit FROM lineitem GROUP BY 1)
        WHERE debit IS NULL OR credit IS NULL OR abs(debit - credit) > 1e-6""",
    "orphan_gate": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ANTI JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey",
    "aggregate_mismatch_gate": f"""
        SELECT o_orderkey, o_totalprice, again AS o_totalprice_again FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice::{_D})::DOUBLE AS again FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
        WHERE again IS NULL OR abs(o_totalprice - again) > 0.01""",
    "count_compare": f"WITH {_CHANGED} SELECT *, left_count = right_count AS equal FROM (SELECT (SELECT count(*) FROM a) AS left_count, (SELECT count(*) FROM b) AS right_count)",
    "row_compare_multiset": f"""
        WITH {_CHANGED} SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, sum(n)::BIGINT AS extra
        FROM (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY 1, 2, 3, 4 HAVING sum(n) <> 0""",
    "row_compare_keyed": f"""
        WITH {_CHANGED}, x AS (SELECT l_orderkey, l_linenumber, l_partkey, min(l_extendedprice) AS p FROM a GROUP BY 1, 2, 3), y AS (SELECT l_orderkey, l_linenumber, l_partkey, min(l_extendedprice) AS p FROM b GROUP BY 1, 2, 3)
        SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN y.p IS NULL THEN 'left' ELSE 'both' END AS side, 'l_extendedprice' AS columns
        FROM x LEFT JOIN y USING (l_orderkey, l_linenumber, l_partkey) WHERE y.p IS NULL OR abs(x.p - y.p) > 0.01""",
    "row_compare_positional": f"""
        WITH {_CHANGED}, x AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS position, * FROM a WHERE l_orderkey % 101 <> 0),
        y AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS position, * FROM b),
        z AS (SELECT x.position, concat_ws(',', CASE WHEN abs(x.l_extendedprice - y.l_extendedprice) > 0.01 THEN 'l_extendedprice' END, CASE WHEN x.l_linenumber <> y.l_linenumber THEN 'l_linenumber' END,
                     CASE WHEN x.l_orderkey <> y.l_orderkey THEN 'l_orderkey' END, CASE WHEN x.l_partkey <> y.l_partkey THEN 'l_partkey' END) AS columns FROM x JOIN y USING (position))
        SELECT position, 'both' AS side, columns FROM z WHERE columns <> ''""",
    "mismatch_counts": """SELECT 'o_totalprice' AS "column", count(*) AS mismatches FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'o_orderstatus', count(*) FROM orders WHERE o_orderkey % 5 = 0 AND o_orderstatus <> 'X'""",
    "mismatch_details": """SELECT o_orderkey, 'both' AS side, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'o_orderstatus' END, CASE WHEN o_orderkey % 7 = 0 THEN 'o_totalprice' END) AS columns
        FROM orders WHERE o_orderkey % 7 = 0 OR (o_orderkey % 5 = 0 AND o_orderstatus <> 'X') ORDER BY o_orderkey LIMIT 20""",
    "row_compare_repeated_keys": f"""
        WITH {_CHANGED}, x AS (SELECT nullif(l_partkey % 500, 0) AS k, l_orderkey AS o, l_linenumber AS l FROM a WHERE l_orderkey % 50 < 3), y AS (SELECT nullif(l_partkey % 500, 0) AS k, l_orderkey AS o, l_linenumber AS l FROM b WHERE l_orderkey % 50 < 3 AND l_orderkey % 53 <> 0),
        p AS (SELECT k, list(o || '/' || l ORDER BY o, l) AS r, count(*) AS n, min(o) AS o, min(l) AS l FROM x GROUP BY 1), q AS (SELECT k, list(o || '/' || l ORDER BY o, l) AS r, count(*) AS n, min(o) AS o, min(l) AS l FROM y GROUP BY 1),
        z AS (SELECT coalesce(p.k, q.k) AS k, CASE WHEN q.n IS NULL THEN 'left' WHEN p.n IS NULL THEN 'right' WHEN p.n > 1 OR q.n > 1 THEN 'repeated' ELSE 'both' END AS side,
                     CASE WHEN p.n = 1 AND q.n = 1 THEN concat_ws(',', CASE WHEN p.l <> q.l THEN 'l_linenumber' END, CASE WHEN p.o <> q.o THEN 'l_orderkey' END) WHEN p.n IS NULL OR q.n IS NULL THEN 'l_linenumber,l_orderkey' ELSE '' END AS columns FROM p FULL JOIN q ON p.k IS NOT DISTINCT FROM q.k WHERE p.r IS DISTINCT FROM q.r)
        SELECT * FROM z""",
    "formatted_report": "SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN printf('%.6f', c_acctbal) ELSE 'NULL' END AS balance, coalesce(c_mktsegment, 'NULL') AS c_mktsegment FROM customer",
    "sampled_rows": "SELECT o_totalprice, o_orderkey, o_custkey FROM orders ORDER BY ALL LIMIT 50",
    "comparison_verdict": f"WITH {_CHANGED} SELECT CASE WHEN (SELECT count(*) FROM a) <> (SELECT count(*) FROM b) OR EXISTS (SELECT 1 FROM a EXCEPT ALL SELECT 1 FROM b) THEN 'failed' ELSE 'passed_with_warnings' END AS status",
    "flat_checks": """WITH g AS (SELECT o_orderstatus AS name, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1)
        SELECT name, 0::BIGINT AS nth, 'rows' AS check_name, n AS value FROM g UNION ALL SELECT name, 1, 'customers', c FROM g""",
}
