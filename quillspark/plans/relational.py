"""Relational shapes that generated SQL asks for, on the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query, table

REVENUE = "l_extendedprice * (1 - l_discount)"


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS orders FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def rel_monthly_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1996-01-01'")
    return rows.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("orders"))


@query(f"SELECT date_trunc('week', l_shipdate)::TIMESTAMP AS week, round(sum({REVENUE}), 2)::DOUBLE AS revenue FROM lineitem GROUP BY 1")
def rel_weekly_revenue(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("week")).agg(F.round(F.sum(F.expr(REVENUE)), 2).cast("double").alias("revenue"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2)::DOUBLE AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 10")
def rel_top_customers(spark, sf_dir):
    total = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).cast("double").alias("total"))
    return total.orderBy(F.desc("total"), "o_custkey").limit(10)


@query("SELECT c_custkey, round(avg(o_totalprice), 4)::DOUBLE AS mean FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def rel_left_join_avg(spark, sf_dir):
    mean = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 4).cast("double").alias("mean"))
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(mean, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "mean")


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) > 10")
def rel_having(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders")).where("orders > 10")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(counts, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "orders")


@query(f"SELECT l_partkey, round(sum({REVENUE}), 2)::DOUBLE AS sales FROM lineitem GROUP BY 1 ORDER BY sales DESC, l_partkey LIMIT 5")
def rel_top_parts(spark, sf_dir):
    sales = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.sum(F.expr(REVENUE)), 2).cast("double").alias("sales"))
    return sales.orderBy(F.desc("sales"), "l_partkey").limit(5)


@query("SELECT n_name, count(*) AS customers, round(avg(c_acctbal), 4)::DOUBLE AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def rel_nation_balance(spark, sf_dir):
    by_nation = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return by_nation.groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).cast("double").alias("balance"))


@query("WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, round(sum(o_totalprice), 2)::DOUBLE AS total FROM orders GROUP BY 1) SELECT month, total, round(total / lag(total) OVER (ORDER BY month) - 1, 6) AS growth FROM m")
def rel_growth_rate(spark, sf_dir):
    """The window runs over one row per month."""
    months = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).cast("double").alias("total"))
    return months.withColumn("growth", F.round(F.col("total") / F.lag("total").over(W.orderBy("month")) - 1, 6))
