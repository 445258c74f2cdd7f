"""The same shapes at volume, over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.plans.facts import table
from meterlake.plans.registry import query


@query("""SELECT n_name AS nation, c_mktsegment AS segment, count(*) AS lines, count(DISTINCT o_orderkey) AS orders, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def volume_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are summed to orders before the joins: the large table is shuffled once, already reduced."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    rows = orders.join(lines, "o_orderkey").join(customers, "c_custkey").join(F.broadcast(nations), "n_nationkey")
    return rows.groupBy("nation", "segment").agg(F.sum("lines").alias("lines"), F.count("*").alias("orders"), F.sum("quantity").alias("quantity"), F.sum("returned").alias("returned"))


@query("""SELECT l_suppkey AS supplier, l_orderkey AS first_order FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) = 1""")
def volume_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("first_order")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(first)


@query("""SELECT o_custkey AS customer, o_orderkey AS order_key, o_orderdate AS placed_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def volume_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_key"), F.col("o_orderdate").alias("placed_at")).orderBy(F.desc("placed_at"), "order_key").limit(50)


@query("""WITH d AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT month, priority, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY month) AS DOUBLE) AS share FROM d""")
def volume_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("month")).cast("double"))
