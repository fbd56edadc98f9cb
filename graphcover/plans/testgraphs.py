"""Graphs and covers made of the driver's tables, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs_in_order(spark, sf_dir, column):
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col(column).alias("src")).distinct()
    return own.join(own.withColumnRenamed("src", "dst"), "l_orderkey").filter("src < dst")


def copart(spark, sf_dir) -> DataFrame:
    """Parts that share an order."""
    return _pairs_in_order(spark, sf_dir, "l_partkey").select("src", "dst").distinct()


def cosupp(spark, sf_dir) -> DataFrame:
    """Suppliers that share orders: ``src, dst, w``."""
    return _pairs_in_order(spark, sf_dir, "l_suppkey").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def strong(spark, sf_dir) -> DataFrame:
    """Supplier pairs whose shared orders exceed the mean by over two deviations."""
    own = cosupp(spark, sf_dir)
    most = own.agg((F.avg("w") + 2 * F.stddev_pop("w")).alias("least"))
    return own.join(F.broadcast(most)).filter("w > least").select("src", "dst")


def common(spark, sf_dir) -> DataFrame:
    """Supplier pairs whose shared orders exceed the mean."""
    own = cosupp(spark, sf_dir)
    return own.join(F.broadcast(own.agg(F.avg("w").alias("least")))).filter("w > least").select("src", "dst")


def parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


def suppliers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))


def brands(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("comm_id"), F.col("p_partkey").alias("node"))


def types(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("comm_id"), F.col("p_partkey").alias("node"))


def supplier_nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("comm_id"), F.col("s_suppkey").alias("node"))


def planted(spark, sf_dir) -> DataFrame:
    """Customers of one nation, four pairs in five, and a few edges between nations.

    One small file makes many pairs, so its rows are dealt to more tasks than it has.
    """
    own = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("src"))
    inner = own.repartition(4 * spark.sparkContext.defaultParallelism, "src").join(own.withColumnRenamed("src", "dst"), "c_nationkey").filter("src < dst AND (src * 31 + dst * 17) % 10 < 8").select("src", "dst")
    n = own.agg(F.count(F.lit(1)).alias("n"))
    far = own.join(F.broadcast(n)).select("src", ((F.col("src") * 7 + 13) % F.col("n") + 1).alias("dst")).join(own.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
    return inner.unionByName(far)


def planted_truth(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("comm_id"), F.col("c_custkey").alias("node"))


_PAIRS = """
  SELECT a.k AS src, b.k AS dst, a.l_orderkey FROM (SELECT DISTINCT l_orderkey, {0} AS k FROM lineitem) a
  JOIN (SELECT DISTINCT l_orderkey, {0} AS k FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.k < b.k"""
COPART_SQL = f"copart AS (SELECT DISTINCT src, dst FROM ({_PAIRS.format('l_partkey')}))"
COSUPP_SQL = f"cosupp AS (SELECT src, dst, count(*) AS w FROM ({_PAIRS.format('l_suppkey')}) GROUP BY src, dst)"
STRONG_SQL = f"{COSUPP_SQL}, g AS (SELECT src, dst FROM cosupp WHERE w > (SELECT avg(w) + 2 * stddev_pop(w) FROM cosupp))"
COMMON_SQL = f"{COSUPP_SQL}, g AS (SELECT src, dst FROM cosupp WHERE w > (SELECT avg(w) FROM cosupp))"
