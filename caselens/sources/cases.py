"""The case view: the roles of a reviewed case projected from star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

BASE_YEAR = 1995


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def threshold(period):
    return (1000 + 100 * (period - BASE_YEAR)).cast("double")


def cases(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """One row per case, with a key, group, period, weight, base, status, amount and
    finding codes; ``err`` is the amount where it is an official error, else 0.

    Dimensions are small against the fact table, but none is hinted: Spark
    broadcasts those whose files are under its threshold and shuffles the rest.
    With ``parts`` the lines are dealt by order into so many.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    line = line.repartition(parts, "l_orderkey") if parts else line
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("grp"))
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    # Narrow tables meet first: lines, the widest rows, are shuffled once at most, by order.
    placed = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = line.join(placed, line["l_orderkey"] == placed["o_orderkey"])
    out = joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("case_id"),
        "grp",
        "region",
        F.col("c_nationkey").cast("int").alias("grp_no"),
        F.year("o_orderdate").cast("int").alias("period"),
        F.month("o_orderdate").cast("int").alias("month"),
        F.col("l_orderkey").cast("long").alias("orderkey"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.col("l_partkey").cast("long").alias("part"),
        F.col("l_suppkey").cast("long").alias("supp"),
        F.col("l_quantity").alias("weight"),
        F.col("l_extendedprice").alias("base"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("score"),
        F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 3).otherwise(1).alias("status"),
        (F.col("l_extendedprice") * (F.col("l_discount") + F.col("l_tax")) * (F.lit(0.6) + F.lit(0.4) * (F.col("c_nationkey") % 5))).alias("amount"),
        (F.col("l_suppkey") % 27).cast("int").alias("agency1"),
        F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_partkey") % 27).cast("int")).alias("agency2"),
    )
    out = out.withColumn("err", F.when(S.counted(F.col("status"), F.col("amount"), threshold(F.col("period"))), F.col("amount")).otherwise(0.0))
    signed = F.when(F.col("status") == 2, F.col("amount")).when(F.col("status") == 3, -F.col("amount")).otherwise(0.0)
    return out.withColumn("deviation", signed)


CASES_SQL = """
cases0 AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS case_id,
    n_name AS grp, r_name AS region, CAST(c_nationkey AS INTEGER) AS grp_no,
    CAST(year(o_orderdate) AS INTEGER) AS period, CAST(month(o_orderdate) AS INTEGER) AS month,
    CAST(l_orderkey AS BIGINT) AS orderkey, CAST(l_linenumber AS INTEGER) AS line, CAST(l_partkey AS BIGINT) AS part, CAST(l_suppkey AS BIGINT) AS supp,
    l_quantity AS weight, l_extendedprice AS base, l_discount AS discount, l_tax AS score,
    CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 3 ELSE 1 END AS status,
    l_extendedprice * (l_discount + l_tax) * (CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE) * (c_nationkey % 5)) AS amount,
    CAST(l_suppkey % 27 AS INTEGER) AS agency1,
    CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey % 27 AS INTEGER) END AS agency2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cases AS (
  SELECT *, CASE WHEN status IN (2, 3) AND amount > 1000 + 100 * (period - 1995) THEN amount ELSE CAST(0 AS DOUBLE) END AS err,
    CASE status WHEN 2 THEN amount WHEN 3 THEN -amount ELSE CAST(0 AS DOUBLE) END AS deviation
  FROM cases0)"""
