"""Vintage rows derived from the order tables, so that every operator has input that grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.readers import table


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customer segment, nation and month."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    month = F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", month, "o_totalprice", "c_mktsegment", "c_nationkey", "c_custkey")


def vintage_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store rows: levels by source, adjustment, segment and month, in the prints (0,0), (1,0), (2,0) and (2,1)."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    base = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    last = F.col("l_linenumber") == 7
    rows = base.select(
        F.when(F.col("l_returnflag") == "R", "qcew").otherwise("ces").alias("source"),
        (F.col("l_returnflag") == "A").alias("seasonally_adjusted"),
        F.lit("national").alias("geographic_type"), F.lit("00").alias("geographic_code"), F.lit("supersector").alias("industry_type"),
        F.col("c_mktsegment").alias("industry_code"),
        F.date_add(F.trunc(F.col("o_orderdate").cast("date"), "MM"), 11).alias("ref_date"),
        F.when(last, 2).otherwise((F.col("l_linenumber") - 1) % 3).cast("int").alias("revision"),
        last.cast("int").alias("benchmark_revision"), "l_quantity",
    )
    lag = F.when(F.col("benchmark_revision") == 1, 13).otherwise(1 + F.col("revision"))
    keys = [c for c in rows.columns if c != "l_quantity"]
    return rows.groupBy(*keys).agg(F.sum("l_quantity").alias("employment")).withColumn("vintage_date", F.add_months("ref_date", lag))


#: The same rows in DuckDB's SQL, as common table expressions.
OBS_SQL = """
WITH base AS (
  SELECT CASE l.l_returnflag WHEN 'R' THEN 'qcew' ELSE 'ces' END AS source, (l.l_returnflag = 'A') AS seasonally_adjusted,
         c.c_mktsegment AS industry_code,
         make_date(CAST(year(o.o_orderdate) AS INT), CAST(month(o.o_orderdate) AS INT), 12) AS ref_date,
         CAST(CASE WHEN l.l_linenumber = 7 THEN 2 ELSE (l.l_linenumber - 1) % 3 END AS INT) AS revision,
         CAST(CASE WHEN l.l_linenumber = 7 THEN 1 ELSE 0 END AS INT) AS benchmark_revision, l.l_quantity
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey),
obs AS (
  SELECT source, seasonally_adjusted, 'national' AS geographic_type, '00' AS geographic_code, 'supersector' AS industry_type,
         industry_code, ref_date,
         CAST(ref_date + to_months(CAST(CASE WHEN benchmark_revision = 1 THEN 13 ELSE 1 + revision END AS INT)) AS DATE) AS vintage_date,
         revision, benchmark_revision, sum(l_quantity) AS employment
  FROM base GROUP BY ALL),
om AS (
  SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice, c_mktsegment, c_nationkey, c_custkey
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""
