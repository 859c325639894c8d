"""The driver's tables, and what they stand in for.

A call is an order; its seller and product are the least supplier and part of its lines; an analysed call
is one with lines; a dimension score is a line's quantity, its weight the discount. The values do not mean
what the names say: these tables exercise the operators' shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("call_id"), F.concat("l_returnflag", "l_linestatus").alias("dimension"), F.col("l_quantity").alias("score"), F.col("l_discount").alias("weight"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = {"seller_id": F.min("l_suppkey"), "product_id": F.min("l_partkey")}
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("__call")).agg(*(c.alias(n) for n, c in who.items()))
    return _call_rows(table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("__call"), "left"))


def _call_rows(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("customer_id"), "seller_id", "product_id", F.col("o_orderdate").cast("date").alias("call_date"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("quality"), F.col("o_totalprice").alias("value"), *more)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, overall_score, failures) of analysed calls."""
    return dims(spark, sf_dir).groupBy("call_id").agg(F.avg("score").alias("overall_score"), F.array_sort(F.collect_set(F.when(F.col("score") < 10, F.col("dimension")))).alias("failures"))


def scored_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysed calls with their results, from one aggregate over the lines."""
    kind = F.concat("l_returnflag", "l_linestatus")
    made = {"seller_id": F.min("l_suppkey"), "product_id": F.min("l_partkey"), "overall_score": F.avg("l_quantity"), "failures": F.array_sort(F.collect_set(F.when(F.col("l_quantity") < 10, kind)))}
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("__call")).agg(*(c.alias(n) for n, c in made.items()))
    return _call_rows(table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("__call")), "overall_score", "failures")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), "turn", F.col("role").alias("speaker"), "text")


#: The same in SQL, before a query's own text.
PRELUDE = """
WITH dims AS (SELECT l_orderkey AS call_id, l_returnflag || l_linestatus AS dimension, l_quantity AS score, l_discount AS weight FROM lineitem),
calls AS (
  SELECT o_orderkey AS call_id, o_custkey AS customer_id, seller_id, product_id, CAST(o_orderdate AS DATE) AS call_date,
         o_orderstatus AS status, o_orderpriority AS quality, o_totalprice AS value
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS seller_id, min(l_partkey) AS product_id FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
results AS (
  SELECT call_id, avg(score) AS overall_score,
         coalesce(list_sort(list_distinct(list(dimension) FILTER (WHERE score < 10))), []) AS failures FROM dims GROUP BY call_id),
scored AS (SELECT * FROM calls JOIN results USING (call_id))
"""
