"""Views over the driver tables in the shapes that the operators take; the same rows come from SQL_VIEWS in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..operators.similarity import centred
from ..operators.sequences import numbered


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def strips(spark: SparkSession, d: str) -> DataFrame:
    e = F.expr
    rows = table(spark, d, "lineitem").select(
        e("l_orderkey div 8").alias("figure"), e("chr(cast(65 + l_orderkey % 6 as int))").alias("panel"),
        e("case l_returnflag when 'A' then 'TBK1' when 'R' then 'STING' end").alias("row_label"), e("case when l_linestatus = 'O' then l_linenumber end").alias("row_index"),
        e("cast(l_partkey % 200 as int)").alias("x0"), e("cast(l_orderkey % 120 as int)").alias("y0"), e("18 + cast(l_quantity as int)").alias("w"), e("12 + l_linenumber").alias("h"),
        e("l_partkey % 500").alias("vec_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return numbered(rows, ["figure"], keys, "sid").drop(*keys)


def boxes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return strips(spark, d).select("figure", F.col("sid").alias("id"), box(c("x0"), c("y0"), c("x0") + c("w"), c("y0") + c("h")).alias("box"))


def words(spark: SparkSession, d: str) -> DataFrame:
    e = F.expr
    return table(spark, d, "orders").select(
        e("o_orderkey div 8").alias("figure"), e("o_orderpriority").alias("text"), e("cast(cast(floor(o_totalprice) as bigint) % 100 as double)").alias("conf"),
        box(e("o_custkey % 200"), e("o_orderkey % 120"), e("o_custkey % 200 + 20"), e("o_orderkey % 120 + 8")).alias("wbox"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", centred(F.col("embedding").cast("array<double>")).alias("v"))


def profile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.expr("datediff(l_shipdate, date'1992-01-01') div 7").alias("bin")).groupBy("key", "bin").agg(F.count("*").alias("value"))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    days = F.expr("datediff(l_shipdate, date'1990-01-01')")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), days.alias("x0"), (days + F.col("l_quantity").cast("int")).alias("x1"))


SQL_VIEWS = """
WITH strips AS (SELECT *, row_number() OVER (PARTITION BY figure ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS sid FROM (
    SELECT l_orderkey // 8 AS figure, chr(CAST(65 + l_orderkey % 6 AS INT)) AS panel, CASE l_returnflag WHEN 'A' THEN 'TBK1' WHEN 'R' THEN 'STING' END AS row_label,
           CASE WHEN l_linestatus = 'O' THEN l_linenumber END AS row_index, l_partkey % 200 AS x0, l_orderkey % 120 AS y0, 18 + CAST(trunc(l_quantity) AS INT) AS w, 12 + l_linenumber AS h,
           l_partkey % 500 AS vec_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)),
boxes AS (SELECT figure, sid AS id, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM strips),
words AS (SELECT o_orderkey // 8 AS figure, o_orderpriority AS text, CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) AS conf,
          o_custkey % 200 AS wx0, o_orderkey % 120 AS wy0, o_custkey % 200 + 20 AS wx1, o_orderkey % 120 + 8 AS wy1 FROM orders),
profile AS (SELECT l_suppkey AS key, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 7 AS bin, count(*) AS value FROM lineitem GROUP BY ALL),
intervals AS (SELECT l_partkey AS key, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS x0, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(trunc(l_quantity) AS INT) AS x1 FROM lineitem)
"""
