"""The star schema's tables as observations, grid, scenes and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    return table(spark, folder, "lineitem").select(
        c("l_partkey").alias("pixel"), c("l_suppkey").alias("tile_idx"), "l_orderkey", "l_linenumber", c("l_shipdate").alias("ts"), c("l_quantity").alias("cloud"), c("l_returnflag").alias("cls"),
        c("l_tax").alias("b8"), c("l_discount").alias("b4"), (c("l_quantity") / 1000).alias("b2"), (c("l_quantity") / 100).alias("b3"), c("l_extendedprice").alias("b7"), c("l_quantity").alias("b5"),
    )


def grid(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("pixel"), F.floor(key / 50).cast("int").alias("grid_row"), (key % 50).cast("int").alias("grid_col"), F.col("p_size").alias("value"), F.concat(F.lit("zone"), (key % 3 + 1).cast("string")).alias("zone")
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.col("user_id").alias("pixel"), F.col("event_type").alias("index"), "ts", "value")


#: The same in SQL.
SQL = """
obs AS (SELECT l_partkey AS pixel, l_suppkey AS tile_idx, l_orderkey, l_linenumber, l_shipdate AS ts, l_quantity AS cloud, l_returnflag AS cls,
               l_tax AS b8, l_discount AS b4, l_quantity / 1000 AS b2, l_quantity / 100 AS b3, l_extendedprice AS b7, l_quantity AS b5 FROM lineitem),
pix AS (SELECT p_partkey AS pixel, CAST(p_partkey // 50 AS INT) AS grid_row, CAST(p_partkey % 50 AS INT) AS grid_col, p_size AS value,
               'zone' || CAST(p_partkey % 3 + 1 AS VARCHAR) AS zone FROM part),
evt AS (SELECT event_id, user_id AS pixel, event_type AS "index", ts, value FROM events)
"""
