"""Ingest of newly arrived year tables as a stream that ends with what is there."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType


def ingest_years(spark: SparkSession, source: str, schema: StructType, out: str, state: str) -> int:
    """Appends files under `source` that were not taken before to the table
    `out`, partitioned by zone and year; gives the number of new rows."""
    query = spark.readStream.schema(schema).parquet(source).writeStream.format("parquet").partitionBy("zone", "year").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
