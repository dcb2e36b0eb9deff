"""Tables in other formats: CSV, JSON lines, GeoJSON, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A table by the ending of its path.  CSV files have a header; without a
    schema their columns are strings, so that nothing is read twice."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("geojson",):
        return read_geojson(spark, path, schema)
    if kind in ("json", "jsonl", "ndjson"):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if kind == "csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    if kind == "parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    raise ValueError(f"no reader for {path}")


def read_geojson(spark: SparkSession, path: str, properties: str | StructType | None = None) -> DataFrame:
    """A row for each feature of a GeoJSON file or folder of such files: its
    geometry's type and coordinates (as JSON, since they nest by type), and its
    properties (a map of strings, or columns if a schema says which).  A file is
    one document and read by one task."""
    kind = "map<string,string>" if properties is None else (properties.simpleString() if isinstance(properties, StructType) else f"struct<{_fields(properties)}>")
    rows = spark.read.schema(f"features array<struct<geometry:struct<type:string,coordinates:string>,properties:{kind}>>").option("multiLine", True).json(path)
    found = rows.select(F.explode("features").alias("f")).select(F.col("f.geometry.type").alias("geometry"), F.col("f.geometry.coordinates").alias("coordinates"), "f.properties")
    return found if properties is None else found.select("geometry", "coordinates", "properties.*")


def _fields(ddl: str) -> str:
    return ", ".join(f"{part.strip().split(None, 1)[0]}:{part.strip().split(None, 1)[1]}" for part in ddl.split(","))
