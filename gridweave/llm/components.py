"""Connected components of a graph that no machine need hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import checkpoint


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (columns a, b); component is the
    smallest id that can be reached.

    Alternates the large-star and small-star steps: each node's larger (then
    smaller) neighbours are tied to the smallest one known.  Neighbours are
    reduced to a minimum by partial aggregates, never gathered, so one node
    may have any number; the minima are written before they are joined, so that
    both sides are plain tables and Spark can split a hub's rows.  Null ids and
    self loops are ignored; no edges give no rows.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpoint(e)
    before = _signature(e)
    while True:
        both = e.union(e.select("v", "u"))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpoint(large)
        low = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = checkpoint(small.where("u != v").distinct())
        now = _signature(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
