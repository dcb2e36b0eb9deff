"""Long and wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_wide(long: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], value: str = "value") -> DataFrame:
    """A column for each of the listed names."""
    return long.groupBy(*keys).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def unpivot_long(wide: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "band", value: str = "value") -> DataFrame:
    """A row for each of the columns, nulls included."""
    return wide.unpivot(list(keys), list(columns), name, value)


def same_keys(coords: DataFrame, years: Sequence[DataFrame], keys: Sequence[str] = ("zone", "pixel_id")) -> None:
    """Raises unless all tables have the same keys, each once: one aggregation over all of them."""
    tables = [coords, *years]
    if len(tables) > 62:
        raise ValueError("at most 61 years")
    every = None
    for k, table in enumerate(tables):
        part = table.select(*keys, F.lit(1 << k).cast("long").alias("table"))
        every = part if every is None else every.union(part)
    seen = every.groupBy(*keys).agg(F.count("*").alias("n"), F.expr("bit_or(table)").alias("tables"))
    bad = seen.where((F.col("n") != len(tables)) | (F.col("tables") != (1 << len(tables)) - 1)).limit(1).collect()
    if bad:
        raise ValueError(f"pixels do not match: {bad[0].asDict()}")


def wide_merge(coords: DataFrame, years: Sequence[DataFrame], keys: Sequence[str] = ("zone", "pixel_id"), check: bool = True) -> DataFrame:
    """Coordinates with the columns of every year."""
    if check:
        same_keys(coords, years, keys)
    out = coords
    for year in years:
        out = out.join(year, list(keys), "left")
    return out


def merge(spark, folder: str, zone: str, first_year: int, last_year: int, out: str) -> dict:
    """The final table of a zone from its years; each is required."""
    from gridweave.operators.extract import completed, coords_path, year_path

    paths = [coords_path(folder, zone), *(year_path(folder, zone, y) for y in range(first_year, last_year + 1))]
    if missing := [p for p in paths if not completed(p, spark)]:
        raise FileNotFoundError(f"not there or not finished: {', '.join(missing)}")
    coords, *years = (spark.read.parquet(p) for p in paths)
    wide = wide_merge(coords.select("pixel_id", "lon", "lat"), years, ["pixel_id"])
    wide.repartitionByRange("pixel_id").sortWithinPartitions("pixel_id").write.mode("overwrite").parquet(out)
    table = spark.read.parquet(out)
    return {"n_pixels": table.count(), "n_cols": len(table.columns) - 3, "parquet_path": out}
