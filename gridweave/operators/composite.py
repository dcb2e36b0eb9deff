"""Monthly composites of scenes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def in_box(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells of a rectangle, its edges included."""
    return df.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def meets_box(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Scenes (min_x, min_y, max_x, max_y) that intersect a rectangle."""
    return df.where((F.col("max_x") >= west) & (F.col("min_x") <= east) & (F.col("max_y") >= south) & (F.col("min_y") <= north))


def in_month(df: DataFrame, year: int, month: int, ts: str = "ts") -> DataFrame:
    """From the month's first instant to before the next month's; both bounds are constants, so the scan gets them."""
    after = (year + month // 12, month % 12 + 1)
    bound = lambda y, m: F.lit(f"{y:04d}-{m:02d}-01").cast("timestamp_ntz")
    return df.where((F.col(ts) >= bound(year, month)) & (F.col(ts) < bound(*after)))


def in_years(df: DataFrame, first: int, last: int, ts: str = "ts") -> DataFrame:
    """Calendar years, both included, as a range of time."""
    return df.where((F.col(ts) >= F.lit(f"{first:04d}-01-01").cast("timestamp_ntz")) & (F.col(ts) < F.lit(f"{last + 1:04d}-01-01").cast("timestamp_ntz")))


def clear_scenes(df: DataFrame, below: float = 20, cloud: str = "cloud") -> DataFrame:
    return df.where(F.col(cloud) < below)


def masked_by_class(value: Column, cls: Column, dropped: Sequence) -> Column:
    """The value, null for the dropped classes; the row stays."""
    return F.when(~F.coalesce(cls.isin(*dropped), F.lit(False)), value)


def calendar_grid(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    return years.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))


def monthly_median(obs: DataFrame, keys: Sequence[str] = ("pixel",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Median of the values of each pixel and month; masked (null) values do not count."""
    by = [*keys, F.year(ts).alias("year"), F.month(ts).alias("month")]
    return obs.groupBy(*by).agg(F.median(value).alias("value"))


def fill_calendar(composite: DataFrame, pixels: DataFrame, first_year: int, last_year: int, keys: Sequence[str] = ("pixel",)) -> DataFrame:
    """A row for each pixel and month of the calendar, null where there is no composite.

    The calendar has twelve rows a year; each pixel's months are made by a
    generator in its own row, not by a cross join.  Spark takes what a generator
    makes for no more than its input; where only months with a value are asked
    for, it would broadcast all of them, which the hint prevents."""
    months = F.explode(F.sequence(F.lit(first_year * 12), F.lit(last_year * 12 + 11)))
    grid = pixels.select(*keys, months.alias("m")).select(*keys, F.floor(F.col("m") / 12).cast("int").alias("year"), (F.col("m") % 12 + 1).cast("int").alias("month"))
    return grid.hint("merge").join(composite, [*keys, "year", "month"], "left")


def with_scene_metadata(composite: DataFrame) -> DataFrame:
    """Year and month of a composite with the month's first instant (UTC) in milliseconds."""
    start = F.make_timestamp("year", "month", F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    return composite.withColumn("time_start", F.unix_millis(start))


def lookup(composite: DataFrame, year: int, month: int, order: Sequence[str]) -> DataFrame:
    """The first row of that month."""
    return composite.where((F.col("year") == year) & (F.col("month") == month)).orderBy(*order).limit(1)
