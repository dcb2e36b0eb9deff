"""Extensions on pixel series: trend, neighbours, windows, buffers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def trend_slope(long: DataFrame, keys: Sequence[str] = ("pixel",), value: str = "value") -> DataFrame:
    """Least-squares slope by month of each pixel's series."""
    t = (F.col("year") * 12 + F.col("month")).cast("double")
    return long.groupBy(*keys).agg((F.round(F.regr_slope(F.col(value), t), 6) + 0.0).alias("slope"))


def queen_neighbours(cells: DataFrame, key: str = "pixel") -> DataFrame:
    """Pairs of cells of a zone that touch at an edge or a corner."""
    return _touching(cells, key, F.col(key).alias("neighbour"))


def _touching(cells: DataFrame, key: str, *of_neighbour: Column) -> DataFrame:
    """zone, key and the neighbours' columns, by equality on exploded places.

    Spark takes the exploded places for as few as the cells, and both for no
    more than their files' bytes; the hint keeps it from broadcasting either."""
    step = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]))
    reach = cells.withColumn("s", step).select("zone", F.col(key), (F.col("grid_row") + F.col("s.dr")).alias("grid_row"), (F.col("grid_col") + F.col("s.dc")).alias("grid_col"))
    joined = reach.hint("merge").join(cells.select("zone", "grid_row", "grid_col", *of_neighbour), ["zone", "grid_row", "grid_col"])
    return joined.drop("grid_row", "grid_col")


def spatial_lag(cells: DataFrame, value: str, key: str = "pixel") -> DataFrame:
    """Mean of each cell's neighbours."""
    return _touching(cells, key, F.col(value).alias("of_neighbour")).groupBy(key).agg(F.round(F.avg("of_neighbour"), 6).alias("lag"))


def lookback_windows(long: DataFrame, back: int = 36, ahead: int = 12, keys: Sequence[str] = ("pixel",), value: str = "value") -> DataFrame:
    """Series of `back` months with the `ahead` months after; complete windows only."""
    order = Window.partitionBy(*keys).orderBy("year", "month")
    out = long.withColumns({"past": F.collect_list(value).over(order.rowsBetween(1 - back, 0)), "future": F.collect_list(value).over(order.rowsBetween(1, ahead))})
    return out.where((F.size("past") == back) & (F.size("future") == ahead))


def within_km(a: DataFrame, b: DataFrame, km: float, box: tuple[float, float] | None = None) -> DataFrame:
    """Pairs (id_a, id_b) of points (id, lon, lat) within a distance; with a box,
    of those that are nearer than so many degrees of latitude and of longitude too.

    Points meet in cells of bands of latitude, which are as wide as a point
    reaches in that band, so a point has a few cells at any latitude; its reach
    is listed beyond 180 degrees on the other side too (without a box, which
    compares degrees as they are), and all around where it reaches a pole.
    Latitudes beyond a pole count on as angles.  Points without a place pair
    with none.
    """
    size = km / 111.0 * 1.01
    most = F.lit(360.0 if box is None else min(360.0, float(box[1])))
    band = F.floor(F.col("lat") / size)
    # degrees to the pole from the nearest place on a way between a point of the band and one that it reaches
    polar = lambda c: F.abs(F.pmod(c, F.lit(180.0)) - 90.0)
    left_over = polar((F.col("y") + 0.5) * size) - 2 * size
    reach = F.when(left_over <= 0.1, most).otherwise(F.least(most, size / F.sin(F.radians(F.greatest(left_over, F.lit(0.1))))))
    cell = lambda c: F.floor(c / F.col("wide"))
    span = lambda low, high: F.sequence(cell(low), cell(high))
    place = a.where("lon is not null and lat is not null").select(F.col("id").alias("id_a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"))
    left = place.withColumn("y", F.explode(F.sequence(F.floor((F.col("lat_a") - size) / size), F.floor((F.col("lat_a") + size) / size)))).withColumn("wide", reach)
    west, east = F.col("lon_a") - F.col("wide"), F.col("lon_a") + F.col("wide")
    if box is None:
        none = F.array().cast("array<bigint>")
        around = F.concat(
            span(F.greatest(west, F.lit(-180.0)), F.least(east, F.lit(180.0))),
            F.when(west < -180, span(F.greatest(west + 360, F.lit(-180.0)), F.lit(180.0))).otherwise(none),
            F.when(east > 180, span(F.lit(-180.0), F.least(east - 360, F.lit(180.0)))).otherwise(none),
        )
    else:
        around = span(west, east)
    left = left.withColumn("x", F.explode(F.array_distinct(around))).drop("wide")
    right = b.select(F.col("id").alias("id_b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"), band.alias("y")).withColumn("wide", reach)
    right = right.withColumn("x", cell(F.col("lon_b"))).drop("wide")
    h = F.pow(F.sin(F.radians(F.col("lat_b") - F.col("lat_a")) / 2), 2) + F.cos(F.radians("lat_a")) * F.cos(F.radians("lat_b")) * F.pow(F.sin(F.radians(F.col("lon_b") - F.col("lon_a")) / 2), 2)
    near = 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0)))) <= km
    if box is not None:
        near = near & (F.abs(F.col("lat_a") - F.col("lat_b")) < box[0]) & (F.abs(F.col("lon_a") - F.col("lon_b")) < box[1])
    return left.hint("merge").join(right, ["y", "x"]).where(near).select("id_a", "id_b")


def marks(log: DataFrame, by: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Microseconds since the mark before and since the first, in order of time."""
    order = Window.partitionBy(by).orderBy(ts, tie)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return log.withColumns({"since_last": micros(F.col(ts)) - micros(F.lag(ts).over(order)), "since_start": micros(F.col(ts)) - micros(F.first(ts).over(order))})
