"""Grids: masks, pixel ids, coordinates, tiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Affine:
    """x = c + col * a + row * b, y = f + col * d + row * e"""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float


def masked(cells: DataFrame, above: int = 0, value: str = "value") -> DataFrame:
    return cells.where(F.col(value) > above)


def masked_or_all(cells: DataFrame, mask: DataFrame | None, above: int = 0) -> DataFrame:
    """Cells under the mask; all of them, with a warning, if there is no mask.
    Raises if the mask leaves none."""
    if mask is None:
        import warnings

        warnings.warn("there is no mask; all pixels are kept", stacklevel=2)
        return cells
    kept = cells.join(masked(mask, above).select("zone", "grid_row", "grid_col").distinct(), ["zone", "grid_row", "grid_col"], "left_semi")
    if kept.isEmpty():
        raise ValueError("the mask matches no pixel")
    return kept


def assign_pixel_ids(cells: DataFrame) -> DataFrame:
    """pixel_id: rank of a cell by row and column within its zone, from 0.

    Ranks are local to a grid row; a running sum over the (few) rows of a grid
    gives where each begins, so no zone is sorted by one task.
    """
    counts = cells.groupBy("zone", "grid_row").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(Window.partitionBy("zone").orderBy("grid_row")) - F.col("n")).drop("n")
    local = F.row_number().over(Window.partitionBy("zone", "grid_row").orderBy("grid_col")) - 1
    return cells.withColumn("local", local).join(starts, ["zone", "grid_row"]).withColumn("pixel_id", (F.col("start") + F.col("local")).cast("long")).drop("start", "local")


def lon(t: Affine, row: Column, col: Column) -> Column:
    return t.c + (col + 0.5) * t.a + (row + 0.5) * t.b


def lat(t: Affine, row: Column, col: Column) -> Column:
    return t.f + (col + 0.5) * t.d + (row + 0.5) * t.e


def with_coords(cells: DataFrame, t: Affine, to_wgs84=None) -> DataFrame:
    """lon and lat of cell centres; `to_wgs84(df)` changes them if the grid has other coordinates."""
    out = cells.withColumns({"lon": lon(t, F.col("grid_row"), F.col("grid_col")), "lat": lat(t, F.col("grid_row"), F.col("grid_col"))})
    return to_wgs84(out) if to_wgs84 else out


def offset(origin: Column, reference: float, pixel: float, tolerance: float = 1e-6) -> Column:
    """Whole pixels between a tile's origin and the grid's; raises if they do not align."""
    d = (origin - reference) / pixel
    whole = F.rint(d)
    return F.when(F.abs(d - whole) > tolerance, F.raise_error(F.concat(F.lit("tile is not aligned with the grid: "), d.cast("string")))).otherwise(whole).cast("int")


def with_offsets(tiles: DataFrame, t: Affine, tolerance: float = 1e-6) -> DataFrame:
    return tiles.withColumns({"row_off": offset(F.col("f"), t.f, t.e, tolerance), "col_off": offset(F.col("c"), t.c, t.a, tolerance)})


def tile_number(row: Column, col: Column, height: int, width: int, per_row: int) -> Column:
    """Number of the tile of a regular tiling that holds a cell."""
    return (F.floor(row / height) * per_row + F.floor(col / width)).cast("long")


def join_tiles(cells: DataFrame, tiles: DataFrame, height: int, width: int) -> DataFrame:
    """Cells with each tile that covers them, and their place in it.

    Tiles (row_off, col_off, height, width) may overlap and stand anywhere.
    Each is listed under all cells of a coarse grid of `height` x `width` that
    it touches, so that the join is by equality and not all pairs are compared.
    """
    span = lambda off, size, step: F.sequence(F.floor(F.col(off) / step), F.floor((F.col(off) + F.col(size) - 1) / step))
    listed = tiles.withColumn("by", F.explode(span("row_off", "height", height))).withColumn("bx", F.explode(span("col_off", "width", width)))
    at = cells.withColumns({"by": F.floor(F.col("grid_row") / height), "bx": F.floor(F.col("grid_col") / width)})
    joined = at.join(listed, ["by", "bx"]).drop("by", "bx")
    place = {"local_row": F.col("grid_row") - F.col("row_off"), "local_col": F.col("grid_col") - F.col("col_off")}
    return joined.withColumns(place).where((F.col("local_row") >= 0) & (F.col("local_row") < F.col("height")) & (F.col("local_col") >= 0) & (F.col("local_col") < F.col("width")))


def row_block(row: Column, rows: int = 200) -> Column:
    return F.floor(row / rows).cast("int")


def chunk_number(pixel_id: Column, chunk: int = 500_000) -> Column:
    return F.floor(pixel_id / chunk).cast("int")


def resample_nearest(cells: DataFrame, coarse: DataFrame, factor: int) -> DataFrame:
    """The coarse mask's value under each cell; 0 outside it."""
    source = coarse.select("zone", F.col("grid_row").alias("src_row"), F.col("grid_col").alias("src_col"), F.col("value").alias("mask_value"))
    at = cells.withColumns({"src_row": F.floor(F.col("grid_row") / factor).cast("int"), "src_col": F.floor(F.col("grid_col") / factor).cast("int")})
    return at.join(source, ["zone", "src_row", "src_col"], "left").withColumn("mask_value", F.coalesce("mask_value", F.lit(0))).drop("src_row", "src_col")


def resample_affine(cells: DataFrame, target: Affine, source_cells: DataFrame, source: Affine, value: str = "value") -> DataFrame:
    """The source's value under each cell's centre, between any two affine grids
    of one coordinate system (rotated ones too): nearest cell; 0 outside and where
    the source has none."""
    x, y = lon(target, F.col("grid_row"), F.col("grid_col")), lat(target, F.col("grid_row"), F.col("grid_col"))
    whole = source.a * source.e - source.b * source.d
    col = F.floor((source.e * (x - source.c) - source.b * (y - source.f)) / whole).cast("int")
    row = F.floor((source.a * (y - source.f) - source.d * (x - source.c)) / whole).cast("int")
    under = source_cells.select("zone", F.col("grid_row").alias("src_row"), F.col("grid_col").alias("src_col"), F.col(value).alias("mask_value"))
    at = cells.withColumns({"src_row": row, "src_col": col})
    return at.join(under, ["zone", "src_row", "src_col"], "left").withColumn("mask_value", F.coalesce("mask_value", F.lit(0))).drop("src_row", "src_col")


def coverage(cells: DataFrame, above: int = 0) -> DataFrame:
    n = F.count_if(F.col("value") > above)
    return cells.groupBy("zone").agg(n.alias("n_masked"), F.count("*").alias("n_total"), F.round(n / F.count("*"), 6).alias("ratio"))
