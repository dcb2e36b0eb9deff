"""A zone from its tile files to its final table: one function for every zone."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.bands import INDICES, year_columns
from gridweave.operators import extract, grid, merge
from gridweave.sources import tiles


@dataclass(frozen=True)
class ReferenceGrid:
    """The grid that a zone's pixels are counted on."""

    affine: grid.Affine
    crs: str
    height: int
    width: int
    names: tuple[str, ...]


def reference_grid(metadata: DataFrame) -> ReferenceGrid:
    """The smallest grid that holds all tiles, with the first tile's pixel size,
    coordinate system and band names.  Only a row of sums comes to the driver."""
    first = metadata.orderBy("tile_idx").limit(1)
    t = first.first()
    right, bottom = F.col("c") + F.col("width") * F.col("a"), F.col("f") + F.col("height") * F.col("e")
    box = metadata.agg(F.min("c").alias("west"), F.max("f").alias("north"), F.max(right).alias("east"), F.min(bottom).alias("south")).first()
    affine = grid.Affine(t["a"], t["b"], box["west"], t["d"], t["e"], box["north"])
    height, width = round((box["south"] - box["north"]) / t["e"]), round((box["east"] - box["west"]) / t["a"])
    return ReferenceGrid(affine, t["crs"], height, width, tuple(t["names"]))


def all_cells(spark: SparkSession, zone: str, height: int, width: int) -> DataFrame:
    rows = spark.range(height).select(F.col("id").cast("int").alias("grid_row"))
    return rows.select(F.lit(zone).alias("zone"), "grid_row", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("grid_col"))


def mosaic_cells(spark: SparkSession, paths: Sequence[str], opener: Callable | None = None) -> tuple[DataFrame, grid.Affine]:
    """grid_row, grid_col and value of the first band of some tiles, on their own
    grid; where tiles overlap, the first value that is no sentinel."""
    meta = tiles.metadata(spark, list(paths), opener)
    own = reference_grid(meta)
    placed = grid.with_offsets(meta, own.affine).select("tile_idx", "row_off", "col_off")
    pixels = tiles.read_pixels(meta, None, opener).join(F.broadcast(placed), "tile_idx")  # a row for each file
    value = extract.nodata_to_null(F.get("bands", F.lit(0)))
    cells = pixels.select("tile_idx", (F.col("row_off") + F.col("local_row")).alias("grid_row"), (F.col("col_off") + F.col("local_col")).alias("grid_col"), value.alias("value"))
    return extract.first_wins(cells, ["grid_row", "grid_col"], ["tile_idx"]), own.affine


def masked_pixels(spark: SparkSession, zone: str, own: ReferenceGrid, mask_paths: Sequence[str], opener: Callable | None = None) -> DataFrame:
    """zone, grid_row, grid_col and pixel_id of the grid's cells under the mask
    (nearest cell of the mask's own grid); of all cells, with a warning, if there
    is no mask.  Raises if the mask leaves none."""
    cells = all_cells(spark, zone, own.height, own.width)
    if not mask_paths:
        warnings.warn("there is no mask; all pixels are kept", stacklevel=2)
        return grid.assign_pixel_ids(cells)
    coarse, affine = mosaic_cells(spark, mask_paths, opener)
    under = grid.resample_affine(cells, own.affine, coarse.withColumn("zone", F.lit(zone)), affine)
    kept = under.where("mask_value > 0").drop("mask_value")
    if kept.isEmpty():
        raise ValueError("the mask matches no pixel")
    return grid.assign_pixel_ids(kept)


def year_pixels(spark: SparkSession, pixels: DataFrame, own: ReferenceGrid, paths: Sequence[str], opener: Callable | None = None) -> DataFrame:
    """zone, tile_idx, grid_row, grid_col and bands of the pixels that a year's tiles
    cover.  Raises if a tile has another number of bands or is not aligned."""
    meta = tiles.metadata(spark, list(paths), opener)
    same_or_raise = [r["count"] for r in meta.select("count").distinct().collect()]
    tiles.same_band_count(same_or_raise, len(own.names))
    placed = grid.with_offsets(meta, own.affine)
    sizes = meta.agg(F.max("height").alias("height"), F.max("width").alias("width")).first()
    at = grid.join_tiles(pixels.select("zone", "grid_row", "grid_col"), placed.select("tile_idx", "row_off", "col_off", "height", "width"), sizes["height"], sizes["width"])
    at = at.select("zone", "tile_idx", "grid_row", "grid_col", "local_row", "local_col")
    values = tiles.read_pixels(meta, at.select("tile_idx", "local_row").distinct(), opener)
    return values.join(at, ["tile_idx", "local_row", "local_col"]).select("zone", "tile_idx", "grid_row", "grid_col", "bands")


def run_extraction(
    spark: SparkSession,
    zone: str,
    raw: str,
    masks: str,
    out: str,
    prefix: str,
    mask_prefix: str,
    first_year: int,
    last_year: int,
    indices: Sequence[str] = INDICES,
    opener: Callable | None = None,
    to_wgs84: Callable[[DataFrame], DataFrame] | None = None,
) -> dict:
    """Coordinates and a table for each year of one zone, under `out`/zone=...

    The first year's tiles give the grid and the band names.  A year that is
    there already is skipped; one without tiles raises FileNotFoundError.
    """
    paths = {y: tiles.find_tiles(raw, f"{prefix}_{y}") for y in range(first_year, last_year + 1)}
    if missing := [y for y, found in paths.items() if not found]:
        raise FileNotFoundError(f"{zone}: no tiles in {raw} for {missing}")
    own = reference_grid(tiles.metadata(spark, paths[first_year], opener))
    pixels = grid.with_coords(masked_pixels(spark, zone, own, tiles.find_mask(masks, mask_prefix), opener), own.affine, to_wgs84)
    coords = extract.write_coords(pixels, out, zone)
    pixels = spark.read.parquet(coords).withColumn("zone", F.lit(zone))
    files = []
    for year in paths:
        path = extract.year_path(out, zone, year)
        if not extract.completed(path, spark):
            sampled = year_pixels(spark, pixels, own, paths[year], opener)
            extract.write_year(extract.sample_year(pixels, sampled, year_columns(list(own.names), year, indices)).drop("zone"), path)
        files.append(path)
    return {"n_pixels": pixels.count(), "checkpoint_dir": out, "coords_path": coords, "year_files": files}


def run_merge(spark: SparkSession, zone: str, folder: str, first_year: int, last_year: int, out: str) -> dict:
    return merge.merge(spark, folder, zone, first_year, last_year, out)


def export(long: DataFrame, path: str) -> None:
    """A long table (zone, year, ...) as files by zone and year; the zones and
    years that it has replace those that are there, all others stay."""
    long.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("zone", "year").parquet(path)
