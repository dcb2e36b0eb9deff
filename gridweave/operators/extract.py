"""From tiles to one row for each masked pixel and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODATA = -9999.0


def nodata_to_null(value: Column, nodata: float = NODATA) -> Column:
    """Null for the sentinel and for NaN."""
    return F.when((value == nodata) | F.isnan(value), None).otherwise(value)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Of overlapping tiles the last one's value, even if it is null."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Of overlapping tiles the first value that is not null."""
    return df.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))


def left_fill(pixels: DataFrame, sampled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every pixel, null where no tile covers it."""
    return pixels.join(sampled, list(keys), "left")


def sample_year(pixels: DataFrame, tile_pixels: DataFrame, bands: dict[int, str]) -> DataFrame:
    """zone, pixel_id and a column for each band of one year.

    pixels: zone, pixel_id, grid_row, grid_col.  tile_pixels: zone, tile_idx,
    grid_row, grid_col, bands (array).  Only the wanted bands leave the array.
    """
    cell = ["zone", "grid_row", "grid_col"]
    # the winner's bands are taken together; a null within them wins too
    won = tile_pixels.join(pixels.select(*cell), cell, "left_semi").groupBy(*cell).agg(F.max_by("bands", "tile_idx").alias("bands"))
    columns = [nodata_to_null(F.get("bands", F.lit(k))).cast("float").alias(name) for k, name in bands.items()]
    return pixels.join(won, cell, "left").select("zone", "pixel_id", *columns)


def completed(df_path: str, spark) -> bool:
    """Whether a written table was finished."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{df_path}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_year(year: DataFrame, path: str) -> bool:
    """Write a year's table unless it is there; whether it was written."""
    if completed(path, year.sparkSession):
        return False
    year.repartitionByRange("pixel_id").sortWithinPartitions("pixel_id").write.mode("overwrite").parquet(path)
    return True


def coords_path(out: str, zone: str) -> str:
    return f"{out}/zone={zone}/coords"


def year_path(out: str, zone: str, year: int) -> str:
    return f"{out}/zone={zone}/year={year}"


def write_coords(pixels: DataFrame, out: str, zone: str) -> str:
    """Coordinates and grid places of a zone's pixels, without its name (the path has it)."""
    path = coords_path(out, zone)
    one = pixels.where(F.col("zone") == zone).drop("zone")
    one.repartitionByRange("pixel_id").sortWithinPartitions("pixel_id").write.mode("overwrite").parquet(path)
    return path


def extract(pixels: DataFrame, tiles_by_year: dict[int, tuple[DataFrame, Sequence[str]]], out: str, indices: Sequence[str]) -> dict:
    """Coordinates and a table for each zone and year under `out`; years that are
    there already are skipped.  Zones are named by the pixels (a few names)."""
    from gridweave.functions.bands import year_columns

    zones = sorted(r["zone"] for r in pixels.select("zone").distinct().collect())
    coords = {z: write_coords(pixels, out, z) for z in zones}
    files = []
    for year, (tile_pixels, names) in sorted(tiles_by_year.items()):
        for zone in zones:
            of = lambda df: df.where(F.col("zone") == zone)  # noqa: E731, B023
            files.append(year_path(out, zone, year))
            write_year(sample_year(of(pixels), of(tile_pixels), year_columns(names, year, indices)).drop("zone"), files[-1])
    return {"n_pixels": pixels.count(), "checkpoint_dir": out, "coords_paths": coords, "year_files": files}
