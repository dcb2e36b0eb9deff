"""Tile files: discovery, metadata, and reading in blocks of rows.

Tiles are read through an opener: a callable that takes a path and gives a
context manager with height, width, count, descriptions, transform (six numbers
or a grid's Affine), crs and read_rows(start, rows) -> bands x rows x columns.
The default one needs a raster library, which is imported where a tile is
opened.  A block of rows of one tile is the unit of work; blocks without a
wanted row are not read, and of the others only the wanted rows leave.
"""

from __future__ import annotations

import glob
import importlib
import sys
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# readers run in Python workers, which may not have the library on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 200
METADATA = "tile_idx int, path string, height int, width int, count int, names array<string>, a double, b double, c double, d double, e double, f double, crs string"
PIXELS = "tile_idx int, local_row int, local_col int, bands array<float>"


def find_tiles(folder: str, prefix: str) -> list[str]:
    """`prefix-*.tif` in lexicographic order, else `prefix.tif`, else none."""
    many = sorted(glob.glob(str(Path(folder) / f"{glob.escape(prefix)}-*.tif")))
    single = Path(folder) / f"{prefix}.tif"
    return many or ([str(single)] if single.exists() else [])


def find_mask(folder: str, prefix: str) -> list[str]:
    return find_tiles(folder, prefix) or sorted(glob.glob(str(Path(folder) / f"{glob.escape(prefix)}*.tif")))


def same_band_count(counts: list[int], expected: int) -> None:
    if bad := [n for n in counts if n != expected]:
        raise ValueError(f"a tile has {bad[0]} bands, not {expected}")


def _six(transform) -> tuple[float, ...]:
    return tuple(float(getattr(transform, n)) for n in "abcdef") if hasattr(transform, "a") else tuple(map(float, transform))


def metadata(spark: SparkSession, paths: list[str], opener: Callable | None = None) -> DataFrame:
    """A row for each tile, numbered from 1 in the order of the paths: size,
    band names (`band_n` where one has none), transform and coordinate system."""
    if not paths:
        raise FileNotFoundError("no tiles")
    open_ = opener or RasterTile
    sizes, numbers = [(n, pa.int32()) for n in ("height", "width", "count")], [(n, pa.float64()) for n in "abcdef"]
    schema = pa.schema([("tile_idx", pa.int32()), ("path", pa.string()), *sizes, ("names", pa.list_(pa.string())), *numbers, ("crs", pa.string())])

    def run(batches):
        for b in batches:
            for k, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open_(path) as tile:
                    described = list(tile.descriptions or []) + [None] * tile.count
                    names = [described[i] or f"band_{i + 1}" for i in range(tile.count)]
                    row = [k, path, tile.height, tile.width, tile.count, names, *_six(tile.transform), str(tile.crs)]
                yield pa.RecordBatch.from_arrays([pa.array([x], field.type) for x, field in zip(row, schema)], schema=schema)

    listed = spark.createDataFrame(list(enumerate(paths, 1)), "tile_idx int, path string").repartition(min(len(paths), 200))
    return listed.mapInArrow(run, METADATA)


def _batch(tile_idx: int, start: int, values: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Pixels of some of a block's rows (bands x rows x columns) as an Arrow batch."""
    bands, _, width = values.shape
    some = np.ascontiguousarray(values[:, rows, :].transpose(1, 2, 0), np.float32)
    n = len(rows) * width
    columns = [
        pa.array(np.full(n, tile_idx, np.int32)),
        pa.array(np.repeat(start + rows, width).astype(np.int32)),
        pa.array(np.tile(np.arange(width, dtype=np.int32), len(rows))),
        pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), pa.array(some.reshape(-1))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["tile_idx", "local_row", "local_col", "bands"])


def read_pixels(tiles: DataFrame, wanted: DataFrame | None = None, opener: Callable | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pixels of the tiles (a table of `metadata`): tile_idx, local_row, local_col, bands.

    wanted: tile_idx and local_row of the rows that are needed, of which there
    may be any number; a block without any is not read.
    """
    open_ = opener or RasterTile
    last = F.floor((F.col("height") - 1) / block_rows).cast("int")
    blocks = tiles.where("height > 0").select("tile_idx", "path", "height", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    if wanted is None:
        blocks = blocks.withColumn("rows", F.lit(None).cast("array<int>"))
    else:
        placed = wanted.select("tile_idx", F.floor(F.col("local_row") / block_rows).cast("int").alias("block"), (F.col("local_row") % block_rows).cast("int").alias("row"))
        rows = placed.groupBy("tile_idx", "block").agg(F.collect_set("row").alias("rows"))
        blocks = blocks.join(rows, ["tile_idx", "block"])

    def run(batches):
        for b in batches:
            for k, path, height, block, rows in zip(*(b.column(c).to_pylist() for c in range(5))):
                start = block * block_rows
                size = min(block_rows, height - start)
                with open_(path) as tile:
                    values = np.asarray(tile.read_rows(start, size))
                some = np.arange(size) if rows is None else np.array(sorted(r for r in rows if 0 <= r < size), int)
                for at in range(0, len(some), 16):
                    yield _batch(k, start, values, some[at : at + 16])

    return blocks.select("tile_idx", "path", "height", "block", "rows").repartition("tile_idx", "block").mapInArrow(run, PIXELS)


class RasterTile:
    """A tile behind a raster library, with what the readers need of it."""

    def __init__(self, path: str):
        import rasterio  # not needed elsewhere

        self.source = rasterio.open(path)
        for n in ("height", "width", "count", "descriptions", "transform", "crs"):
            setattr(self, n, getattr(self.source, n))

    def read_rows(self, start: int, rows: int):
        from rasterio.windows import Window

        return self.source.read(window=Window(0, start, self.width, rows))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.source.close()


class ArrayTile:
    """A tile in NumPy's archive format, with values (bands x rows x columns),
    transform, crs and names: for grids that come without a raster file."""

    def __init__(self, path: str):
        with np.load(path) as f:
            self.values, self.transform, self.crs = f["values"], tuple(f["transform"]), str(f["crs"])
            self.descriptions = [str(n) or None for n in f["names"]]
        self.count, self.height, self.width = self.values.shape

    @staticmethod
    def write(path: str, values, transform, crs: str = "EPSG:4326", names=None) -> str:
        with open(path, "wb") as f:
            np.savez(f, values=np.asarray(values), transform=np.array(transform, float), crs=crs, names=np.array([n or "" for n in names or [None] * len(values)]))
        return path

    def read_rows(self, start: int, rows: int):
        return self.values[:, start : start + rows]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        del self.values


# --- the same as a data source, for spark.read


class Block(InputPartition):
    def __init__(self, path: str, tile_idx: int, start: int, rows: int):
        self.path, self.tile_idx, self.start, self.rows = path, tile_idx, start, rows


class TileReader(DataSourceReader):
    def __init__(self, paths: list[str], opener: Callable | None = None):
        self.paths, self.open = paths, opener or RasterTile

    def partitions(self):
        out = []
        for k, path in enumerate(self.paths, 1):
            with self.open(path) as tile:
                height = tile.height
            out += [Block(path, k, start, min(BLOCK_ROWS, height - start)) for start in range(0, height, BLOCK_ROWS)]
        return out

    def read(self, block: Block):
        with self.open(block.path) as tile:
            values = np.asarray(tile.read_rows(block.start, block.rows))
        for at in range(0, block.rows, 16):
            yield _batch(block.tile_idx, block.start, values, np.arange(at, min(at + 16, block.rows)))


class TileSource(DataSource):
    """spark.read.format("tiles").option("paths", "a.tif,b.tif").load(); the
    option `opener` names another opener as module:callable."""

    @classmethod
    def name(cls):
        return "tiles"

    def schema(self):
        return PIXELS

    def reader(self, schema):
        opener = None
        if named := self.options.get("opener"):
            module, _, name = named.partition(":")
            opener = getattr(importlib.import_module(module), name)
        return TileReader(self.options["paths"].split(","), opener)


def read_tiles(spark: SparkSession, paths: list[str], opener: str | None = None) -> DataFrame:
    """All pixels of the tiles, through the data source."""
    if not paths:
        raise FileNotFoundError("no tiles")
    spark.dataSource.register(TileSource)
    reader = spark.read.format("tiles").option("paths", ",".join(paths))
    return (reader.option("opener", opener) if opener else reader).load()
