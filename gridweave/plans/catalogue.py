"""The queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions import bands, indices
from gridweave.operators import audit, composite, extract, grid, merge, render, trend
from gridweave.sources.tables import SQL as VIEWS
from gridweave.sources.tables import events, observations, table
from gridweave.sources.tables import grid as pixels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AFFINE = grid.Affine(0.5, 0.0, -46.0, 0.0, -0.5, -1.0)
ABOVE, FIRST, LAST = 25, 1995, 2001
BAND_NAMES = ["NDVI_2018_07", "0_NDVI_2018_07", "NDVI_2018_071", "NDVI_2018_13", "XEVI_2019_01_NDVI_2020_02", "QA60", "ndvi_2018_07", "NDVI_18_07", "band_3", ""]
ND = "(b8 - b4) / nullif(b8 + b4, 0)"
#: Monthly composite of the observations: clear scenes, masked class, median index.
MEDIAN_SQL = f"""med AS (SELECT pixel, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, median(CASE WHEN cls NOT IN ('R') THEN {ND} END) AS value
  FROM obs WHERE cloud < 20 GROUP BY ALL)"""
MASKED_SQL = "cells AS (SELECT * FROM pix WHERE value > 25), ids AS (SELECT zone, pixel, grid_row, grid_col, row_number() OVER (PARTITION BY zone ORDER BY grid_row, grid_col) - 1 AS pixel_id FROM cells)"
COORDS_SQL = "-46.0 + (grid_col + 0.5) * 0.5 + (grid_row + 0.5) * 0.0 AS lon, -1.0 + (grid_col + 0.5) * 0.0 + (grid_row + 0.5) * -0.5 AS lat"
#: All months of all masked pixels of a zone, null where nothing was observed.
LONG_SQL = f"""{MEDIAN_SQL}, {MASKED_SQL},
long AS (SELECT i.zone, i.pixel_id, i.pixel, c.year, c.month, med.value FROM ids i
  CROSS JOIN (SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM (SELECT unnest(range(1995, 2002)) AS y), (SELECT unnest(range(1, 13)) AS m)) c
  LEFT JOIN med ON med.pixel = i.pixel AND med.year = c.year AND med.month = c.month)"""


def query(sql: str | None):
    """Registers a function under its name, with its SQL after the views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            ORACLES[f.__name__] = f"WITH {VIEWS.strip()}, {text[5:]}" if text.startswith("WITH ") else f"WITH {VIEWS.strip()} {text}"
        return f

    return add


def _composite(spark, d) -> DataFrame:
    obs = composite.clear_scenes(observations(spark, d))
    value = composite.masked_by_class(indices.ndvi(F.col("b8"), F.col("b4")), F.col("cls"), ["R"])
    return composite.monthly_median(obs.withColumn("value", value))


def _ids(spark, d) -> DataFrame:
    return grid.assign_pixel_ids(grid.masked(pixels(spark, d), ABOVE)).select("zone", "pixel", "grid_row", "grid_col", "pixel_id")


def _filled(spark, d) -> DataFrame:
    own = _ids(spark, d)
    months = composite.fill_calendar(_composite(spark, d), own, FIRST, LAST)
    return months.join(own.select("pixel", "zone", "pixel_id"), "pixel")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Scenes to composites to a filled pixel table to its audit by zone."""
    return audit.summary(_filled(spark, d))


# --- sources and projections


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem")
def scan_parquet(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("SELECT count(*) AS n_rows, CAST(11 AS INT) AS n_cols, CAST(ceil(count(*) / 10000) AS BIGINT) AS n_chunks FROM lineitem")
def table_profile(spark, d):
    t = table(spark, d, "lineitem")
    return t.agg(F.count("*").alias("n_rows"), F.lit(len(t.columns)).alias("n_cols"), F.ceil(F.count("*") / 10000).alias("n_chunks"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / 10000 AS reflectance FROM lineitem")
def reflectance_scale(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", indices.reflectance(F.col("l_extendedprice")).alias("reflectance"))


def _of_bands(spark, d, value):
    return observations(spark, d).select("pixel", "tile_idx", "ts", F.round(value, 9).alias("value"))


@query(f"SELECT pixel, tile_idx, ts, round({ND}, 9) AS value FROM obs")
def index_ndvi(spark, d):
    return _of_bands(spark, d, indices.ndvi(F.col("b8"), F.col("b4")))


@query("SELECT pixel, tile_idx, ts, round(2.5 * (b8 - b4) / nullif(b8 + 6 * b4 - 7.5 * b2 + 1, 0), 9) AS value FROM obs")
def index_evi(spark, d):
    return _of_bands(spark, d, indices.evi(F.col("b8"), F.col("b4"), F.col("b2")))


@query("SELECT pixel, tile_idx, ts, round(b7 / nullif(b5, 0) - 1, 9) AS value FROM obs")
def index_cire(spark, d):
    return _of_bands(spark, d, indices.cire(F.col("b7"), F.col("b5")))


@query("SELECT pixel, tile_idx, ts, round((b3 - b8) / nullif(b3 + b8, 0), 9) AS value FROM obs")
def index_ndwi(spark, d):
    return _of_bands(spark, d, indices.ndwi(F.col("b3"), F.col("b8")))


@query("SELECT DISTINCT 'NDVI_' || CAST(year(ts) AS VARCHAR) || '_' || lpad(CAST(month(ts) AS VARCHAR), 2, '0') AS band FROM obs")
def band_rename(spark, d):
    return observations(spark, d).select(bands.band_name(F.lit("NDVI"), F.year("ts"), F.month("ts")).alias("band")).distinct()


_NAMES_SQL = ", ".join(f"('{n}')" for n in BAND_NAMES)
_PATTERN = bands.band_pattern()


@query(f"""SELECT name, nullif(regexp_extract(name, '{_PATTERN}', 1), '') AS "index", CAST(nullif(regexp_extract(name, '{_PATTERN}', 2), '') AS INT) AS year,
  CAST(nullif(regexp_extract(name, '{_PATTERN}', 3), '') AS INT) AS month FROM (VALUES {_NAMES_SQL}) t(name)""")
def band_parse(spark, d):
    return spark.createDataFrame([(n,) for n in BAND_NAMES], "name string").select("name", *bands.parse_band(F.col("name")))


@query("SELECT i, coalesce(nullif(d, ''), 'band_' || CAST(i AS VARCHAR)) AS name FROM (VALUES (1, 'NDVI_2018_01'), (2, NULL), (3, '')) t(i, d)")
def band_name_fallback(spark, d):
    return spark.createDataFrame([(1, "NDVI_2018_01"), (2, None), (3, "")], "i int, d string").select("i", bands.band_or_number(F.col("d"), F.col("i")).alias("name"))


@query("SELECT CAST(row_number() OVER (ORDER BY n) AS INT) AS place, n AS name FROM (SELECT DISTINCT 'NDVI_' || strftime(ts, '%Y_%m') AS n FROM obs)")
def ndvi_columns(spark, d):
    names = [r["band"] for r in band_rename(spark, d).collect()]
    wide = spark.createDataFrame([], ", ".join(f"`{n}` float" for n in ["pixel_id", "EVI_1995_01", *names]))
    return spark.createDataFrame(list(enumerate(bands.columns_of(wide), 1)), "place int, name string")


@query("SELECT CAST(l_linenumber AS INT) AS i, label, count(*) AS n, count(*) FILTER (v < 0.3) AS below FROM (SELECT 0 AS l_linenumber, label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY ALL")
def float32_widen(spark, d):
    v = table(spark, d, "embeddings").select("label", F.explode("embedding").alias("v"))
    return v.groupBy(F.lit(0).alias("i"), "label").agg(F.count("*").alias("n"), F.count_if(F.col("v").cast("double") < 0.3).alias("below"))


# --- filters


_SCENES_SQL = "scenes AS (SELECT s_suppkey AS scene, -46.0 + s_suppkey % 40 AS min_x, -46.0 + s_suppkey % 40 + 1.5 AS max_x, -30.0 + s_suppkey % 29 AS min_y, -30.0 + s_suppkey % 29 + 1.5 AS max_y FROM supplier)"


@query(f"WITH {_SCENES_SQL} SELECT scene, min_x, min_y, max_x, max_y FROM scenes WHERE max_x >= -40 AND min_x <= -30 AND max_y >= -12 AND min_y <= -2")
def scene_bounds_filter(spark, d):
    """Scenes whose box meets a rectangle."""
    x, y = -46.0 + F.col("s_suppkey") % 40, -30.0 + F.col("s_suppkey") % 29
    scenes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("scene"), x.alias("min_x"), y.alias("min_y"), (x + 1.5).alias("max_x"), (y + 1.5).alias("max_y"))
    return composite.meets_box(scenes, -40, -12, -30, -2)


@query(f"SELECT * FROM (SELECT pixel, {COORDS_SQL} FROM pix) WHERE lon BETWEEN -40 AND -30 AND lat BETWEEN -12 AND -2")
def bbox_filter(spark, d):
    return composite.in_box(grid.with_coords(pixels(spark, d), AFFINE), -40, -12, -30, -2).select("pixel", "lon", "lat")


@query("SELECT pixel, tile_idx, ts FROM obs WHERE ts >= TIMESTAMP '1997-12-01' AND ts < TIMESTAMP '1998-01-01'")
def month_range_filter(spark, d):
    return composite.in_month(observations(spark, d), 1997, 12).select("pixel", "tile_idx", "ts")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1998")
def calendar_year_filter(spark, d):
    return composite.in_years(table(spark, d, "orders"), 1997, 1998, "o_orderdate").select("o_orderkey", "o_orderdate")


@query("SELECT pixel, tile_idx, ts, cloud FROM obs WHERE cloud < 20")
def scene_quality_filter(spark, d):
    return composite.clear_scenes(observations(spark, d)).select("pixel", "tile_idx", "ts", "cloud")


@query("SELECT pixel, tile_idx, ts, CASE WHEN cls NOT IN ('R') THEN b8 END AS value FROM obs")
def class_mask(spark, d):
    return observations(spark, d).select("pixel", "tile_idx", "ts", composite.masked_by_class(F.col("b8"), F.col("cls"), ["R"]).alias("value"))


@query("SELECT pixel, value FROM pix WHERE value > 25")
def mask_filter(spark, d):
    return grid.masked(pixels(spark, d), ABOVE).select("pixel", "value")


@query("SELECT pixel, tile_idx, ts, CASE WHEN cls = 'R' THEN NULL ELSE b8 END AS value FROM obs")
def nodata_to_null(spark, d):
    raw = F.when(F.col("cls") == "R", F.when(F.col("b4") < 0.05, F.lit(extract.NODATA)).otherwise(F.lit(float("nan")))).otherwise(F.col("b8"))
    return observations(spark, d).select("pixel", "tile_idx", "ts", extract.nodata_to_null(raw).alias("value"))


# --- grid


@query(f"WITH {MASKED_SQL} SELECT zone, pixel, pixel_id FROM ids")
def pixel_id_assign(spark, d):
    return _ids(spark, d).select("zone", "pixel", "pixel_id")


@query(f"SELECT pixel, {COORDS_SQL} FROM pix")
def pixel_coords(spark, d):
    return grid.with_coords(pixels(spark, d), AFFINE).select("pixel", "lon", "lat")


@query("SELECT s_suppkey AS tile, CAST(s_suppkey * 2 AS INT) AS row_off, CAST(s_suppkey % 7 AS INT) AS col_off FROM supplier")
def tile_offset(spark, d):
    tiles = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile"), (-1.0 - F.col("s_suppkey") * 2 * 0.5).alias("f"), (-46.0 + F.col("s_suppkey") % 7 * 0.5 + 1e-7).alias("c"))
    return grid.with_offsets(tiles, AFFINE).select("tile", "row_off", "col_off")


@query("SELECT pixel, CAST(grid_row // 10 * 2 + grid_col // 25 AS BIGINT) AS tile, CAST(grid_row % 10 AS INT) AS local_row, CAST(grid_col % 25 AS INT) AS local_col FROM pix")
def tile_locate(spark, d):
    p = pixels(spark, d)
    return p.select("pixel", grid.tile_number(F.col("grid_row"), F.col("grid_col"), 10, 25, 2).alias("tile"), (F.col("grid_row") % 10).alias("local_row"), (F.col("grid_col") % 25).alias("local_col"))


@query("SELECT pixel, CAST(grid_row // 8 AS INT) AS block FROM pix")
def row_blocks(spark, d):
    return pixels(spark, d).select("pixel", grid.row_block(F.col("grid_row"), 8).alias("block"))


#: Overlapping tiles of 12 rows and 30 columns, one every 10 rows and 25 columns.
_TILES_SQL = "tiles AS (SELECT CAST(r * 2 + c AS INT) AS tile, CAST(r * 10 AS INT) AS row_off, CAST(c * 25 AS INT) AS col_off FROM (SELECT unnest(range((SELECT max(grid_row) // 10 + 1 FROM pix))) AS r), (SELECT unnest(range(2)) AS c))"
_IN_TILE = "grid_row >= row_off AND grid_row < row_off + 12 AND grid_col >= col_off AND grid_col < col_off + 30"


def _tiles(spark, d):
    starts = pixels(spark, d).select(F.floor(F.col("grid_row") / 10).cast("int").alias("r")).distinct()
    several = starts.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1))))
    return several.select((F.col("r") * 2 + F.col("c")).alias("tile"), (F.col("r") * 10).alias("row_off"), (F.col("c") * 25).alias("col_off"), F.lit(12).alias("height"), F.lit(30).alias("width"))


@query(f"WITH {_TILES_SQL} SELECT pixel, tile, grid_row - row_off AS local_row, grid_col - col_off AS local_col FROM pix JOIN tiles ON {_IN_TILE}")
def tile_join(spark, d):
    return grid.join_tiles(pixels(spark, d), _tiles(spark, d), 12, 30).select("pixel", "tile", "local_row", "local_col")


@query(f"WITH {_TILES_SQL} SELECT tile, count(*) AS n FROM pix JOIN tiles ON {_IN_TILE} WHERE value > 25 GROUP BY tile")
def tile_pixel_counts(spark, d):
    return grid.join_tiles(grid.masked(pixels(spark, d), ABOVE), _tiles(spark, d), 12, 30).groupBy("tile").agg(F.count("*").alias("n"))


@query("SELECT CAST(grid_row * 10 + grid_col // 5 AS BIGINT) AS tile FROM pix GROUP BY ALL HAVING NOT bool_or(value > 45)")
def tile_prune(spark, d):
    tiled = pixels(spark, d).withColumn("tile", grid.tile_number(F.col("grid_row"), F.col("grid_col"), 1, 5, 10))
    return tiled.groupBy("tile").agg(F.bool_or(F.col("value") > 45).alias("any")).where("not any").select("tile")


@query("SELECT path, CAST(row_number() OVER (ORDER BY path) AS INT) AS tile_idx FROM (SELECT 'zone1_s2_' || s_suppkey || '-' || s_nationkey || '.tif' AS path FROM supplier)")
def tile_order(spark, d):
    """Tiles are files: their list is short and sorted on the driver."""
    paths = [r[0] for r in table(spark, d, "supplier").select(F.concat(F.lit("zone1_s2_"), "s_suppkey", F.lit("-"), "s_nationkey", F.lit(".tif"))).collect()]
    return spark.createDataFrame(list(zip(sorted(paths), range(1, len(paths) + 1))), "path string, tile_idx int")


@query("SELECT pixel, tile_idx, b8 AS value FROM obs WHERE tile_idx % 2 = 0 UNION ALL SELECT pixel, tile_idx, b4 FROM obs WHERE tile_idx % 2 = 1")
def tile_union(spark, d):
    obs = observations(spark, d)
    return obs.where("tile_idx % 2 = 0").select("pixel", "tile_idx", F.col("b8").alias("value")).unionByName(obs.where("tile_idx % 2 = 1").select("pixel", "tile_idx", F.col("b4").alias("value")))


_ORDER = ["tile_idx", "l_orderkey", "l_linenumber", "ts", "b7"]
_HIDDEN = "CASE WHEN cls NOT IN ('R') THEN b8 END"


@query(f"SELECT pixel, {_HIDDEN} AS value FROM obs QUALIFY row_number() OVER (PARTITION BY pixel ORDER BY tile_idx DESC, l_orderkey DESC, l_linenumber DESC, ts DESC, b7 DESC) = 1")
def overlap_last_wins(spark, d):
    return extract.last_wins(observations(spark, d).withColumn("value", composite.masked_by_class(F.col("b8"), F.col("cls"), ["R"])), ["pixel"], _ORDER)


@query(f"""SELECT pixel, value FROM (SELECT pixel, {_HIDDEN} AS value, tile_idx, l_orderkey, l_linenumber, ts, b7 FROM obs)
  QUALIFY row_number() OVER (PARTITION BY pixel ORDER BY value IS NULL, tile_idx, l_orderkey, l_linenumber, ts, b7) = 1""")
def mosaic_first_wins(spark, d):
    return extract.first_wins(observations(spark, d).withColumn("value", composite.masked_by_class(F.col("b8"), F.col("cls"), ["R"])), ["pixel"], _ORDER)


@query("SELECT pixel, tile_idx, ts FROM obs WHERE pixel IN (SELECT pixel FROM pix WHERE value > 25)")
def mask_semi_join(spark, d):
    return observations(spark, d).join(grid.masked(pixels(spark, d), ABOVE), "pixel", "left_semi").select("pixel", "tile_idx", "ts")


@query("SELECT zone, count(*) FILTER (value > 25) AS n_masked, count(*) AS n_total, round(count(*) FILTER (value > 25) / count(*), 6) AS ratio FROM pix GROUP BY zone")
def mask_coverage(spark, d):
    return grid.coverage(pixels(spark, d), ABOVE)


@query("""SELECT p.pixel, coalesce(c.value, 0) AS mask_value FROM pix p
  LEFT JOIN pix c ON c.zone = p.zone AND c.grid_row = p.grid_row // 3 AND c.grid_col = p.grid_col // 3""")
def mask_resample(spark, d):
    p = pixels(spark, d)
    return grid.resample_nearest(p, p, 3).select("pixel", "mask_value")


#: A coarser grid with another origin, which the cells' grid reaches beyond.
COARSE = grid.Affine(1.7, 0.0, -47.3, 0.0, -1.3, 0.9)


@query(f"""WITH a AS (SELECT zone, pixel, {COORDS_SQL} FROM pix)
  SELECT a.pixel, coalesce(c.value, 0) AS mask_value FROM a
  LEFT JOIN pix c ON c.zone = a.zone AND c.grid_col = floor((a.lon + 47.3) / 1.7) AND c.grid_row = floor((a.lat - 0.9) / -1.3)""")
def mask_reproject(spark, d):
    """Nearest cells between two affine grids; 0 outside the coarse one."""
    p = pixels(spark, d)
    return grid.resample_affine(p, AFFINE, p, COARSE).select("pixel", "mask_value")


@query("WITH " + MEDIAN_SQL + " SELECT p.pixel, m.value FROM pix p LEFT JOIN (SELECT pixel, value FROM med WHERE year = 1998 AND month = 6) m USING (pixel)")
def left_fill(spark, d):
    month = _composite(spark, d).where("year = 1998 and month = 6").select("pixel", "value")
    return extract.left_fill(pixels(spark, d).select("pixel"), month, ["pixel"])


# --- composites


@query("SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM (SELECT unnest(range(2017, 2025)) AS y), (SELECT unnest(range(1, 13)) AS m)")
def calendar_grid(spark, d):
    return composite.calendar_grid(spark, 2017, 2024)


@query("WITH " + MEDIAN_SQL + " SELECT pixel, year, month, value FROM med")
def monthly_median_composite(spark, d):
    return _composite(spark, d)


@query("WITH " + LONG_SQL + " SELECT pixel, year, month, value FROM long")
def composite_calendar_fill(spark, d):
    return composite.fill_calendar(_composite(spark, d), _ids(spark, d).select("pixel"), FIRST, LAST)


@query("WITH " + MEDIAN_SQL + " SELECT pixel, year, month, epoch_ms(make_timestamp(year, month, 1, 0, 0, 0)) AS time_start FROM med")
def scene_metadata(spark, d):
    """Composites with the metadata that a scene carries: year, month and the month's start."""
    return composite.with_scene_metadata(_composite(spark, d)).select("pixel", "year", "month", "time_start")


@query("WITH " + MEDIAN_SQL + " SELECT pixel, year, month, value FROM med WHERE year = 1997 AND month = 7 ORDER BY pixel LIMIT 1")
def composite_lookup(spark, d):
    return composite.lookup(_composite(spark, d), 1997, 7, ["pixel"])


# --- reshape


@query("SELECT vec_id, CAST(pos AS INT) AS pos, embedding[pos + 1] AS value FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS pos FROM embeddings)")
def array_bands_explode(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))


@query("SELECT CAST(r AS INT) AS grid_row, CAST(c AS INT) AS grid_col FROM (VALUES (0, 0), (0, 2), (1, 1), (1, 2), (2, 3)) t(r, c)")
def mask_array_explode(spark, d):
    mask = spark.createDataFrame([([[1, 0, 1, 0], [0, 1, 1, 0], [0, 0, 0, 1]],)], "m array<array<int>>")
    rows = mask.select(F.posexplode("m").alias("grid_row", "cells"))
    return rows.select("grid_row", F.posexplode("cells").alias("grid_col", "v")).where("v > 0").select("grid_row", "grid_col")


_MONTHS = [f"NDVI_1998_{m:02d}" for m in range(1, 13)]


def _wide(spark, d, year=1998, names=None):
    named = _composite(spark, d).where(F.col("year") == year).withColumn("band", bands.band_name(F.lit("NDVI"), F.col("year"), F.col("month")))
    return merge.pivot_wide(named, ["pixel"], "band", names or [f"NDVI_{year}_{m:02d}" for m in range(1, 13)])


@query("WITH " + MEDIAN_SQL + " SELECT pixel, " + ", ".join(f"max(CASE WHEN month = {m} THEN value END) AS NDVI_1998_{m:02d}" for m in range(1, 13)) + " FROM med WHERE year = 1998 GROUP BY pixel")
def pivot_wide(spark, d):
    return _wide(spark, d)


@query("WITH " + MEDIAN_SQL + """ SELECT p.pixel, 'NDVI_1998_' || lpad(CAST(m AS VARCHAR), 2, '0') AS band, med.value FROM (SELECT DISTINCT pixel FROM med WHERE year = 1998) p
  CROSS JOIN (SELECT unnest(range(1, 13)) AS m) LEFT JOIN med ON med.pixel = p.pixel AND med.year = 1998 AND med.month = m""")
def unpivot_long(spark, d):
    return merge.unpivot_long(_wide(spark, d), ["pixel"], _MONTHS)


_EVERY_MONTH = ", ".join(f"max(CASE WHEN year = {y} AND month = {m} THEN value END) AS NDVI_{y}_{m:02d}" for y in range(FIRST, LAST + 1) for m in range(1, 13))


@query(f"WITH {MEDIAN_SQL}, a AS (SELECT pixel, {COORDS_SQL} FROM pix) SELECT a.pixel, lon, lat, {_EVERY_MONTH} FROM a LEFT JOIN med USING (pixel) GROUP BY a.pixel, lon, lat")
def wide_merge(spark, d):
    """Coordinates with every month of every year, after a check that all tables have the same pixels."""
    coords = grid.with_coords(pixels(spark, d), AFFINE).select("pixel", "lon", "lat")
    years = [extract.left_fill(coords.select("pixel"), _wide(spark, d, y), ["pixel"]) for y in range(FIRST, LAST + 1)]
    return merge.wide_merge(coords, years, ["pixel"])


# --- sampling and audit


@query("WITH " + MASKED_SQL + " SELECT zone, pixel_id, CAST(pixel_id // 100 AS INT) AS chunk FROM ids")
def chunk_assign(spark, d):
    return _ids(spark, d).select("zone", "pixel_id", grid.chunk_number(F.col("pixel_id"), 100).alias("chunk"))


_SAMPLE_SQL = """, g AS (SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS g FROM pix), picked AS (SELECT DISTINCT CASE WHEN m < 2 THEN 0 ELSE k * (g - 1) // (m - 1) END AS chunk
  FROM (SELECT g, least(5, g) AS m, unnest(range(least(5, g))) AS k FROM g))"""


def _sampled(spark, d):
    p = pixels(spark, d)
    numbers = audit.spread(-(-p.count() // 100))
    return p, numbers


@query("WITH a AS (SELECT 1)" + _SAMPLE_SQL + " SELECT pixel, value FROM pix WHERE pixel // 100 IN (SELECT chunk FROM picked)")
def sample_chunks(spark, d):
    p, numbers = _sampled(spark, d)
    return audit.sample_chunks(p, numbers, 100, "pixel").select("pixel", "value")


@query("WITH a AS (SELECT 1)" + _SAMPLE_SQL + " SELECT pixel, value FROM pix WHERE pixel // 100 IN (SELECT chunk FROM picked)")
def union_samples(spark, d):
    p, numbers = _sampled(spark, d)
    out = None
    for k in numbers:
        part = audit.sample_chunks(p, [k], 100, "pixel").select("pixel", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT DISTINCT tile_idx FROM obs")
def distinct_values(spark, d):
    return observations(spark, d).select("tile_idx").distinct()


@query("WITH " + LONG_SQL + " SELECT zone, pixel_id, round(avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END), 6) AS missing FROM long GROUP BY ALL")
def pixel_missing_fraction(spark, d):
    return audit.missing_fraction(_filled(spark, d)).withColumn("missing", F.round("missing", 6))


_FRACTION_SQL = "fr AS (SELECT zone, pixel_id, avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS missing FROM long GROUP BY ALL)"
_MISSING_SQL = "round(avg(missing), 6) AS nan_fraction_mean, round(median(missing), 6) AS nan_fraction_median, round(stddev_pop(missing), 6) AS nan_fraction_std"
_DIST_SQL = """count(value) AS valid_value_count, min(value) AS valid_value_min, max(value) AS valid_value_max, round(avg(value), 6) AS valid_value_mean,
  round(median(value), 6) AS valid_value_median, round(stddev_pop(value), 6) AS valid_value_std"""
_PCT_SQL = "round(avg(CASE WHEN value < 0 THEN 1 ELSE 0 END), 6) AS pct_negative, round(avg(CASE WHEN value < 0.3 THEN 1 ELSE 0 END), 6) AS pct_below_low_threshold"


@query(f"WITH {LONG_SQL}, {_FRACTION_SQL} SELECT zone, {_MISSING_SQL} FROM fr GROUP BY zone")
def audit_missingness(spark, d):
    return audit.missingness(audit.missing_fraction(_filled(spark, d)))


@query(f"WITH {LONG_SQL} SELECT zone, {_DIST_SQL} FROM long WHERE value IS NOT NULL GROUP BY zone")
def audit_distribution(spark, d):
    return audit.distribution(_filled(spark, d))


@query(f"WITH {LONG_SQL} SELECT zone, {_PCT_SQL} FROM long WHERE value IS NOT NULL GROUP BY zone")
def audit_thresholds(spark, d):
    return audit.thresholds(_filled(spark, d))


@query(f"SELECT zone, min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, max(lat) AS lat_max FROM (SELECT zone, {COORDS_SQL} FROM pix) GROUP BY zone")
def geo_extent(spark, d):
    return audit.extent(grid.with_coords(pixels(spark, d), AFFINE))


@query(f"""WITH {MEDIAN_SQL}, e AS (SELECT CAST(i AS INT) AS bin, l[i + 1] AS low, l[i + 2] AS high FROM (SELECT [{", ".join(f"CAST({x!r} AS DOUBLE)" for x in audit.EDGES)}] AS l, unnest(range(100)) AS i))
  SELECT bin, low, high, count(value) AS n FROM e LEFT JOIN med ON value >= low AND (value < high OR bin = 99 AND value <= high) GROUP BY ALL""")
def ndvi_histogram(spark, d):
    return audit.histogram(_composite(spark, d))


_SUMMARY_SQL = f"""{LONG_SQL}, {_FRACTION_SQL}, su AS (SELECT * FROM (SELECT zone, {_MISSING_SQL} FROM fr GROUP BY zone)
  LEFT JOIN (SELECT zone, {_DIST_SQL} FROM long WHERE value IS NOT NULL GROUP BY zone) USING (zone)
  LEFT JOIN (SELECT zone, {_PCT_SQL} FROM long WHERE value IS NOT NULL GROUP BY zone) USING (zone))"""


@query(f"WITH {_SUMMARY_SQL} SELECT *, CAST(0.3 AS DOUBLE) AS ndvi_low_threshold_used FROM su")
def audit_summary(spark, d):
    return flagship(spark, d)


_JSON_SQL = ", ".join(
    f"""'"{name}":', coalesce({'CAST(' + name + ' AS VARCHAR)' if kind == 'n' else 'chr(34) || ' + name + ' || chr(34)' if kind == 's' else 'CAST(CAST(round(' + name + ', 6) AS DECIMAL(28,6)) AS VARCHAR)'}, 'null')"""
    + (", ','" if name != "ndvi_low_threshold_used" else "")
    for name, kind in (
        ("zone", "s"), ("nan_fraction_mean", "d"), ("nan_fraction_median", "d"), ("nan_fraction_std", "d"), ("valid_value_count", "n"), ("valid_value_min", "d"), ("valid_value_max", "d"), ("valid_value_mean", "d"),
        ("valid_value_median", "d"), ("valid_value_std", "d"), ("pct_negative", "d"), ("pct_below_low_threshold", "d"), ("ndvi_low_threshold_used", "d"),
    )
)


@query(f"WITH {_SUMMARY_SQL}, su_ AS (SELECT *, CAST(0.3 AS DOUBLE) AS ndvi_low_threshold_used FROM su) SELECT concat('{{', {_JSON_SQL}, '}}') AS json FROM su_")
def audit_summary_json(spark, d):
    return render.as_json(flagship(spark, d))


@query(f"""WITH {_SUMMARY_SQL}, tot AS (SELECT zone, count(*) AS n FROM ids GROUP BY zone)
  SELECT upper(zone) AS zone, format('{{:,}}', n) AS total_pixels, printf('%.2f%%', nan_fraction_mean * 100) AS nan_frac_mean, printf('%.2f%%', nan_fraction_median * 100) AS nan_frac_median,
  printf('[%.3f, %.3f]', valid_value_min, valid_value_max) AS valid_range, printf('%.3f', valid_value_mean) AS valid_mean, printf('%.2f%%', pct_negative * 100) AS pct_negative,
  printf('%.2f%%', pct_below_low_threshold * 100) AS pct_below_low FROM su JOIN tot USING (zone)""")
def zone_comparison(spark, d):
    totals = _ids(spark, d).groupBy("zone").agg(F.count("*").alias("total_pixels"))
    return audit.comparison(flagship(spark, d), totals)


# --- extensions and instruments


@query("WITH " + MEDIAN_SQL + " SELECT pixel, round(regr_slope(value, year * 12 + month), 6) + 0.0 AS slope FROM med GROUP BY pixel")
def trend_slope(spark, d):
    return trend.trend_slope(_composite(spark, d))


@query("""SELECT a.zone, a.pixel, b.pixel AS neighbour FROM pix a JOIN pix b ON a.zone = b.zone AND b.grid_row BETWEEN a.grid_row - 1 AND a.grid_row + 1
  AND b.grid_col BETWEEN a.grid_col - 1 AND a.grid_col + 1 AND a.pixel <> b.pixel""")
def queen_neighbors(spark, d):
    return trend.queen_neighbours(pixels(spark, d))


@query("""SELECT a.pixel, round(avg(b.value), 6) AS lag FROM pix a JOIN pix b ON a.zone = b.zone AND b.grid_row BETWEEN a.grid_row - 1 AND a.grid_row + 1
  AND b.grid_col BETWEEN a.grid_col - 1 AND a.grid_col + 1 AND a.pixel <> b.pixel GROUP BY a.pixel""")
def spatial_lag(spark, d):
    """Mean of each cell's neighbours."""
    return trend.spatial_lag(pixels(spark, d), "value")


@query(f"""WITH {LONG_SQL}, w AS (SELECT pixel, year, month, row_number() OVER o AS k, count(*) OVER (PARTITION BY pixel) AS n,
    sum(value) OVER (o ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS p, sum(value) OVER (o ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS f FROM (SELECT pixel, year, month, coalesce(value, 0) AS value FROM long)
    WINDOW o AS (PARTITION BY pixel ORDER BY year, month)) SELECT pixel, year, month, round(p, 6) + 0.0 AS past_sum, round(f, 6) + 0.0 AS future_sum FROM w WHERE k >= 36 AND k <= n - 12""")
def lookback_windows(spark, d):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6) + 0.0
    filled = _filled(spark, d).withColumn("value", F.coalesce("value", F.lit(0.0)))
    return trend.lookback_windows(filled).select("pixel", "year", "month", total("past").alias("past_sum"), total("future").alias("future_sum"))


@query(f"""WITH p AS (SELECT pixel, value, {COORDS_SQL} FROM pix), a AS (SELECT * FROM p WHERE value > 25)
  SELECT a.pixel AS id_a, p.pixel AS id_b FROM a JOIN p ON abs(a.lat - p.lat) < 2 AND abs(a.lon - p.lon) < 4
  WHERE 2 * 6371.0088 * asin(sqrt(pow(sin(radians(p.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - a.lon) / 2), 2))) <= 100""")
def buffer_join(spark, d):
    """Cells within 100 km of a masked one, by less than 2 degrees of latitude and 4 of longitude."""
    points = grid.with_coords(pixels(spark, d), AFFINE).select(F.col("pixel").alias("id"), "lon", "lat", "value")
    return trend.within_km(grid.masked(points, ABOVE), points, 100, (2, 4))


@query("""SELECT event_id, pixel, epoch_us(ts) - lag(epoch_us(ts)) OVER o AS since_last, epoch_us(ts) - first_value(epoch_us(ts)) OVER o AS since_start
  FROM evt WINDOW o AS (PARTITION BY pixel ORDER BY ts, event_id)""")
def timer_marks(spark, d):
    return trend.marks(events(spark, d), "pixel").select("event_id", "pixel", "since_last", "since_start")
