"""Zones from tile files to final tables, through a tile format that needs no raster library."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import audit, composite, extract, grid, merge, trend, zone
from gridweave.sources import tiles
from gridweave.streaming import ingest

NAMES = ["NDVI_2018_01", None, "EVI_2018_01"]


def tile(folder, name, row, col, values, names=NAMES, size=0.5):
    """A tile whose corner is at a cell of the grid from (-46, -1) with cells of `size` degrees."""
    return tiles.ArrayTile.write(str(folder / f"{name}.tif"), np.asarray(values, np.float32), (size, 0, -46 + col * size, 0, -size, -1 - row * size), names=names)


def two_tiles(folder, prefix, year, base):
    """Tiles that overlap by a column; the second one's sentinel wins there."""
    one = np.arange(3 * 5 * 4, dtype=float).reshape(3, 5, 4) + base
    two = np.arange(3 * 5 * 3, dtype=float).reshape(3, 5, 3) + base + 1000
    two[0, 1, 0] = extract.NODATA
    tile(folder, f"{prefix}_{year}-1", 0, 0, one)
    tile(folder, f"{prefix}_{year}-2", 0, 3, two)
    grid_ = np.full((3, 5, 6), np.nan)
    grid_[:, :, :4] = one
    grid_[:, :, 3:] = np.where(two == extract.NODATA, np.nan, two)
    return grid_


def mask(folder, prefix):
    """A mask with cells twice as large, which leaves the last grid row and column out."""
    values = np.array([[[1, 0, 1], [0, 1, 0]]])
    tiles.ArrayTile.write(str(folder / f"{prefix}.tif"), values, (1.0, 0, -46, 0, -1.0, -1), names=["m"])
    return [(r, c) for r in range(4) for c in range(6) if values[0][r // 2][c // 2]]


def test_two_zones_in_one_folder(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    for k, z in enumerate(("zone1", "zone2")):
        grids = {y: two_tiles(raw, f"{z}_s2", y, 10000 * k + 100 * (y - 2018)) for y in (2018, 2019)}
        under = mask(raw, f"{z}_mask")
        made = zone.run_extraction(spark, z, str(raw), str(raw), out, f"{z}_s2", f"{z}_mask", 2018, 2019, opener=tiles.ArrayTile)
        assert made["n_pixels"] == len(under)
        done = zone.run_merge(spark, z, out, 2018, 2019, str(tmp_path / f"{z}_wide"))
        assert (done["n_pixels"], done["n_cols"]) == (len(under), 4)
        got = spark.read.parquet(done["parquet_path"]).orderBy("pixel_id").collect()
        for r, (row, col) in zip(got, under):
            assert (r["lon"], r["lat"]) == (-46 + (col + 0.5) / 2, -1 - (row + 0.5) / 2)
            for y, g in grids.items():
                for band, name in ((0, f"NDVI_{y}_01"), (2, f"EVI_{y}_01")):
                    want = g[band, row, col]
                    assert r[name] is None if math.isnan(want) else r[name] == want
    # what is there is not made again, and what is missing is said
    again = zone.run_extraction(spark, "zone1", str(raw), str(raw), out, "zone1_s2", "zone1_mask", 2018, 2019, opener=tiles.ArrayTile)
    assert again["year_files"] == [extract.year_path(out, "zone1", y) for y in (2018, 2019)]
    with pytest.raises(FileNotFoundError):
        zone.run_extraction(spark, "zone1", str(raw), str(raw), out, "zone1_s2", "zone1_mask", 2018, 2020, opener=tiles.ArrayTile)
    with pytest.raises(FileNotFoundError):
        zone.run_merge(spark, "zone1", out, 2018, 2020, str(tmp_path / "x"))


def test_reference_grid_and_metadata(spark, tmp_path):
    two_tiles(tmp_path, "p", 2018, 0)
    paths = tiles.find_tiles(str(tmp_path), "p_2018")
    own = zone.reference_grid(tiles.metadata(spark, paths, tiles.ArrayTile))
    assert own == zone.ReferenceGrid(grid.Affine(0.5, 0.0, -46.0, 0.0, -0.5, -1.0), "EPSG:4326", 5, 6, ("NDVI_2018_01", "band_2", "EVI_2018_01"))
    with pytest.raises(FileNotFoundError):
        tiles.metadata(spark, [], tiles.ArrayTile)
    tile(tmp_path, "q_2018-1", 0, 0, np.zeros((2, 5, 6)), names=["NDVI_2018_01", "EVI_2018_01"])
    cells = grid.assign_pixel_ids(zone.all_cells(spark, "z", 5, 6))
    with pytest.raises(ValueError, match="2 bands, not 3"):
        zone.year_pixels(spark, cells, own, tiles.find_tiles(str(tmp_path), "q_2018"), tiles.ArrayTile)
    with pytest.warns(UserWarning):
        assert zone.masked_pixels(spark, "z", own, [], tiles.ArrayTile).count() == 30


def test_blocks_without_wanted_rows_are_not_read(spark, tmp_path):
    path = tile(tmp_path, "big", 0, 0, np.arange(50 * 3, dtype=float).reshape(1, 50, 3), names=["x"])
    meta = tiles.metadata(spark, [path], tiles.ArrayTile)
    log = str(tmp_path / "log")

    class Watched(tiles.ArrayTile):
        def read_rows(self, start, rows):
            with open(log, "a") as f:
                f.write(f"{start} {rows}\n")
            return super().read_rows(start, rows)

    wanted = spark.createDataFrame([(1, 3), (1, 44), (1, 49), (1, 3)], "tile_idx int, local_row int")
    got = tiles.read_pixels(meta, wanted, Watched, block_rows=20).collect()
    assert sorted((r["local_row"], r["local_col"], r["bands"][0]) for r in got) == [(r, c, 3.0 * r + c) for r in (3, 44, 49) for c in range(3)]
    assert sorted(set(open(log).read().split("\n"))) == ["", "0 20", "40 10"]


def test_data_source(spark, tmp_path):
    paths = [tile(tmp_path, f"t{k}", 0, 0, np.full((2, 450, 2), k, float), names=["x", "y"]) for k in (1, 2)]
    df = tiles.read_tiles(spark, paths, "gridweave.sources.tiles:ArrayTile")
    assert df.rdd.getNumPartitions() == 6
    got = df.groupBy("tile_idx").agg(F.count("*").alias("n"), F.sum(F.get("bands", F.lit(1))).alias("s"), F.max("local_row").alias("r")).collect()
    assert sorted(map(tuple, got)) == [(1, 900, 900.0, 449), (2, 900, 1800.0, 449)]


def test_resampling_between_turned_grids(spark):
    target, source = grid.Affine(0.417, 0.113, 3.019, -0.057, -0.619, 7.031), grid.Affine(0.913, -0.207, 2.531, 0.151, -1.117, 7.523)
    cells = zone.all_cells(spark, "z", 6, 7)
    coarse = zone.all_cells(spark, "z", 5, 5).withColumn("value", F.col("grid_row") * 10 + F.col("grid_col") + 1)
    for r in grid.resample_affine(cells, target, coarse, source).collect():
        x = target.c + (r["grid_col"] + 0.5) * target.a + (r["grid_row"] + 0.5) * target.b
        y = target.f + (r["grid_col"] + 0.5) * target.d + (r["grid_row"] + 0.5) * target.e
        col, row = np.floor(np.linalg.solve([[source.a, source.b], [source.d, source.e]], [x - source.c, y - source.f])).astype(int)
        assert r["mask_value"] == (row * 10 + col + 1 if 0 <= row < 5 and 0 <= col < 5 else 0)


def test_export_replaces_what_it_has(spark, tmp_path):
    rows = lambda z, y, v: spark.createDataFrame([(z, y, 1, v)], "zone string, year int, pixel_id int, value int")
    path = str(tmp_path / "x")
    zone.export(rows("a", 2018, 1).union(rows("b", 2018, 2)), path)
    zone.export(rows("a", 2018, 7).union(rows("a", 2019, 3)), path)
    got = spark.read.parquet(path).select("zone", "year", "value").collect()
    assert sorted(map(tuple, got)) == [("a", 2018, 7), ("a", 2019, 3), ("b", 2018, 2)]


def test_points_near_each_other_all_around(spark):
    rng = random.Random(2)
    points = [(k, rng.choice([rng.uniform(-180, 180), 179.95, -179.95, 180.0, -180.0]), rng.choice([rng.uniform(-90, 90), rng.uniform(-2, 2), 89.5, -89.7, 90.0])) for k in range(160)]
    df = spark.createDataFrame([*points, (900, None, 1.0)], "id int, lon double, lat double")

    def km(a, b):
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * trend.EARTH_KM * math.asin(math.sqrt(min(1, h)))

    for reach in (20, 400):
        want = sorted((a[0], b[0]) for a in points for b in points if km(a, b) <= reach)
        assert sorted(map(tuple, trend.within_km(df, df, reach).collect())) == want and len(want) > len(points)


@pytest.mark.parametrize("ranges", [1, 3, 4096])
def test_medians_by_rank(spark, monkeypatch, ranges):
    monkeypatch.setattr(audit, "RANGES", ranges)
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=501), "b": rng.normal(size=100) ** 9, "c": np.array([1.0]), "d": np.repeat([0.25, 0.5], [7, 7]), "e": np.array([2.0, 2.0, 2.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("f", None)]
    got = audit.exact_median(spark.createDataFrame(rows, "zone string, value double"), ["zone"], "value", "m").collect()
    assert {r["zone"]: r["m"] for r in got} == {g: float(np.median(v)) for g, v in groups.items()}


def test_audit_files(spark, tmp_path):
    rng = np.random.default_rng(8)
    values = rng.uniform(-0.4, 0.9, (60, 3))
    values[rng.random((60, 3)) < 0.2] = np.nan
    rows = [(k, k / 10, -k / 10, *(None if math.isnan(x) else float(x) for x in line)) for k, line in enumerate(values)]
    path = str(tmp_path / "wide")
    spark.createDataFrame(rows, "pixel_id long, lon double, lat double, NDVI_2018_01 double, NDVI_2018_02 double, NDVI_2018_03 double").write.parquet(path)
    found = audit.audit_zone(spark, "zone1", path, str(tmp_path / "out"), n_chunks=3, chunk=10)
    some = values[[k for k in range(60) if k // 10 in (0, 2, 5)]]
    valid = some[~np.isnan(some)]
    assert found["sample_row_groups"] == [0, 2, 5] and found["sample_size_rows"] == 30 and found["total_rows_full_dataset"] == 60
    assert found["valid_value_median"] == pytest.approx(np.median(valid), abs=1e-6) and found["pct_negative"] == pytest.approx((valid < 0).mean(), abs=1e-6)
    assert found["sample_geo_extent"]["lon_max"] == 5.9 and "T" in found["audit_timestamp_utc"] and sum(r["n"] for r in found["histogram"]) == len(valid)
    import json

    assert json.load(open(found["json_path"]))["nan_fraction_mean"] == found["nan_fraction_mean"]
    figure, table = audit.compare_zones([found], str(tmp_path / "out"))
    assert "| zone1 | 60 |" in open(table).read() and (figure is None) == (found["figure_path"] is None)


def test_keys_of_all_years_are_checked_at_once(spark):
    coords = spark.range(5).withColumnRenamed("id", "pixel_id")
    year = lambda ids, name: spark.createDataFrame([(i, 1.0) for i in ids], f"pixel_id long, {name} double")
    good = merge.wide_merge(coords, [year(range(5), "a"), year(range(5), "b")], ["pixel_id"])
    assert good.count() == 5 and good.columns == ["pixel_id", "a", "b"]
    for bad in (range(4), range(6), [0, 1, 2, 3, 4, 4], [0, 1, 2, 3, 3]):
        with pytest.raises(ValueError):
            merge.wide_merge(coords, [year(range(5), "a"), year(bad, "b")], ["pixel_id"])


def test_scene_metadata_and_lag(spark):
    one = composite.with_scene_metadata(spark.createDataFrame([(2018, 2)], "year int, month int")).first()
    assert one["time_start"] == 1517443200000
    cells = spark.createDataFrame([("z", 0, 0, 0, 1.0), ("z", 1, 0, 1, 2.0), ("z", 2, 1, 1, 6.0)], "zone string, pixel int, grid_row int, grid_col int, value double")
    assert {r["pixel"]: r["lag"] for r in trend.spatial_lag(cells, "value").collect()} == {0: 4.0, 1: 3.5, 2: 1.5}


def test_ingest_takes_each_file_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([("z", 2018, 1, 0.5), ("z", 2019, 1, 0.6)], "zone string, year int, pixel_id int, value double")
    rows.write.parquet(source)
    assert ingest.ingest_years(spark, source, rows.schema, out, state) == 2
    rows.withColumn("pixel_id", F.lit(2)).write.mode("append").parquet(source)
    assert ingest.ingest_years(spark, source, rows.schema, out, state) == 2
    assert spark.read.parquet(out).count() == 4 and spark.read.parquet(out).where("zone = 'z' and year = 2018").count() == 2
