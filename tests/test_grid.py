import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridweave.functions import bands
from gridweave.operators import extract, grid, merge

AFFINE = grid.Affine(0.5, 0.0, -46.0, 0.0, -0.5, -1.0)
MASK = [[1, 0, 1, 0], [0, 1, 1, 0], [0, 0, 0, 1]]


def cells(spark):
    rows = [("z", r, c, v) for r, line in enumerate(MASK) for c, v in enumerate(line)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "zone string, grid_row int, grid_col int, value int")


def ids(spark):
    return grid.assign_pixel_ids(grid.masked(cells(spark)))


def test_ids_and_coordinates(spark):
    got = sorted(tuple(r) for r in grid.with_coords(ids(spark), AFFINE).select("pixel_id", "grid_row", "grid_col", "lon", "lat").collect())
    assert got == [(0, 0, 0, -45.75, -1.25), (1, 0, 2, -44.75, -1.25), (2, 1, 1, -45.25, -1.75), (3, 1, 2, -44.75, -1.75), (4, 2, 3, -44.25, -2.25)]


def test_ids_do_not_depend_on_partitions(spark):
    want = sorted(map(tuple, ids(spark).collect()))
    for n in (1, 7):
        assert sorted(map(tuple, grid.assign_pixel_ids(grid.masked(cells(spark)).repartition(n)).collect())) == want


def test_coverage_and_masks(spark):
    r = grid.coverage(cells(spark)).first()
    assert (r["n_masked"], r["n_total"], r["ratio"]) == (5, 12, 0.416667)
    with pytest.raises(ValueError):
        grid.masked_or_all(cells(spark), cells(spark).withColumn("value", F.lit(0)))
    with pytest.warns(UserWarning):
        assert grid.masked_or_all(cells(spark), None).count() == 12


@pytest.mark.parametrize("delta,want", [(3.0, 3), (3.0000005, 3), (2.9999999, 3), (-2.0, -2), (3.00001, None), (0.5, None)])
def test_offsets(spark, delta, want):
    df = spark.createDataFrame([(delta,)], "x double").select(grid.offset(F.col("x"), 0.0, 1.0).alias("o"))
    if want is None:
        with pytest.raises(PySparkException):
            df.collect()
    else:
        assert df.first()["o"] == want


def tile_pixels(spark, order):
    def tile(idx, r0, c0, h, w, base, hole):
        return [("z", idx, r0 + r, c0 + c, [extract.NODATA if b == 0 and hole == (r, c) else float(base + 1000 * b + r * w + c) for b in range(3)]) for r in range(h) for c in range(w)]

    rows = tile(order[0], 0, 0, 2, 3, 10, None) + tile(order[1], 1, 1, 1, 2, 100, (0, 1))
    return spark.createDataFrame(rows, "zone string, tile_idx int, grid_row int, grid_col int, bands array<float>")


@pytest.mark.parametrize("order,two,three", [((1, 2), (100, 1100, 2100), (None, 1101, 2101)), ((2, 1), (14, 1014, 2014), (15, 1015, 2015))])
def test_last_tile_wins_even_with_nodata(spark, order, two, three):
    out = extract.sample_year(ids(spark), tile_pixels(spark, order), {0: "b0", 1: "b1", 2: "b2"})
    got = {r["pixel_id"]: (r["b0"], r["b1"], r["b2"]) for r in out.collect()}
    assert got == {0: (10, 1010, 2010), 1: (12, 1012, 2012), 2: two, 3: three, 4: (None, None, None)}


def test_band_names(spark):
    names = {"NDVI_2018_07": ("NDVI", 2018, 7), "0_NDVI_2018_07": ("NDVI", 2018, 7), "NDVI_2018_071": ("NDVI", 2018, 7), "XEVI_2019_01_NDVI_2020_02": ("EVI", 2019, 1), "QA60": (None, None, None), "": (None, None, None)}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r["name"]: tuple(r)[1:] for r in df.select("name", *bands.parse_band(F.col("name"))).collect()} == names
    assert bands.year_columns(["QA60", "0_NDVI_2018_07"], 2021) == {1: "NDVI_2021_07"}
    for bad in (["NDVI_2017_01", "NDVI_2018_01"], ["band_1"]):
        with pytest.raises(ValueError):
            bands.year_columns(bad, 2018)


def test_extract_resumes_and_merges(spark, tmp_path):
    pixels = grid.with_coords(ids(spark), AFFINE)
    names = ["NDVI_2018_01", "QA60", "EVI_2018_01"]
    made = extract.extract(pixels, {2018: (tile_pixels(spark, (1, 2)), names), 2019: (tile_pixels(spark, (2, 1)), names)}, str(tmp_path), bands.INDICES)
    assert made["n_pixels"] == 5
    assert not extract.write_year(ids(spark).drop("zone"), made["year_files"][0])
    done = merge.merge(spark, str(tmp_path), "z", 2018, 2019, str(tmp_path / "wide"))
    assert (done["n_pixels"], done["n_cols"]) == (5, 4)
    with pytest.raises(FileNotFoundError):
        merge.merge(spark, str(tmp_path), "z", 2018, 2020, str(tmp_path / "other"))
    coords = spark.read.parquet(made["coords_paths"]["z"])
    with pytest.raises(ValueError):
        merge.wide_merge(coords, [coords.where("pixel_id < 4").select("pixel_id")], ["pixel_id"])


def test_pivot_and_back(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "b", 3.0)], "pixel int, band string, value double")
    back = merge.unpivot_long(merge.pivot_wide(long, ["pixel"], "band", ["a", "b"]), ["pixel"], ["a", "b"])
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, [(1, "a", 1.0), (1, "b", None), (2, "a", None), (2, "b", 3.0)]))
