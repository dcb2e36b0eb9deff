import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import audit, merge, render, trend
from gridweave.sources import config, tiles


def test_audit_of_three_pixels(spark):
    wide = spark.createDataFrame([("z", 0, 0.5, None, -0.1, 0.3), ("z", 1, None, None, None, None), ("z", 2, 0.2, 0.29, 0.31, 1.0)], "zone string, pixel_id long, a float, b float, c float, d float")
    r = audit.summary(merge.unpivot_long(wide, ["zone", "pixel_id"], list("abcd"))).first()
    want = {"nan_fraction_mean": 0.416667, "nan_fraction_median": 0.25, "nan_fraction_std": 0.424918, "valid_value_count": 7, "valid_value_mean": 0.357143, "valid_value_median": 0.3, "valid_value_std": 0.311068, "pct_negative": 0.142857, "pct_below_low_threshold": 0.428571}
    assert {k: r[k] for k in want} == pytest.approx(want)


def test_no_valid_value(spark):
    long = spark.createDataFrame([("z", 0, None)], "zone string, pixel_id long, value float")
    r = audit.summary(long).first()
    assert r["nan_fraction_mean"] == 1 and r["valid_value_mean"] is None


def test_spread_is_linspace():
    for n in (1, 2, 3, 5, 7):
        for g in range(1, 201):
            assert audit.spread(g, n) == sorted(set(np.linspace(0, g - 1, min(n, g), dtype=int).tolist()))
    assert audit.spread(0) == []


def test_first_chunk_alone_misleads(spark):
    df = spark.range(1000).select(F.col("id").alias("pixel_id"), F.when(F.col("id") < 100, -0.5).otherwise(0.6).alias("value"), F.lit("z").alias("zone"))
    share = lambda numbers: audit.thresholds(audit.sample_chunks(df, numbers, 100)).first()["pct_negative"]
    assert share([0]) == 1 and share(audit.spread(10)) == 0.2


def test_histogram_is_numpys(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([audit.EDGES, np.nextafter(audit.EDGES, 9), np.nextafter(audit.EDGES, -9), rng.uniform(-1.2, 1.2, 2000), [-1.5, 1.0000001]])
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    got = [r["n"] for r in audit.histogram(df).orderBy("bin").collect()]
    assert got == np.histogram(values, 100, (-1, 1))[0].tolist()


def test_rendering(tmp_path):
    assert "| 1 | 2 |" in render.markdown([{"a": 1, "b": 2}], "T", "now")
    out = render.write_json({"zone": "z"}, str(tmp_path / "s.json"))
    assert "json_path" in out and "json_path" not in (tmp_path / "s.json").read_text()


def test_files(tmp_path):
    for n in ("p-2.tif", "p-1.tif", "p.tif", "q.tif", "q_mask_x.tif"):
        (tmp_path / n).touch()
    assert [x[-7:] for x in tiles.find_tiles(tmp_path, "p")] == ["p-1.tif", "p-2.tif"]
    assert [x[-5:] for x in tiles.find_tiles(tmp_path, "q")] == ["q.tif"]
    assert tiles.find_tiles(tmp_path, "r") == [] and len(tiles.find_mask(tmp_path, "q_m")) == 1
    (tmp_path / "base_config.yaml").write_text("a: 1\nm: 1e13\n")
    (tmp_path / "gee_config.yaml").write_text("b: 2\n")
    assert config.load_all(str(tmp_path)) == {"a": 1, "m": 1e13, "gee": {"b": 2}}
    with pytest.raises(FileNotFoundError):
        config.load("nowhere.yaml")


def test_neighbours(spark):
    cells = spark.createDataFrame([("z", r * 3 + c, r, c) for r in range(3) for c in range(3)], "zone string, pixel int, grid_row int, grid_col int")
    got = trend.queen_neighbours(cells).groupBy("pixel").count().collect()
    assert sorted(r["count"] for r in got) == [3, 3, 3, 3, 5, 5, 5, 5, 8]
