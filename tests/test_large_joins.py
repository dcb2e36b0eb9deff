"""Joins of tables that Spark's estimates take for small ones."""

from math import asin, cos, radians, sin, sqrt

import pytest

from gridweave.operators import audit, composite, trend


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture
def cells(spark, tmp_path):
    """A table of files, as only these have an estimate of few bytes."""
    rows = spark.range(900).selectExpr("'z' zone", "id pixel", "int(id div 30) grid_row", "int(id % 30) grid_col", "int(id % 7) value")
    rows.write.parquet(str(tmp_path / "cells"))
    return spark.read.parquet(str(tmp_path / "cells"))


def test_neighbours_are_not_broadcast(cells):
    assert "BroadcastHashJoin" not in plan_of(trend.queen_neighbours(cells))


def test_lag_is_not_broadcast(cells):
    lag = trend.spatial_lag(cells, "value")
    assert "BroadcastHashJoin" not in plan_of(lag)
    got = {r["pixel"]: r["lag"] for r in lag.collect()}
    assert len(got) == 900 and got[0] == pytest.approx((1 + 30 % 7 + 31 % 7) / 3, abs=1e-6)


def test_calendar_is_not_broadcast(spark, cells, tmp_path):
    cells.selectExpr("pixel", "2000 year", "1 month", "value / 7 value").write.parquet(str(tmp_path / "months"))
    months = composite.fill_calendar(spark.read.parquet(str(tmp_path / "months")), cells.select("pixel", "zone"), 1995, 2001, ["pixel"])
    long = months.join(cells.select("pixel", "zone").hint("merge"), "pixel")
    valid = long.where("value is not null")
    assert "BroadcastHashJoin" not in plan_of(valid) and valid.count() == 900
    assert long.count() == 900 * 84
    assert "BroadcastHashJoin" not in plan_of(audit.thresholds(long))


def test_buffer_at_and_beyond_a_pole(spark):
    """A box holds pairs at a pole too, and a point has few cells at any latitude."""
    points = [(i, -46.0 + i % 7 * 1.9, -88.0 - i // 7 * 0.5) for i in range(7 * 24)]
    df = spark.createDataFrame(points, "id long, lon double, lat double")

    def near(a, b):
        (la, pa), (lb, pb) = map(radians, a[1:]), map(radians, b[1:])
        h = sin((pb - pa) / 2) ** 2 + cos(pa) * cos(pb) * sin((lb - la) / 2) ** 2
        return abs(a[2] - b[2]) < 2 and abs(a[1] - b[1]) < 4 and 2 * trend.EARTH_KM * asin(sqrt(h)) <= 100

    got = trend.within_km(df, df, 100, (2, 4))
    assert sorted(map(tuple, got.collect())) == sorted((a[0], b[0]) for a in points for b in points if near(a, b))
    assert "BroadcastHashJoin" not in plan_of(got)
