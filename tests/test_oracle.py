"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

import oracle_check
from gridweave.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in oracle_check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["overlap_last_wins", "mosaic_first_wins", "pixel_id_assign", "tile_join", "mask_resample", "audit_summary", "zone_comparison", "ndvi_histogram", "sample_chunks", "tile_offset", "mask_reproject", "wide_merge", "audit_summary_json", "audit_distribution", "audit_missingness", "spatial_lag", "scene_bounds_filter", "scene_metadata", "buffer_join"])
def test_equal(spark, con, name):
    assert oracle_check.differs(catalogue.QUERIES[name](spark, FOLDER).toPandas(), con.sql(catalogue.ORACLES[name]).df()) == ""


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3
