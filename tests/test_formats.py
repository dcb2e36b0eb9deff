import json

import pytest

from gridweave.sources import formats


def test_formats(spark, tmp_path):
    (tmp_path / "flow.csv").write_text("day,flow\n2018-01-01,3.5\n2018-01-02,\n")
    assert [tuple(r) for r in formats.read_table(spark, str(tmp_path / "flow.csv"), "day date, flow double").collect()][1][1] is None
    assert formats.read_table(spark, str(tmp_path / "flow.csv")).dtypes == [("day", "string"), ("flow", "string")]
    (tmp_path / "x.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert formats.read_table(spark, str(tmp_path / "x.json")).count() == 2
    features = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"name": "a", "lanes": 2}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}, "properties": {"name": None}},
    ]
    path = tmp_path / "roads.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = formats.read_table(spark, str(path)).collect()
    assert [(r["geometry"], json.loads(r["coordinates"])) for r in got] == [("Point", [1.5, 2]), ("LineString", [[0, 1], [2, 3]])]
    assert got[0]["properties"] == {"name": "a", "lanes": "2"}
    assert [tuple(r)[2:] for r in formats.read_table(spark, str(path), "name string, lanes int").collect()] == [("a", 2), (None, None)]
    with pytest.raises(ValueError):
        formats.read_table(spark, "x.xls")
