"""A .json path may hold FeatureCollections, record arrays or both; no record is lost."""
import json
import os

import pytest

from floetrack.sources.readers import read_tracks

RECORDS = [{"iceberg_id": f"R{i}", "timestamp": f"2024-01-0{i + 1} 06:00:00", "latitude": -70.0 - i, "longitude": 10.0 + i, "length_nm": 2.0, "width_nm": 1.0}
           for i in range(3)]
GEO = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"id": f"G{i}", "time": f"2024-02-0{i + 1} 00:00:00"}, "geometry": {"type": "Point", "coordinates": [20.0 + i, -60.0 - i]}}
    for i in range(4)]}


def folder(tmp_path, **docs):
    path = tmp_path / "tracks.json"
    os.makedirs(path)
    for name, doc in docs.items():
        (path / f"{name}.json").write_text(json.dumps(doc))
    return str(path)


@pytest.mark.parametrize("docs,ids", [
    ({"a": RECORDS, "b": GEO}, ["G0", "G1", "G2", "G3", "R0", "R1", "R2"]),
    ({"a": RECORDS}, ["R0", "R1", "R2"]),
    ({"b": GEO}, ["G0", "G1", "G2", "G3"]),
])
def test_documents_of_both_kinds(spark, tmp_path, docs, ids):
    rows = {r["iceberg_id"]: r for r in read_tracks(spark, folder(tmp_path, **docs)).collect()}
    assert sorted(rows) == ids
    if "G1" in rows:
        assert (rows["G1"]["latitude"], rows["G1"]["longitude"]) == (-61.0, 21.0)
    if "R2" in rows:
        assert (rows["R2"]["latitude"], rows["R2"]["longitude"]) == (-72.0, 12.0)
