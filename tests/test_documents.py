"""Records of large JSON documents against json.loads, cut at every place."""
import io
import json
import random

import pytest

from floetrack.sources import documents as D
from floetrack.sources import readers as rd

HARD = ['plain', 'a "quoted" one', 'brackets }]{[ inside', 'back\\slash', 'ends with \\', '\\"', '"features":[{"x":1}]', 'é ü 雪', '']


def document(n, seed=1):
    r = random.Random(seed)
    rec = lambda i: {"i": i, "properties": {"id": r.choice(HARD), "deep": [{"a": [1, {"b": r.choice(HARD)}]}]}, "features": [{"no": i}]}
    return {"type": "FeatureCollection", "crs": {"properties": {"name": "x", "features": [{"not": "one"}]}}, "others": [{"not": 1}, {"not": 2}],
            "features": [rec(i) for i in range(n)], "after": [{"not": 3}]}


def by_ranges(raw, step, key):
    f = io.BytesIO(raw)
    spots = [(a, min(len(raw), a + step)) for a in range(0, len(raw), step)]
    states, end = D.starts([D.summary(D._Range(f, a, b), key) for a, b in spots], 1 if key else 0)
    assert end == (0, 0)
    return [json.loads(x) for (a, b), s in zip(spots, states) for x in D.cut(f, a, b, len(raw), s, key)]


@pytest.mark.parametrize("step", [1, 2, 3, 7, 50, 333, 10**6])
@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_give_the_records_of_the_whole(step, indent):
    doc = document(12)
    assert by_ranges(json.dumps(doc, ensure_ascii=False, indent=indent).encode(), step, "features") == doc["features"]
    rows = doc["features"] + [{}]
    assert by_ranges(json.dumps([1, "x", [{"no": 0}]] + rows, indent=indent).encode(), step, None) == rows


@pytest.mark.parametrize("step", [5, 10**6])
def test_several_documents_and_empty_ones(step):
    docs = [document(3, 1), {"features": []}, {"other": [{"a": 1}]}, document(2, 2)]
    raw = "\n".join(map(json.dumps, docs)).encode()
    assert by_ranges(raw, step, "features") == docs[0]["features"] + docs[3]["features"]
    assert by_ranges(b"", step, "features") == []


def test_one_document_many_tasks(spark, tmp_path):
    doc = document(800)
    (tmp_path / "big name.geojson").write_text(json.dumps(doc))
    (tmp_path / "small.geojson").write_text(json.dumps({"features": [{"i": 1000}, {"i": 1000}, 7, None]}))
    (tmp_path / "empty.geojson").write_text("")
    df = D.read_records(spark, str(tmp_path), "features", split_bytes=10_000)
    assert df.rdd.getNumPartitions() > 5
    assert sorted(json.loads(r["value"])["i"] for r in df.collect()) == list(range(800)) + [1000, 1000]
    (tmp_path / "cut.geojson").write_text(json.dumps(doc)[:-2000])
    with pytest.raises(Exception, match="unfinished"):
        D.read_records(spark, str(tmp_path / "cut.geojson"), "features").collect()
    with pytest.raises(ValueError, match="unfinished"):
        D.read_records(spark, str(tmp_path / "cut.geojson"), "features", split_bytes=10_000)


def test_tracks_are_the_same_however_read(spark, tmp_path):
    feats = [{"type": "Feature", "properties": {"id": f"B{i % 7}", "time": f"2024-01-{i % 28 + 1:02d}T00:00:00", "length_km": str(i)},
              "geometry": {"type": "Point", "coordinates": [i % 180, -60.5]} if i % 5 else {"type": "Point", "coordinates": []}} for i in range(500)]
    feats.append({"type": "Feature", "properties": {"id": 5, "time": "2024-01-01"}, "geometry": None})
    p = tmp_path / "t.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": feats}, indent=1))
    whole = rd.read_tracks_geojson(spark, str(p), split_bytes=None)
    parts = rd.read_tracks_geojson(spark, str(p), split_bytes=4000)
    key = lambda r: str(r)
    assert sorted(parts.collect(), key=key) == sorted(whole.collect(), key=key) and whole.count() == 400
