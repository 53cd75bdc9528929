"""The nearest join against brute force, with clusters, duplicates, poles and the date line."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from floetrack.operators import joins as j
from floetrack.operators.nearest import nearest_join


def hav(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    s = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(s, 0, 1)))


def brute(q, s, window=None, metric="sphere"):
    out = {}
    for i, la, lo, *w in q:
        best = None
        for sid, sla, slo in s:
            if window and not (w[0] <= slo <= w[1]):
                continue
            d = float(hav(la, lo, sla, slo)) if metric == "sphere" else math.hypot(sla - la, slo - lo)
            k = (round(d, 6), sid)
            if best is None or k < best:
                best = k
        if best:
            out[i] = best
    return out


def frames(spark, q, s):
    qc = "qid long, qlat double, qlon double" + (", wlo double, whi double" if len(q[0]) > 3 else "")
    return spark.createDataFrame(q, qc), spark.createDataFrame(s, "sid long, lat double, lon double")


@pytest.mark.parametrize("metric", ["sphere", "plane"])
@pytest.mark.parametrize("levels", [None, 2, 5])
def test_against_brute_force(spark, metric, levels):
    rng = np.random.default_rng(3)
    q = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(150)] + [(900, -90.0, 0.0), (901, 90.0, 5.0), (902, -65.0, 180.0)]
    s = [(i, float(rng.uniform(-80, -50)), float(rng.uniform(-180, 180))) for i in range(80)]
    # a third of the sites in one tight cluster, and copies of one position
    s += [(200 + i, -61.0 + i * 1e-5, 33.0 + i * 1e-5) for i in range(60)] + [(400 + i, -55.0, -179.9) for i in range(40)]
    qd, sd = frames(spark, q, s)
    got = nearest_join(qd, "qid", "qlat", "qlon", sd, "lat", "lon", ["sid"], metric=metric, levels=levels, dist="d")
    got = {r.qid: (round(r.d, 6), r.sid) for r in got.collect()}
    assert got == brute(q, s, metric=metric)


def test_longitude_window(spark):
    rng = np.random.default_rng(5)
    q = []
    for i in range(100):
        lo = float(rng.uniform(-180, 180))
        q.append((i, float(rng.uniform(-80, -50)), lo, lo - 10.0, lo + 10.0))
    s = [(i, float(rng.uniform(-80, -50)), float(rng.uniform(-180, 180))) for i in range(40)]
    qd, sd = frames(spark, q, s)
    got = nearest_join(qd, "qid", "qlat", "qlon", sd, "lat", "lon", ["sid"], window=("wlo", "whi"), dist="d")
    assert {r.qid: (round(r.d, 6), r.sid) for r in got.collect()} == brute(q, s, window=True)


def test_empty_sites(spark):
    qd, sd = frames(spark, [(1, 0.0, 0.0)], [(1, 0.0, 0.0)])
    assert nearest_join(qd, "qid", "qlat", "qlon", sd.filter("sid < 0"), "lat", "lon", ["sid"]).count() == 0


def test_nearest_navigable_uses_the_wrapped_window(spark):
    """Land everywhere in the linear window; the sea lies just across the date line."""
    cells = [(float(la), float(lo), not (lo <= -160)) for la in range(-70, -64) for lo in range(-180, 180, 10)]
    g = spark.createDataFrame(cells, "latitude double, longitude double, is_land boolean")
    p = spark.createDataFrame([(1, -68.0, 169.0), (2, -68.0, 0.0), (3, -68.0, -170.0)], "pid long, latitude double, longitude double")
    out = {r.pid: (r.nav_lon, None if r.nav_km is None else round(r.nav_km, 3)) for r in j.nearest_navigable(p, "pid", g).collect()}
    assert out[1][0] == -180.0 and out[1][1] == round(float(hav(-68.0, 169.0, -68.0, -180.0)), 3)
    assert out[2] == (None, None) and out[3] == (-170.0, 0.0)


def test_route_distance_cases(spark):
    w = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 2.0, 0.0), (1, 2, 2.0, 2.0), (2, 0, 0.0, 0.0), (2, 1, 0.0, 2.0), (3, 0, 0.0, 0.0)],
                              "route_id int, wp_index int, latitude double, longitude double")
    p = spark.createDataFrame([("a", 1.0, 0.0), ("b", 1.0, 1.0)], "iceberg_id string, latitude double, longitude double")
    pairs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "route_id int, iceberg_id string")
    r = {x.route_id: (x.distance_km, x.status) for x in j.route_distance(w, p, "iceberg_id", pairs=pairs).collect()}
    assert r[1][0] == pytest.approx(0.0, abs=1e-6) and r[2][0] == pytest.approx(111.195, abs=0.01)
    assert r[3] == (None, "invalid")


def test_env_join_on_irregular_axes(spark):
    """Irregular axes take the range-table path; results equal the nearest value with ties to the lower one."""
    from floetrack.operators.axes import grid_axes
    lats, lons, days = [-75.0, -74.2, -70.0, -61.5], [-180.0, -100.0, 3.0], [1, 2, 9]
    rows = [(f"2024-01-{d:02d} 00:00:00", la, lo, float(d * 1000 + i * 10 + k)) for d in days for i, la in enumerate(lats) for k, lo in enumerate(lons)]
    g = spark.createDataFrame(rows, "t string, latitude double, longitude double, sic double").selectExpr(
        "cast(t as timestamp_ntz) obs_time", "latitude", "longitude", "sic")
    assert not grid_axes(g)["latitude"].regular
    q = [(1, "2024-01-01 12:00:00", -74.6, -140.0), (2, "2024-01-05 12:00:00", -65.75, 179.0), (3, "2024-02-01 00:00:00", -10.0, -48.5)]
    t = spark.createDataFrame(q, "event_id int, t string, latitude double, longitude double").selectExpr(
        "event_id", "cast(t as timestamp_ntz) obs_time", "latitude", "longitude")
    out = {r.event_id: (r.sic, r.x_gap_hours, r.x_stale) for r in j.env_join(t, g, ["sic"], "x", 96.0).collect()}
    assert out[1] == (1000.0, 12.0, 0)            # all three ties go to the lower value
    assert out[2] == (2022.0, 84.0, 0)
    assert out[3] == (None, 552.0, 1)
