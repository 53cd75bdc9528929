"""Sample points of routes: where they are made, and what the nearest join does with them."""
import math

import pytest

from floetrack.operators import joins as j
from floetrack.operators import nearest as nr
from floetrack.operators import routes as r


@pytest.fixture()
def waypoints(spark):
    rows = [(k, i, -70.0 + i * 0.5 + k * 0.1, 10.0 + i * 1.5 - k) for k in range(6) for i in range(1 + k % 4)]
    return spark.createDataFrame(rows, "route_id long, wp_index int, latitude double, longitude double")


@pytest.fixture()
def bergs(spark):
    return spark.createDataFrame([(f"B{i}", -69.5 + (i % 7) * 0.3, 8.0 + (i % 11) * 0.7) for i in range(40)], "iceberg_id string, latitude double, longitude double")


def km(a, b):
    (p, x), (q, y) = ([math.radians(v) for v in c] for c in (a, b))
    return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2))


def sampled(waypoints, n):
    by = {}
    for w in sorted(waypoints.collect(), key=lambda w: (w.route_id, w.wp_index)):
        by.setdefault(w.route_id, []).append((w.latitude, w.longitude))
    return {k: [(a[0] + (b[0] - a[0]) * s / n, a[1] + (b[1] - a[1]) * s / n) for a, b in zip(p, p[1:]) for s in range(n)] + [p[-1]] for k, p in by.items()}


def test_listed_pairs_meet_segments_not_sample_points(spark, waypoints, bergs):
    pairs = spark.createDataFrame([(1, "B3"), (2, "B5"), (2, "B5"), (3, "none"), (0, "B1"), (9, "B1")], "route_id long, iceberg_id string")
    d = j.route_distance(waypoints, bergs, "iceberg_id", pairs=pairs)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate explode"):]
    assert below.count("Join Inner") == 2, plan            # no sample point is sorted or shuffled for a join
    at = {b.iceberg_id: (b.latitude, b.longitude) for b in bergs.collect()}
    pts = sampled(waypoints, 50)
    want = sorted((k, b, s, None if s != "ok" else round(min(km(x, at[b]) for x in pts[k]), 6))
                  for k, b, s in [(1, "B3", "ok"), (2, "B5", "ok"), (2, "B5", "ok"), (3, "none", "not_found"), (0, "B1", "invalid"), (9, "B1", "invalid")])
    got = sorted((x.route_id, x.iceberg_id, x.status, None if x.distance_km is None else round(x.distance_km, 6)) for x in d.collect())
    assert got == want


@pytest.mark.parametrize("short", [0, 250_000])
def test_nearest_hazard_with_short_and_long_lists(waypoints, bergs, monkeypatch, short):
    monkeypatch.setattr(nr, "SHORT_LISTS", short)
    d = j.nearest_hazard(j.route_samples(waypoints, 5), bergs, ["iceberg_id"])
    assert ("BroadcastHashJoin [_k" in d._jdf.queryExecution().executedPlan().toString()) == (short > 0)
    at = [((b.latitude, b.longitude), b.iceberg_id) for b in bergs.collect()]
    want = {k: min((round(km(x, p), 6), i) for x in xs for p, i in at) for k, xs in sampled(waypoints, 5).items()}
    assert {x.route_id: (round(x.distance_km, 6), x.iceberg_id) for x in d.collect()} == want


def test_alerts_compute_segments_once(spark, waypoints, bergs):
    ice = bergs.selectExpr("latitude", "longitude", "0.5D as sic")
    routes = waypoints.selectExpr("route_id", "'main' as label").distinct()
    d = r.route_alerts(routes, waypoints, ice, bergs)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(" not in plan, plan                       # read from the written table
    assert d.count() == 12
