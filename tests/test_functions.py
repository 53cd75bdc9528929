"""Hand-computed values of the scalar functions."""
import math

import pytest
from pyspark.sql import functions as F

from floetrack.config import DEPLOYED, POLAR_GRIDS, RiskConfig
from floetrack.functions import geo, risk
from floetrack.functions import values as val


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def lit(*xs):
    return [F.lit(x) for x in xs]


def test_haversine_madrid_rome(spark):
    km = one(spark, geo.haversine(*lit(40.4168, -3.7038, 41.9028, 12.4964)))[0]
    assert 1362 <= km <= 1370


def test_haversine_null_is_null(spark):
    assert one(spark, geo.haversine(F.lit(None).cast("double"), *lit(0.0, 1.0, 1.0)))[0] is None


def test_plane_round_trip_and_degree(spark):
    p = geo.to_plane(*lit(-70.3, 160.4, -70.0, 160.0))
    r = one(spark, p.alias("p")).p
    q = one(spark, geo.from_plane(*lit(r.x, r.y, -70.0, 160.0)).alias("q")).q
    assert abs(q.lat + 70.3) < 1e-9 and abs(q.lon - 160.4) < 1e-9
    assert one(spark, geo.haversine(*lit(0.0, 0.0, 0.0, 1.0)))[0] == pytest.approx(111.1949, abs=1e-3)


def test_intermediate_same_point(spark):
    p = one(spark, geo.intermediate(*lit(-60.0, 10.0, -60.0, 10.0, 0.4)).alias("p")).p
    assert (p.lat, p.lon) == (-60.0, 10.0)


@pytest.mark.parametrize("text,deg", [("N", 0.0), (" sw ", 225.0), ("370", 10.0), ("-10", 350.0), ("45°", 45.0), ("up", None)])
def test_compass(spark, text, deg):
    assert one(spark, geo.compass_to_deg(F.lit(text)))[0] == deg


def test_calm_wind_reads_180(spark):
    w = one(spark, geo.wind_from_uv(*lit(0.0, 0.0)).alias("w")).w
    assert (w.speed, w.direction) == (0.0, 180.0)
    assert one(spark, geo.wind_from_uv(*lit(10.0, 0.0)).alias("w")).w.direction == pytest.approx(270.0)


def test_cell_index_ties_go_low(spark):
    r = one(spark, geo.cell_index(F.lit(-74.0), -74.5, 1.0, 5), geo.cell_index(F.lit(99.0), -74.5, 1.0, 5),
            geo.cell_index(F.lit(None).cast("double"), -74.5, 1.0, 5))
    assert (r[0], r[1], r[2]) == (0, 4, None)


def test_polar_projection_matches_known_point(spark):
    g = POLAR_GRIDS["3125m"]
    p = one(spark, geo.polar_xy(*lit(-90.0, 0.0), g["a"], g["b"], g["lat_ts"]).alias("p"),
            geo.polar_xy(*lit(-70.0, 0.0), g["a"], g["b"], g["lat_ts"]).alias("q"))
    assert abs(p.p.x) < 1e-6 and abs(p.p.y) < 1e-6
    # at the true-scale latitude rho equals a * m(70)
    e2 = 1 - (g["b"] / g["a"]) ** 2
    rho = g["a"] * math.cos(math.radians(70)) / math.sqrt(1 - e2 * math.sin(math.radians(70)) ** 2)
    assert p.q.y == pytest.approx(rho, rel=1e-9)


@pytest.mark.parametrize("c,r", [(0.1, 0.0), (0.15, 0.0), (0.4, 0.2), (0.6, 0.6), (0.8, 0.9), (1.0, 1.0), (None, 0.0)])
def test_sea_ice_risk_breaks(spark, c, r):
    assert one(spark, risk.sea_ice_risk(F.lit(c).cast("double")))[0] == pytest.approx(r)


@pytest.mark.parametrize("d,r", [(0.5, 1.0), (19.99, 1.0), (20.0, 1.0), (25.0, 0.75), (30.0, 0.5), (90.0, 0.25), (150.0, 0.0), (None, 0.0)])
def test_iceberg_risk(spark, d, r):
    assert one(spark, risk.iceberg_risk(F.lit(d).cast("double")))[0] == pytest.approx(r)


def test_iceberg_risk_zero_width_guards(spark):
    flat = RiskConfig(exclusion_km=20, buffer_km=20, reach_km=20)
    assert one(spark, risk.iceberg_risk(F.lit(21.0), flat))[0] == 0.0
    none = RiskConfig(exclusion_km=0)
    assert [one(spark, risk.iceberg_risk(F.lit(x), none))[0] for x in (10.0, 150.0)] == [1.0, 0.0]


@pytest.mark.parametrize("r,level", [(0.1, "low"), (0.45, "moderate"), (0.75, "high"), (0.95, "extreme")])
def test_levels(spark, r, level):
    assert one(spark, risk.risk_level(F.lit(r)))[0] == level


def test_vessel_limit_blocks(spark):
    cfg = RiskConfig(ice_block=None)
    assert one(spark, risk.blocked(F.lit(0.9), F.lit(99.0), F.lit(0.6), cfg))[0] is True
    assert one(spark, risk.blocked(F.lit(0.5), F.lit(99.0), F.lit(0.6), cfg))[0] is False
    assert one(spark, risk.blocked(F.lit(None).cast("double"), F.lit(5.0), F.lit(0.6), DEPLOYED))[0] is True


def test_total_risk(spark):
    assert one(spark, risk.total_risk(*lit(0.5, 0.5, 0.5), F.lit(False)))[0] == pytest.approx(0.5)
    assert one(spark, risk.total_risk(*lit(0.0, 0.0, 0.0), F.lit(True)))[0] == 1.0


def test_fuel_rates(spark):
    phases = F.create_map(*lit("cruise_speed", 28.0, "max_speed", 45.0, "slow_speed", 18.0))
    rate = lambda s: one(spark, risk.fuel_rate(phases, F.lit(s), F.lit(12.0), F.lit(16.0)))[0]
    assert [rate(8.0), rate(12.0), rate(16.0)] == [18.0, 28.0, 45.0]
    numeric = F.create_map(*lit("10", 20.0, "14", 30.0))
    assert one(spark, risk.fuel_rate(numeric, F.lit(12.0)))[0] == 20.0        # the lower key on a tie
    none = F.lit(None).cast("map<string,double>")
    assert one(spark, risk.fuel_rate(none, F.lit(12.0), lph=F.lit(1000.0)))[0] == pytest.approx(20.4)
    assert one(spark, risk.fuel_rate(none, F.lit(12.0)))[0] is None
    assert one(spark, risk.fuel_for(F.lit(222.24), F.lit(10.0), F.lit(24.0)))[0] == pytest.approx(12.0)


@pytest.mark.parametrize("km,score", [(0.0, 100.0), (20.0, 100.0), (30.0, 50.0), (40.0, 0.0), (99.0, 0.0), (None, 0.0)])
def test_distance_score(spark, km, score):
    assert one(spark, risk.distance_score(F.lit(km).cast("double"), 20.0))[0] == score


def test_waypoint_warnings_texts(spark):
    w = one(spark, risk.waypoint_warnings(*lit(-65.0, 10.0, 0.85, 5.0, 0.7, 20.0, 0.6), DEPLOYED))[0]
    assert w == ["Extreme risk (score 0.85) at (-65.00, 10.00).",
                 "Iceberg within minimum clearance of 20 km at (-65.00, 10.00) (5.0 km).",
                 "Sea-ice concentration 70% exceeds vessel limit 60% at (-65.00, 10.00).",
                 "High sea-ice concentration 70% (forecasting-zone threshold 60%) at (-65.00, 10.00).",
                 "Iceberg tracking hazard within 60 km at (-65.00, 10.00) (5.0 km)."]


def test_alert_thresholds_follow_config(spark):
    sev = lambda k, x, cfg=None: one(spark, risk.alert_severity(k, F.lit(x), cfg))[0]
    assert [sev("iceberg", x) for x in (4.9, 15.0, 30.0, 30.1)] == ["critical", "high", "medium", "low"]
    assert sev("iceberg", 19.0, DEPLOYED) == "critical" and sev("iceberg", 60.0, DEPLOYED) == "high"
    assert sev("sea-ice", 0.82, DEPLOYED) == "high" and sev("sea-ice", 0.82) == "critical"


def test_preference_weights(spark):
    w = one(spark, *[risk.preference_weights(F.lit(p)).alias(p) for p in ("recommended", "safest", "unknown")])
    assert tuple(w.recommended) == (0.6, 0.4) and tuple(w.safest) == (1.0, 0.0) and w.unknown is None


def test_extract_ids(spark):
    t = "compare b09-A123? no: ABC123 and abc123, then DEMO and XY-9999 and QQ-B777"
    assert one(spark, val.extract_ids(F.lit(t)))[0] == ["ABC123", "XY-9999"]


def test_numbers_and_times(spark):
    r = one(spark, val.to_number(F.lit("x")), val.to_number(F.lit("NaN")), val.to_number(F.lit("1e400")), val.to_number(F.lit(" 2.5 ")),
            val.parse_time(F.lit("2024-01-02T03:04:05Z")), val.parse_time(F.lit("bad")), val.file_date(F.lit("a-20240203-v5.nc")),
            val.file_date(F.lit("none.nc")))
    assert [r[0], r[1], r[2], r[3]] == [None, None, None, 2.5]
    assert str(r[4]) == "2024-01-02 03:04:05" and r[5] is None and str(r[6]) == "2024-02-03 00:00:00" and r[7] is None


def test_doy_and_season(spark):
    d = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' t")
    r = d.select(geo.sin_cos_doy("t").alias("s"), geo.season("t")).first()
    assert r.s.sin_doy == pytest.approx(0.5) and r.s.cos_doy == pytest.approx(1.0) and r[1] == "summer"
