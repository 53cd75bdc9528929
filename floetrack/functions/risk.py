"""Risk, alert, score and fuel expressions."""
from pyspark.sql import functions as F

from floetrack.config import PREFERENCE_WEIGHTS, RiskConfig
from floetrack.functions.geo import _c, clamp


def sea_ice_risk(conc):
    """Piecewise concentration risk in [0, 1]; a missing concentration is neutral."""
    c = F.coalesce(_c(conc), F.lit(0.0))
    r = (F.when(c <= 0.15, F.lit(0.0))
         .when(c <= 0.4, 0.2 * (c - 0.15) / 0.25)
         .when(c <= 0.6, 0.2 + 0.4 * (c - 0.4) / 0.2)
         .when(c <= 0.8, 0.6 + 0.3 * (c - 0.6) / 0.2)
         .otherwise(0.9 + 0.1 * (c - 0.8) / 0.2))
    return clamp(r, 0.0, 1.0)


def iceberg_risk(km, cfg=RiskConfig()):
    """Distance risk: 1 inside the exclusion, 0.5 at the buffer, 0 at the reach; missing distance is 0."""
    d = _c(km)
    e, b, r = cfg.exclusion_km, cfg.buffer_km, cfg.reach_km
    if e <= 0:
        return F.coalesce(F.when(d < r, F.lit(1.0)), F.lit(0.0))
    inner = 1.0 - 0.5 * (d - e) / (b - e) if b > e else F.lit(1.0)
    outer = 0.5 * (1.0 - (d - b) / (r - b)) if r > b else F.lit(0.0)
    return F.coalesce(F.when(d < e, F.lit(1.0)).when(d < b, inner).when(d < r, outer), F.lit(0.0))


def iceberg_risk_legacy(km, exclusion=20.0, reach=150.0):
    d = _c(km)
    ring = 0.5 * F.greatest(F.lit(0.0), 1.0 - (d - exclusion) / (reach - exclusion))
    return F.coalesce(F.when(d < exclusion, F.lit(1.0)).when(d < reach, ring), F.lit(0.0))


def weather_severity(wind_ms=None, wind_knots=None, wave_m=None, cfg=RiskConfig()):
    """Wind-only severity (30 m/s = 1), or the worse of wind (knots) and wave height."""
    if wave_m is None and wind_ms is not None:
        return clamp(F.coalesce(_c(wind_ms), F.lit(0.0)) / 30.0, 0.0, 1.0)
    return F.greatest(clamp(_c(wind_knots) / cfg.max_wind_knots, 0.0, 1.0),
                      clamp(_c(wave_m) / cfg.max_wave_m, 0.0, 1.0))


def total_risk(ice, berg, weather, blocked, cfg=RiskConfig()):
    z = lambda x: F.coalesce(_c(x), F.lit(0.0))
    t = cfg.w_ice * z(ice) + cfg.w_iceberg * z(berg) + cfg.w_weather * z(weather)
    return F.when(F.coalesce(_c(blocked), F.lit(False)), F.lit(1.0)).otherwise(clamp(t, 0.0, 1.0))


def blocked(conc, berg_km, limit=None, cfg=RiskConfig()):
    """Vessel limit, sea-ice cap or iceberg block radius exceeded."""
    out = F.lit(False)
    no = F.lit(False)
    if limit is not None:
        out = out | F.coalesce(_c(conc) > _c(limit), no)
    if cfg.ice_block is not None:
        out = out | F.coalesce(_c(conc) > cfg.ice_block, no)
    if cfg.iceberg_block_km is not None and cfg.iceberg_block_km > 0:
        out = out | F.coalesce(_c(berg_km) < cfg.iceberg_block_km, no)
    return out


def risk_level(r):
    r = _c(r)
    return (F.when(r >= 0.8, "extreme").when(r >= 0.6, "high")
            .when(r >= 0.3, "moderate").otherwise("low"))


def level_rank(level):
    return F.array_position(F.array(*[F.lit(x) for x in ("low", "moderate", "high", "extreme")]), _c(level))


def rank_level(rank):
    return F.element_at(F.array(*[F.lit(x) for x in ("low", "moderate", "high", "extreme")]), _c(rank).cast("int"))


def pct(c):
    """Fraction as whole percent text."""
    return F.concat(F.format_string("%.0f", F.round(_c(c) * 100.0, 6)), F.lit("%"))


def waypoint_warnings(lat, lon, risk, berg_km, conc, clearance_km, limit, cfg=RiskConfig()):
    """The warnings of one waypoint in fixed order, as an array of text."""
    lat, lon, risk, berg_km, conc, clearance_km, limit = map(
        _c, (lat, lon, risk, berg_km, conc, clearance_km, limit))
    at = F.format_string("(%.2f, %.2f)", lat, lon)
    level = risk_level(risk)
    items = [
        F.when(level.isin("high", "extreme"),
               F.concat(F.initcap(level), F.format_string(" risk (score %.2f) at ", risk), at, F.lit("."))),
        F.when(berg_km < clearance_km,
               F.concat(F.format_string("Iceberg within minimum clearance of %.0f km at ", clearance_km), at,
                        F.format_string(" (%.1f km).", berg_km))),
        F.when(conc > limit,
               F.concat(F.lit("Sea-ice concentration "), pct(conc), F.lit(" exceeds vessel limit "), pct(limit),
                        F.lit(" at "), at, F.lit("."))),
    ]
    if cfg.ice_high is not None:
        items.append(F.when(conc >= cfg.ice_high,
                            F.concat(F.lit("High sea-ice concentration "), pct(conc),
                                     F.lit(" (forecasting-zone threshold "), pct(F.lit(cfg.ice_high)),
                                     F.lit(") at "), at, F.lit("."))))
    if cfg.warning_radius_km is not None:
        items.append(F.when(berg_km < cfg.warning_radius_km,
                            F.concat(F.lit(f"Iceberg tracking hazard within {cfg.warning_radius_km:.0f} km at "), at,
                                     F.format_string(" (%.1f km).", berg_km))))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def alert_severity(kind, value, cfg=None):
    """Alert severity from iceberg distance (km) or sea-ice concentration."""
    v = _c(value)
    if kind == "iceberg":
        crit = (cfg.iceberg_block_km if cfg else None) or 5.0
        high = (cfg.warning_radius_km if cfg else None) or 15.0
        return (F.when(v < crit, "critical").when(v <= high, "high")
                .when(v <= 30, "medium").otherwise("low"))
    crit = cfg.ice_block if cfg and cfg.ice_block is not None else 0.8
    high = cfg.ice_high if cfg and cfg.ice_high is not None else 0.6
    med = cfg.ice_moderate if cfg and cfg.ice_moderate is not None else 0.3
    return (F.when(v >= crit, "critical").when(v >= high, "high")
            .when(v >= med, "medium").otherwise("low"))


def severity_rank(sev):
    s = _c(sev)
    return (F.when(s == "critical", 0).when(s == "high", 1).when(s.isin("warning", "medium"), 2)
            .when(s == "low", 3).otherwise(4))


def alert_id(kind, route_id, label, lat, lon):
    coord = lambda x: F.coalesce(F.format_string("%.4f", x), F.lit("unavailable"))
    lat, lon = _c(lat), _c(lon)
    return F.concat_ws("-", F.lit(kind), _c(route_id).cast("string"), _c(label),
                       F.when(lat.isNull(), F.lit("unavailable")).otherwise(coord(lat)),
                       F.when(lon.isNull(), F.lit("unavailable")).otherwise(coord(lon)))


def distance_score(err_km, tol_km):
    """100 within tolerance, linear to 0 at twice the tolerance."""
    if tol_km <= 0:
        return F.lit(0.0)
    e = _c(err_km)
    return F.coalesce(F.round(clamp((2.0 * tol_km - e) / tol_km * 100.0, 0.0, 100.0), 4), F.lit(0.0))


def fuel_rate(rates, speed, cruise=None, max_speed=None, lph=None):
    """Tons per day from a map keyed by speed or phase, else from litres per hour; NULL without either."""
    m, s = _c(rates), _c(speed)
    keys = F.map_keys(m)
    numeric = (F.size(m) > 0) & F.forall(keys, lambda k: k.try_cast("double").isNotNull())
    phased = (F.size(m) > 0) & F.forall(keys, lambda k: k.isin("slow_speed", "cruise_speed", "max_speed"))
    near = F.array_min(F.transform(F.map_entries(m), lambda e: F.struct(
        F.abs(e["key"].try_cast("double") - s).alias("d"), e["key"].try_cast("double").alias("k"),
        e["value"].alias("v"))))["v"]
    cr = F.coalesce(_c(cruise) if cruise is not None else F.lit(None).cast("double"), s)
    mx = F.coalesce(_c(max_speed) if max_speed is not None else F.lit(None).cast("double"), cr)
    phase = (F.when((mx > cr) & (s >= mx), F.lit("max_speed")).when(s >= cr, F.lit("cruise_speed"))
             .otherwise(F.lit("slow_speed")))
    by_lph = (_c(lph) if lph is not None else F.lit(None).cast("double")) * (24.0 * 0.85 / 1000.0)
    return F.when(numeric, near).when(phased, F.try_element_at(m, phase)).otherwise(by_lph)


def travel_hours(km, speed_knots):
    return F.try_divide(_c(km) / 1.852, F.nullif(F.greatest(_c(speed_knots), F.lit(0.0)), F.lit(0.0)))


def fuel_for(km, speed_knots, rate):
    return _c(rate) * travel_hours(km, speed_knots) / 24.0


def preference_weights(pref, cfg=RiskConfig()):
    """struct(safety, distance) weights of a route preference; NULL when unknown."""
    p = _c(pref)
    total = (cfg.safety_weight + cfg.distance_weight) or 1.0
    out = F.when(p == "recommended", F.struct(F.lit(cfg.safety_weight / total).alias("safety"),
                                              F.lit(cfg.distance_weight / total).alias("distance")))
    for k, (s, d) in PREFERENCE_WEIGHTS.items():
        out = out.when(p == k, F.struct(F.lit(s).alias("safety"), F.lit(d).alias("distance")))
    return out


def route_valid(n, all_inside, any_land, any_blocked):
    return (_c(n) >= 2) & _c(all_inside) & ~_c(any_land) & ~_c(any_blocked)
