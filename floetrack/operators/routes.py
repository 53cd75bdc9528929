"""Risk grids, route scoring, alerts and positions along routes."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from floetrack.config import DEPLOYED, KM_TO_NM_ALERT, NM_TO_KM, R_NM, RiskConfig
from floetrack.functions import geo, risk
from floetrack.functions.values import rnd
from floetrack.operators import ordered as od
from floetrack.operators.axes import grid_axes
from floetrack.operators.grids import regrid_nearest
from floetrack.operators.joins import iceberg_positions, nearest_hazard, sample_grid, sample_segments, segment_points
from floetrack.operators.nearest import nearest_join
from floetrack.operators.stats import attach
from floetrack.session import materialize

CELL = ["latitude", "longitude"]


def risk_grid(grid, ice=None, bergs=None, weather=None, land=None, cfg=DEPLOYED, limit=None, levels=None):
    """Risk layers per cell: concentration, iceberg distance, the three risks, hazard block, land and total.

    ``grid`` has ``cell_id, latitude, longitude``. ``ice`` is one snapshot ``(latitude, longitude, sic)`` on its own axes,
    ``bergs`` positions, ``weather`` scattered ``(wx_id, latitude, longitude, wind_speed)``, ``land`` a mask on the grid's
    cells. Without weather its risk is neutral. ``limit`` adds one vessel's concentration limit; for many vessels leave it
    out and let ``score_waypoints`` apply each vessel's limit, so the grid is not repeated per vessel.
    """
    out = grid
    if ice is not None:
        out = regrid_nearest(ice, out, ["sic"]).withColumnRenamed("sic", "_c")
        out = out.withColumn("concentration", F.when(F.col("_c").isNotNull(), geo.clamp("_c", 0.0, 1.0))).drop("_c")
    else:
        out = out.withColumn("concentration", F.lit(None).cast("double"))
    if bergs is not None:
        hit = nearest_join(out, "cell_id", *CELL, iceberg_positions(bergs), *CELL, ["iceberg_id"], dist="iceberg_km",
                           levels=levels).select("cell_id", "iceberg_km")
        out = out.join(hit, "cell_id", "left")
    else:
        out = out.withColumn("iceberg_km", F.lit(None).cast("double"))
    if weather is not None:
        hit = nearest_join(out, "cell_id", *CELL, weather, *CELL, ["wx_id"], ["wind_speed"], metric="plane", dist="_deg",
                           levels=levels).select("cell_id", "wind_speed")
        out = out.join(hit, "cell_id", "left").withColumn("weather_risk", risk.weather_severity(wind_ms="wind_speed")).drop("wind_speed")
    else:
        out = out.withColumn("weather_risk", F.lit(0.0))
    if land is not None:
        out = out.join(land.select(*CELL, F.col("is_land").alias("_l")), CELL, "left").withColumn(
            "is_land", F.coalesce("_l", F.lit(False))).drop("_l")
    elif "is_land" not in out.columns:
        out = out.withColumn("is_land", F.lit(False))
    out = (out.withColumn("ice_risk", risk.sea_ice_risk("concentration"))
           .withColumn("iceberg_risk", risk.iceberg_risk("iceberg_km", cfg))
           .withColumn("blocked", risk.blocked("concentration", "iceberg_km", None if limit is None else F.lit(limit), cfg)))
    return out.withColumn("total_risk", risk.total_risk("ice_risk", "iceberg_risk", "weather_risk",
                                                        F.col("is_land") | F.col("blocked"), cfg))


def risk_notes(grid, cfg=DEPLOYED, has_weather=True):
    """Notes on a finished risk grid: missing sea ice, hazard blocks, weather source, land."""
    c = grid.agg(F.count_if(F.col("concentration").isNull()).alias("miss"),
                 F.count_if((F.col("concentration") > cfg.ice_block) & ~F.coalesce(
                     F.col("iceberg_km") < (cfg.iceberg_block_km or 0.0), F.lit(False))).alias("ice_new"),
                 F.count_if("is_land").alias("land"))
    s = lambda n: F.col(n).cast("string")
    items = [
        F.when(F.col("miss") > 0, F.concat(s("miss"), F.lit(" grid cells have no sea-ice observation (nodata). They are treated as "
                                                           "neutral open water, not as land."))),
        F.lit(f"Iceberg exclusion zones are hard-blocked within {cfg.iceberg_block_km:g} km (No-Go).") if cfg.iceberg_block_km else
        F.lit(None).cast("string"),
        F.when(F.col("ice_new") > 0, F.concat(F.lit("Sea-ice No-Go zones applied: "), s("ice_new"), F.lit(" cells above "),
                                              risk.pct(F.lit(cfg.ice_block)), F.lit(" concentration are avoided."))),
        F.lit("Weather severity derived from the newest real wind field." if has_weather else
              "No real weather severity available; routing used a neutral baseline instead of synthetic data."),
        F.concat(F.lit("Land mask: "), s("land"), F.lit(" cells marked land."))]
    return c.select(F.filter(F.array(*items), lambda x: x.isNotNull()).alias("notes"))


def grid_counts(grid, cfg=DEPLOYED):
    """One row: land, blocked, newly ice-blocked, missing and hazardous cells."""
    berg = F.coalesce(F.col("iceberg_km") < (cfg.iceberg_block_km or 0.0), F.lit(False))
    ice = F.coalesce(F.col("concentration") > cfg.ice_block, F.lit(False))
    return grid.agg(F.count(F.lit(1)).alias("cells"), F.count_if("is_land").alias("land_cells"),
                    F.count_if("blocked").alias("blocked_cells"), F.count_if(ice & ~berg).alias("newly_ice_blocked"),
                    F.count_if(F.col("concentration").isNull()).alias("missing_cells"),
                    F.count_if(F.col("total_risk") >= cfg.max_risk).alias("obstacle_cells"))


def hazard_config(spark, cfg=DEPLOYED, vessel_max=None, tracked=None):
    """One row with the hazard thresholds as nested columns."""
    d = lambda x: F.lit(x).cast("double")
    return spark.range(1).select(
        F.struct(d(cfg.ice_block).alias("block_threshold"), d(cfg.ice_high).alias("high_risk_threshold"),
                 d(cfg.ice_moderate).alias("moderate_risk_threshold"), d(cfg.max_safe_concentration).alias("max_safe_concentration"),
                 d(vessel_max).alias("vessel_max_concentration")).alias("sea_ice"),
        F.struct(d(cfg.iceberg_block_km).alias("block_radius_km"), d(cfg.warning_radius_km or cfg.buffer_km).alias("warning_radius_km"),
                 F.lit(cfg.horizon_hours).alias("prediction_horizon_hours"), F.lit(tracked).cast("long").alias("tracked_icebergs")).alias("iceberg"),
        F.struct(d(cfg.w_ice).alias("sea_ice_concentration"), d(cfg.w_iceberg).alias("iceberg_proximity"),
                 d(cfg.w_weather).alias("weather_severity")).alias("risk_weights"),
        F.struct(d(cfg.safety_weight).alias("safety"), d(cfg.distance_weight).alias("distance")).alias("objective_weights"),
        d(cfg.max_risk).alias("max_risk_ratio"))


def explanation(notes, cfg=DEPLOYED):
    """Notes plus the hazard rules in force, without repeats, in order."""
    lines = []
    if cfg.iceberg_block_km is not None:
        lines.append(f"Iceberg tracking hazards are avoided with a hard no-go zone ({cfg.iceberg_block_km:g} km).")
    if cfg.ice_block is not None:
        high = f"{cfg.ice_high:.0%}" if cfg.ice_high is not None else "not configured"
        lines.append(f"Sea-ice forecasting zones above {cfg.ice_block:.0%} concentration are avoided as no-go; "
                     f"high-risk crossings ({high}) are warned.")
    return notes.withColumn("explanation", F.array_distinct(F.concat("notes", F.array(*[F.lit(x) for x in lines]).cast("array<string>"))))


def route_segments(waypoints, route="route_id", order="wp_index", chunk=od.AUTO):
    """Previous position, segment and running length (km) of every waypoint, from the raw waypoints alone."""
    wp = waypoints.select(route, order, *CELL)
    width = od.chunk_width(wp, [route], [order], chunk)
    h = od.with_halo(wp, [route], [order], width, before=1)
    w = od.window([route], [order], width)
    h = od.drop_halo(h.withColumn("prev_latitude", F.lag("latitude").over(w)).withColumn("prev_longitude", F.lag("longitude").over(w)),
                     keep_chunk=True)
    h = h.withColumn("segment_km", F.coalesce(geo.haversine("prev_latitude", "prev_longitude", *CELL), F.lit(0.0)))
    h = h.withColumn("_run", od.running_sum("segment_km", [route], [order], width))
    h = od.with_prefix(h, [route], width, sums=["segment_km"])
    return (h.withColumn("cumulative_km", F.col("segment_km_before") + F.col("_run"))
            .withColumnRenamed("segment_km_total", "total_km").drop("_run", "segment_km_before", od.CHUNK))


def score_waypoints(waypoints, grid, routes, vessels, cfg=DEPLOYED, axes=None, chunk=od.AUTO):
    """Waypoints with segment and running distance, heading, time, fuel and the sampled risk of their cell.

    ``routes`` has (route_id, vessel_id); ``vessels`` has (vessel_id, cruise_speed_knots, rate, max_concentration, clearance_km).
    A vessel's own concentration limit is applied to the sampled cell. The grid is joined last, once for the waypoint
    and once for its predecessor, so the window work never carries it.
    """
    grid = materialize(grid)            # read twice below; bounded by the navigation cells
    ax = axes or grid_axes(grid, ("latitude", "longitude"))
    v = vessels.select("vessel_id", F.coalesce("cruise_speed_knots", F.lit(12.0)).alias("speed_knots"), "rate",
                       "max_concentration", "clearance_km")
    # vessels meet the routes, not the many waypoints of a busy vessel: those are shuffled by route only
    s = route_segments(waypoints, chunk=chunk).join(routes.select("route_id", "vessel_id").join(v, "vessel_id", "left"), "route_id")
    la, lo = ax["latitude"].values, ax["longitude"].values
    s = s.withColumn("inside", F.col("latitude").between(la[0], la[-1]) & F.col("longitude").between(lo[0], lo[-1]))
    s = sample_grid(s, grid, ["concentration", "iceberg_km", "total_risk", "is_land", "blocked"], ax)
    before = grid.select(*CELL, F.col("concentration").alias("_pc"), F.col("total_risk").alias("_pr"))
    s = sample_grid(s, before, ["_pc", "_pr"], ax, "prev_latitude", "prev_longitude")
    over = lambda c: F.coalesce(F.col(c) > F.col("max_concentration"), F.lit(False))
    risk_of = lambda c, t: F.when(over(c), F.lit(1.0)).otherwise(F.coalesce(t, F.lit(0.0)))
    s = (s.withColumn("blocked", F.coalesce("blocked", F.lit(False)) | over("concentration"))
         .withColumn("is_land", F.coalesce("is_land", F.lit(False)))
         .withColumn("risk_score", risk_of("concentration", "total_risk"))
         .withColumn("segment_risk", F.when(F.col("prev_latitude").isNotNull(),
                                            F.greatest("risk_score", risk_of("_pc", "_pr")))))
    nm = F.col("cumulative_km") / NM_TO_KM
    return s.select(
        "route_id", "wp_index", "vessel_id", "latitude", "longitude", "inside", "is_land", "blocked", "speed_knots", "rate",
        "max_concentration", "clearance_km", "concentration", "iceberg_km", "risk_score",
        risk.risk_level("risk_score").alias("risk_level"), "segment_km", (F.col("segment_km") / NM_TO_KM).alias("segment_nm"),
        F.coalesce(geo.bearing("prev_latitude", "prev_longitude", *CELL), F.lit(0.0)).alias("heading_deg"), "segment_risk",
        "cumulative_km", (nm / F.col("speed_knots")).alias("elapsed_hours"),
        (F.col("rate") * nm / F.col("speed_knots") / 24.0).alias("fuel_tons"))


def route_rollup(scored, cfg=DEPLOYED):
    """Route totals from scored waypoints: distance, time, fuel, distance-weighted risk, worst level, warning count, validity.

    The weighted risk takes the worse end of each segment; a route without length takes its last point's risk.
    A waypoint counts as blocked when its risk reaches the obstacle threshold. Warnings are those of the waypoints
    plus one per waypoint outside the grid, on land or blocked; equal texts count once.
    """
    obstacle = F.col("risk_score") >= cfg.max_risk
    warn = risk.waypoint_warnings("latitude", "longitude", "risk_score", "iceberg_km", "concentration", "clearance_km",
                                  "max_concentration", cfg)
    tag = F.concat(F.lit("Waypoint "), F.col("wp_index").cast("string"), F.format_string(" (%.2f, %.2f)", "latitude", "longitude"))
    own = F.filter(F.array(F.when(~F.col("inside"), F.concat(tag, F.lit(" is outside the grid."))),
                           F.when(F.col("inside") & F.col("is_land"), F.concat(tag, F.lit(" lies on land."))),
                           F.when(obstacle, F.concat(tag, F.lit(" is blocked.")))), lambda x: x.isNotNull())
    s = scored.withColumn("_warn", F.concat(warn, own))
    base = s.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("n_waypoints"), F.max("vessel_id").alias("vessel_id"), F.sum("segment_km").alias("_km"),
        F.max("elapsed_hours").alias("_h"), F.max("fuel_tons").alias("_f"),
        F.sum(F.col("segment_nm") * F.col("segment_risk")).alias("_wr"), F.sum("segment_nm").alias("_w"),
        F.max_by("risk_score", "wp_index").alias("_last"), F.max(risk.level_rank("risk_level")).alias("_lvl"),
        F.bool_and("inside").alias("_in"), F.bool_or(F.col("is_land") & F.col("inside")).alias("_land"), F.bool_or(obstacle).alias("_blk"))
    # distinct warning texts per route: a shuffle of texts, never a list of them
    nwarn = (s.select("route_id", F.explode("_warn").alias("_t")).distinct().groupBy("route_id").agg(F.count(F.lit(1)).alias("_nw")))
    out = base.join(nwarn, "route_id", "left")
    few = F.col("n_waypoints") < 2
    return out.select(
        "route_id", "vessel_id", "n_waypoints", rnd("_km", 2).alias("distance_km"), rnd(F.col("_km") / NM_TO_KM, 2).alias("distance_nm"),
        rnd("_h", 2).alias("travel_time_hours"), rnd("_f", 2).alias("fuel_tons"),
        rnd(F.when(F.col("_w") > 0, F.col("_wr") / F.col("_w")).otherwise(F.col("_last")), 4).alias("risk_score"),
        risk.rank_level("_lvl").alias("max_risk_level"),
        (F.coalesce("_nw", F.lit(0)) + F.when(few, 1).otherwise(0)).alias("n_warnings"),
        risk.route_valid("n_waypoints", F.col("_in"), F.col("_land"), F.col("_blk")).alias("valid"))


def route_warnings(scored, cfg=DEPLOYED):
    """Distinct warning texts of every route with the first waypoint they appear at."""
    warn = risk.waypoint_warnings("latitude", "longitude", "risk_score", "iceberg_km", "concentration", "clearance_km",
                                  "max_concentration", cfg)
    return (scored.select("route_id", "wp_index", F.explode(warn).alias("warning"))
            .groupBy("route_id", "warning").agg(F.min("wp_index").alias("first_wp")))


def route_alerts(routes, waypoints, ice=None, bergs=None, cfg=None, levels=None):
    """One sea-ice and one iceberg alert per route; ``info`` rows where a source is missing or empty.

    ``routes`` has (route_id, label). The sea-ice alert reports the nearest observed cell, not the worst one.
    """
    if ice is not None or bergs is not None:      # written once: each source reads the sample points twice
        samples = segment_points(materialize(sample_segments(waypoints)), 5, "route_id")
    up = F.upper("severity")
    out = []
    for kind, src in (("sea-ice", ice), ("iceberg", bergs)):
        if src is not None:
            if kind == "sea-ice":
                hit = nearest_hazard(samples, src.filter("sic is not null"), ["_la", "_lo"], ["sic"], levels=levels) \
                    if {"_la", "_lo"} <= set(src.columns) else nearest_hazard(
                        samples, src.filter("sic is not null").withColumn("_la", F.col("latitude")).withColumn("_lo", F.col("longitude")),
                        ["_la", "_lo"], ["sic"], levels=levels)
                hit = hit.withColumn("severity", risk.alert_severity(kind, "sic", cfg)).withColumn("iceberg_id", F.lit(None).cast("string"))
            else:
                hit = nearest_hazard(samples, src, ["iceberg_id"], levels=levels).withColumn(
                    "severity", risk.alert_severity(kind, "distance_km", cfg)).withColumn("sic", F.lit(None).cast("double"))
            hit = hit.select("route_id", "distance_km", "site_lat", "site_lon", "severity", "iceberg_id", "sic")
            j = routes.select("route_id", "label").join(hit, "route_id", "left")
        else:
            j = routes.select("route_id", "label").select(
                "*", *[F.lit(None).cast("double").alias(c) for c in ("distance_km", "site_lat", "site_lon", "sic")],
                *[F.lit(None).cast("string").alias(c) for c in ("severity", "iceberg_id")])
        none = F.col("severity").isNull()
        crit = F.col("severity") == "critical"
        if kind == "sea-ice":
            msg = F.concat(up, F.lit(": Sea-ice concentration of "), risk.pct("sic"), F.lit(" detected "),
                           F.format_string("%.1f", "distance_km"), F.lit(" km from the "), F.col("label"), F.lit(" route."))
            msg0 = "Sea-ice alert unavailable - data source unavailable."
            act0 = "Retry when the sea-ice data source is available."
            act = F.when(crit, "Route adjustment recommended and monitor ice conditions.").otherwise(
                "Maintain the current route and monitor ice conditions.")
        else:
            msg = F.concat(up, F.lit(": "), F.col("iceberg_id"), F.lit(" detected "), F.format_string("%.1f", "distance_km"),
                           F.lit(" km from the "), F.col("label"), F.lit(" route."))
            msg0 = "No nearby iceberg detected for the selected route."
            act0 = "Continue monitoring the selected route."
            act = F.when(crit, "Immediate clearance review recommended.").otherwise(
                "Monitor iceberg movement and maintain safe clearance.")
        out.append(j.select(
            risk.alert_id(kind, "route_id", "label", "site_lat", "site_lon").alias("alert_id"), "route_id", F.lit(kind).alias("type"),
            F.coalesce("severity", F.lit("info")).alias("severity"), F.when(none, msg0).otherwise(msg).alias("message"),
            F.when(none, act0).otherwise(act).alias("action"), F.col("site_lat").alias("latitude"), F.col("site_lon").alias("longitude"),
            "distance_km", (F.col("distance_km") * KM_TO_NM_ALERT).alias("distance_nm"), "iceberg_id"))
    return out[0].unionByName(out[1])


def position_along(waypoints, at, route="route_id", order="wp_index", chunk=od.AUTO):
    """Position at a fraction (0..1) of each route's length, by great-circle interpolation inside the crossing segment.

    ``at`` is a frame (route, fraction). Adds the remaining distance, progress percent and fuel left (nm / 2000).
    """
    wp = waypoints.select(route, order, *CELL)
    width = od.chunk_width(wp, [route], [order], chunk)
    h = od.with_halo(wp, [route], [order], width, after=1)
    w = od.window([route], [order], width)
    h = h.withColumn("_la", F.lead("latitude").over(w)).withColumn("_lo", F.lead("longitude").over(w))
    h = od.drop_halo(h, keep_chunk=True).withColumn("_seg", F.coalesce(
        geo.haversine("latitude", "longitude", "_la", "_lo", R_NM), F.lit(0.0)))
    h = h.withColumn("_cum", od.running_sum("_seg", [route], [order], width))
    h = od.with_prefix(h, [route], width, sums=["_seg"])
    h = h.withColumn("_end", F.col("_seg_before") + F.col("_cum")).withColumn("_start", F.col("_end") - F.col("_seg"))
    j = h.join(at.select(route, F.least(F.greatest("fraction", F.lit(0.0)), F.lit(1.0)).alias("_f")), route)
    j = j.withColumn("_t", F.col("_seg_total") * F.col("_f"))
    eps = 1e-9
    hit = j.filter(F.col("_la").isNotNull() & (F.col("_end") + eps >= F.col("_t")))
    pick = hit.groupBy(route).agg(F.min_by(F.struct("latitude", "longitude", "_la", "_lo", "_seg", "_start", "_t", "_seg_total"),
                                           F.col(order)).alias("_b")).select(route, "_b.*")
    solo = (j.groupBy(route).agg(F.min_by(F.struct(*CELL), F.col(order)).alias("_s"), F.max("_la").alias("_any"))
            .filter("_any is null").select(route, F.col("_s.latitude").alias("latitude"), F.col("_s.longitude").alias("longitude"),
                                           F.lit(0.0).alias("remaining_nm"), F.lit(100.0).alias("progress_pct")))
    f = F.least(F.coalesce(F.try_divide(F.col("_t") - F.col("_start"), F.nullif("_seg", F.lit(0.0))), F.lit(0.0)), F.lit(1.0))
    p = geo.intermediate("latitude", "longitude", "_la", "_lo", f)
    out = pick.withColumn("_p", p).select(
        route, F.col("_p.lat").alias("latitude"), F.col("_p.lon").alias("longitude"),
        F.greatest(F.col("_seg_total") - F.col("_t"), F.lit(0.0)).alias("remaining_nm"),
        F.when(F.col("_seg_total") > 0, F.col("_t") / F.col("_seg_total") * 100.0).otherwise(100.0).alias("progress_pct"))
    return out.unionByName(solo).withColumn("fuel_left_tons", F.col("remaining_nm") / 2000.0)


def distinct_topk(df, group, signature, order, k=2):
    """At most ``k`` distinct alternatives per group, first by ``order``.

    Distinct signatures are aggregated first; ranking holds one row per distinct signature of a group.
    """
    rest = [c for c in df.columns if c not in (group, signature)]
    d = df.groupBy(group, signature).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")).select(group, signature, "_b.*")
    salt = F.pmod(F.xxhash64(signature), F.lit(16))
    w1 = Window.partitionBy(group, "_salt").orderBy(*order, signature)
    part = d.withColumn("_salt", salt).withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_salt", "_r")
    w = Window.partitionBy(group).orderBy(*order, signature)
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def order_alerts(df):
    return df.orderBy(risk.severity_rank("severity"), F.asc_nulls_last("distance_km"), "alert_id")


def nearest_k(df, lat, lon, k=10, id_col="iceberg_id"):
    """The k entities nearest to a position (a top-k plan, no full sort)."""
    km = geo.haversine("latitude", "longitude", F.lit(float(lat)), F.lit(float(lon)))
    return df.withColumn("distance_km", rnd(km, 6)).orderBy("distance_km", id_col).limit(k)


def largest_k(df, col, k=10, id_col="iceberg_id"):
    return df.filter(F.col(col) > 0).orderBy(F.desc(col), id_col).limit(k)
