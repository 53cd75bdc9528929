"""Joins of tracks, points, grids, places and routes."""
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from floetrack.config import DEPLOYED, ICE_CLASS_LIMITS, NM_TO_KM, R_KM, R_KM_ROUND, RiskConfig
from floetrack.functions import geo
from floetrack.functions.values import rnd
from floetrack.operators import ordered as od
from floetrack.operators.axes import grid_axes
from floetrack.operators.nearest import build_index, nearest_join
from floetrack.operators.stats import attach

AXES = ("obs_time", "latitude", "longitude")


def _index(df, ax, exact):
    for c, name in zip(AXES, ("_t", "_i", "_j")):
        df = ax[c].index_of(df, c, name, exact)
    return df


def env_join(tracks, grid, variables, prefix, tolerance_hours=24.0, axes=None):
    """Values of the grid at the nearest latitude, longitude and time of every fix.

    Adds the variables, ``<prefix>_gap_hours`` and ``<prefix>_stale``. With a tolerance, values farther in time
    are NULL and stale. A missing cell at the snapped position gives NULL, not the next-nearest value.
    The grid's axes are read first (or passed in), so the only shuffle is one equi-join on three integers.
    """
    ax = axes or grid_axes(grid)
    q = _index(tracks, ax, False)
    g = _index(grid, ax, True).select("_t", "_i", "_j", *[F.col(v).alias(f"_v_{v}") for v in variables])
    q = ax["obs_time"].value_at(q, "_t", "_tv")
    gap = F.abs(geo.micros("obs_time") - F.col("_tv")) / 3.6e9
    q = q.withColumn("_gap", gap)
    out = q.join(g, ["_t", "_i", "_j"], "left")
    stale = F.col("_gap") > tolerance_hours if tolerance_hours is not None else F.lit(False)
    for v in variables:
        out = out.withColumn(v, F.when(~stale, F.col(f"_v_{v}")))
    out = out.withColumn(f"{prefix}_gap_hours", rnd("_gap", 2)).withColumn(f"{prefix}_stale", stale.cast("int"))
    return out.drop("_t", "_i", "_j", "_tv", "_gap", *[f"_v_{v}" for v in variables])


def no_env(tracks, variables, prefix):
    """Columns of an absent grid: values and gap NULL, stale 1."""
    out = tracks
    for v in variables:
        out = out.withColumn(v, F.lit(None).cast("double"))
    return out.withColumn(f"{prefix}_gap_hours", F.lit(None).cast("double")).withColumn(f"{prefix}_stale", F.lit(1))


def align_channels(ref, others, axes=None):
    """Reference grid left-joined to other grids by nearest time / latitude / longitude. ``others``: list of (grid, variables)."""
    out = ref
    for k, (grid, variables) in enumerate(others):
        ax = axes[k] if axes else grid_axes(grid)
        out = env_join(out, grid, variables, f"_x{k}", None, ax).drop(f"_x{k}_gap_hours", f"_x{k}_stale")
    return out


def pairwise_within(df, point_id, km, lat="latitude", lon="longitude"):
    """Pairs of points at most ``km`` apart: ``<id>_a`` < ``<id>_b`` and ``distance_km``, each pair once.

    Points fall into cubes on the unit sphere whose edge is the radius' chord; a point meets the points of its own and the 26
    cubes around it in one equi-join. The result holds every pair asked for, so the radius bounds the work.
    """
    edge = max(2 * math.sin(min(math.pi / 2, km / (2 * R_KM))) * (1 + 1e-9), 1e-6)
    la, lo = F.radians(F.col(lat).cast("double")), F.radians(F.col(lon).cast("double"))
    xyz = (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))
    p = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(point_id).alias("_id"), F.col(lat).cast("double").alias("_la"), F.col(lon).cast("double").alias("_lo"),
                                                                       *[F.floor(v / edge).alias(f"_{c}") for v, c in zip(xyz, "xyz")])
    near = p
    for c in "xyz":
        near = near.withColumn(f"_{c}", F.explode(F.array(*[F.col(f"_{c}") + d for d in (-1, 0, 1)])))
    a = near.withColumnsRenamed({"_id": f"{point_id}_a", "_la": "_la0", "_lo": "_lo0"})
    b = p.withColumnsRenamed({"_id": f"{point_id}_b"})
    out = a.join(b, ["_x", "_y", "_z"]).filter(F.col(f"{point_id}_a") < F.col(f"{point_id}_b"))
    out = out.withColumn("distance_km", geo.haversine("_la0", "_lo0", "_la", "_lo"))
    return out.filter(F.col("distance_km") <= km).select(f"{point_id}_a", f"{point_id}_b", "distance_km")


def iceberg_positions(bergs):
    """Position of each iceberg: predicted when both predicted coordinates exist, else current; records without one are left out."""
    has = {"predicted_lat", "predicted_lon"} <= set(bergs.columns)
    pred = F.col("predicted_lat").isNotNull() & F.col("predicted_lon").isNotNull() if has else F.lit(False)
    lat = F.when(pred, F.col("predicted_lat")).otherwise(F.col("latitude")) if has else F.col("latitude")
    lon = F.when(pred, F.col("predicted_lon")).otherwise(F.col("longitude")) if has else F.col("longitude")
    return (bergs.withColumn("_la", lat).withColumn("_lo", lon).drop("latitude", "longitude")
            .withColumnsRenamed({"_la": "latitude", "_lo": "longitude"})
            .filter("latitude is not null and longitude is not null"))


def min_distance(cells, cell_id, bergs, berg_id="iceberg_id", reach_km=None, out="iceberg_distance_km", levels=None):
    """Distance of every cell to the nearest iceberg; with ``reach_km`` farther ones are NULL."""
    hit = nearest_join(cells, cell_id, "latitude", "longitude", iceberg_positions(bergs), "latitude", "longitude",
                       [berg_id], dist=out, levels=levels).drop("site_lat", "site_lon")
    if reach_km is not None:
        hit = hit.filter(F.col(out) < reach_km)
    return cells.join(hit, cell_id, "left")


def annotate_coast(points, point_id, land, cell_km, levels=None):
    """Distance to the nearest land cell (1 decimal) and whether the point sits on land (within one cell height)."""
    cells = land.select(F.col("latitude").alias("_cla"), F.col("longitude").alias("_clo"))
    hit = nearest_join(points, point_id, "latitude", "longitude", cells, "_cla", "_clo", ["_cla", "_clo"],
                       dist="_d", radius=R_KM_ROUND, levels=levels).select(point_id, "_d")
    return (points.join(hit, point_id, "left").withColumn("on_land", F.coalesce(F.col("_d") <= cell_km, F.lit(False)))
            .withColumn("distance_to_coast_km", rnd("_d", 1)).drop("_d"))


def pair_distance(pairs, points, key, a="id_a", b="id_b"):
    """Distance in km and nm of listed id pairs; ids that do not exist give status ``not_found``."""
    p = points.select(key, "latitude", "longitude")
    out = pairs
    for side in (a, b):
        out = out.join(p.select(F.col(key).alias(side), F.col("latitude").alias(f"_la_{side}"),
                                F.col("longitude").alias(f"_lo_{side}")), side, "left")
    km = geo.haversine(f"_la_{a}", f"_lo_{a}", f"_la_{b}", f"_lo_{b}")
    return (out.withColumn("distance_km", km).withColumn("distance_nm", km / NM_TO_KM)
            .withColumn("status", F.when(km.isNull(), "not_found").otherwise("ok"))
            .drop(*[f"_{c}_{s}" for c in ("la", "lo") for s in (a, b)]))


def sample_segments(waypoints, route="route_id", order="wp_index", extra=(), chunk=od.AUTO):
    """Waypoints with the position of the next one, ``_la`` and ``_lo`` (NULL at the last waypoint)."""
    wp = waypoints.select(route, order, "latitude", "longitude", *extra)
    width = od.chunk_width(wp, [route], [order], chunk)
    h = od.with_halo(wp, [route], [order], width, after=1)
    w = od.window([route], [order], width)
    h = h.withColumn("_la", F.lead("latitude").over(w)).withColumn("_lo", F.lead("longitude").over(w))
    return od.drop_halo(h)


def segment_points(segments, samples, *keep):
    """Sample points of ``sample_segments`` rows: ``samples`` linear steps (end excluded), of the last waypoint itself only."""
    steps = F.when(F.col("_la").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(samples - 1)))
    f = F.col("_s") / F.lit(float(samples))
    pt = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * f)
    return (segments.withColumn("_s", F.explode(steps)).select(
        *keep, pt("latitude", "_la").alias("latitude"), pt("longitude", "_lo").alias("longitude")))


def route_samples(waypoints, samples=50, route="route_id", order="wp_index", extra=(), chunk=od.AUTO):
    """Points along every route: ``samples`` linear steps per segment (end excluded) plus the last waypoint."""
    return segment_points(sample_segments(waypoints, route, order, extra, chunk), samples, route, *extra)


def route_distance(waypoints, points, point_id, samples=50, pairs=None, route="route_id", order="wp_index", levels=None):
    """Minimum distance of sampled routes to points.

    With ``pairs`` (``route``, ``point_id``) every listed pair is measured; otherwise the nearest point of each route is found.
    Routes with fewer than two waypoints (or none) get status ``invalid``, pairs naming a point that is not listed
    ``not_found``; neither has a distance.
    """
    n = waypoints.groupBy(route).agg(F.count(F.lit(1)).alias("_n"))
    if pairs is not None:
        p = points.select(point_id, F.col("latitude").alias("_pla"), F.col("longitude").alias("_plo"))
        # pairs meet segments; sample points come after the join, so that they are neither shuffled nor sorted
        s = sample_segments(waypoints, route, order)
        d = (segment_points(pairs.select(route, point_id).join(p, point_id).join(s, route), samples, route, point_id, "_pla", "_plo")
             .groupBy(route, point_id).agg(F.min(geo.haversine("latitude", "longitude", "_pla", "_plo")).alias("distance_km")))
        out = pairs.join(n, route, "left").join(d, [route, point_id], "left")
    else:
        s = route_samples(waypoints, samples, route=route, order=order)
        out = n.join(nearest_hazard(s, points, [point_id], route=route, levels=levels), route, "left")
    bad = F.coalesce(F.col("_n") < 2, F.lit(True))
    return (out.withColumn("status", F.when(bad, "invalid").when(F.col("distance_km").isNull(), "not_found").otherwise("ok"))
            .withColumn("distance_km", F.when(~bad, F.col("distance_km")))
            .withColumn("distance_nm", F.col("distance_km") / NM_TO_KM).drop("_n"))


def nearest_hazard(samples, hazards, ties, payload=(), route="route_id", levels=None):
    """Nearest hazard of each route given the route's sample points: position, ids, ``distance_km``."""
    return nearest_join(samples, route, "latitude", "longitude", hazards, "latitude", "longitude", ties, payload,
                        dist="distance_km", levels=levels, many=True)


def match_place(points, point_id, places, km=5.0, levels=None):
    """Configured place within ``km`` of each point, nearest first, ports before others on a tie."""
    p = places.withColumn("_rank", F.when(F.col("kind") == "port", 0).otherwise(1))
    hit = nearest_join(points, point_id, "latitude", "longitude", p, "latitude", "longitude", ["_rank", "place_id"],
                       ["name", "kind"], dist="place_km", levels=levels)
    return hit.filter(F.col("place_km") <= km).drop("site_lat", "site_lon", "_rank")


def sea_index(grid, levels=None, folder=None):
    """Site index of the grid's sea cells, for ``nearest_navigable`` and ``resolve_endpoints``."""
    sea = grid.filter(~F.col("is_land")).select(F.col("latitude").alias("_cla"), F.col("longitude").alias("_clo"))
    return build_index(sea, "_cla", "_clo", ["_cla", "_clo"], levels=levels, folder=folder)


def nearest_navigable(points, point_id, grid, axes=None, window=30.0, max_km=None, levels=None, index=None):
    """Nearest non-land grid cell of each point: the point's own cell (0 km), else within a linear longitude
    window, else within the wrapped window. Points without one get NULLs. ``index``: stored index of the sea cells
    (``sea_index``), else one is built."""
    ax = axes or grid_axes(grid, ("latitude", "longitude"))
    la, lo = ax["latitude"], ax["longitude"]
    p = points.select(point_id, geo.clamp("latitude", la.values[0], la.values[-1]).alias("latitude"),
                      geo.clamp("longitude", lo.values[0], lo.values[-1]).alias("longitude"))
    p = lo.index_of(la.index_of(p, "latitude", "_i"), "longitude", "_j")
    g = lo.index_of(la.index_of(grid, "latitude", "_i", True), "longitude", "_j", True)
    own = p.join(g.select("_i", "_j", F.col("latitude").alias("_gla"), F.col("longitude").alias("_glo"), "is_land"),
                 ["_i", "_j"], "left")
    here = own.filter(~F.coalesce("is_land", F.lit(True))).select(      # a cell the grid lacks is not known to be sea
        point_id, F.col("_gla").alias("nav_lat"), F.col("_glo").alias("nav_lon"), F.lit(0.0).alias("nav_km"))
    rest = own.filter(F.coalesce("is_land", F.lit(True))).withColumn("_glo", F.coalesce("_glo", "longitude"))
    index = index or sea_index(grid, levels)
    span = max(1, int(round(window / lo.step))) * lo.step
    # the linear window and the three pieces of the wrapped one in one walk; a hit in the first settles a point
    lon, own = F.col("longitude"), F.col("_glo")
    looks = [(own - (span + 1e-9), own + (span + 1e-9)), (lon - window, lon + window), (lon - window + 360.0, F.lit(400.0)),
             (F.lit(-400.0), lon + window - 360.0)]
    q = rest.select(point_id, "latitude", "longitude", F.posexplode(F.array(
        *[F.struct(a.alias("lo"), z.alias("hi")) for a, z in looks])).alias("_k", "_w"))
    q = q.select(F.struct(point_id, "_k").alias("_q"), "_k", "latitude", "longitude", F.col("_w.lo").alias("_wlo"), F.col("_w.hi").alias("_whi"))
    hit = index.nearest(q, "_q", "latitude", "longitude", window=("_wlo", "_whi"), dist="nav_km", group="_k")
    if max_km is not None:
        hit = hit.filter(F.col("nav_km") <= max_km)
    best = F.min_by(F.struct("_cla", "_clo", "nav_km"), F.struct(F.col("_q._k") > 0, F.round("nav_km", 6), "_cla", "_clo"))
    near = (hit.groupBy(F.col(f"_q.{point_id}").alias(point_id)).agg(best.alias("_m"))
            .select(point_id, F.col("_m._cla").alias("nav_lat"), F.col("_m._clo").alias("nav_lon"), F.col("_m.nav_km").alias("nav_km")))
    found = here.unionByName(near)
    return points.join(found, point_id, "left")


def resolve_endpoints(points, point_id, grid, places, max_km=100.0, axes=None, levels=None, index=None):
    """Routing endpoint of each point: its cell when navigable, a matched place's approach cell when on land, else rejected."""
    ax = axes or grid_axes(grid, ("latitude", "longitude"))
    nav = nearest_navigable(points, point_id, grid, ax, levels=levels, index=index)
    place = match_place(points, point_id, places, levels=levels)
    out = nav.join(place, point_id, "left")
    sea = F.coalesce(F.col("nav_km") == 0.0, F.lit(False))
    known = F.col("place_id").isNotNull() & F.col("nav_km").isNotNull()
    head = F.concat(F.col("name"), F.lit(" ("), F.col("place_id").cast("string"), F.lit(") lies on land"))
    near = F.concat(head, F.format_string("; routing to the nearest valid ocean approach point (%.2f, %.2f, %.1f km offshore).",
                                          "nav_lat", "nav_lon", "nav_km"))
    far = F.concat(head, F.format_string(
        ". The nearest valid ocean approach point in the configured land mask is %.1f km away at (%.2f, %.2f), ",
        "nav_km", "nav_lat", "nav_lon"), F.lit(
        f"which exceeds the configured approach distance ({max_km:g} km). Decision support routes to that cell; "
        "it is not station-side anchorage."))
    status = F.when(sea, "navigable").when(known, "approach").otherwise("rejected")
    ok = status != "rejected"
    keep = F.when(status == "approach", F.lit(True))
    return out.select(
        point_id, status.alias("status"), F.when(ok, F.col("nav_lat")).alias("lat"), F.when(ok, F.col("nav_lon")).alias("lon"),
        F.when(keep, F.col("name")).alias("place_name"), F.when(keep, F.col("kind")).alias("place_kind"),
        F.when(ok, F.col("nav_km")).alias("approach_km"),
        F.when(status == "approach", F.when(F.col("nav_km") <= max_km, near).otherwise(far)).alias("note"))


def sample_grid(points, grid, columns, axes=None, lat="latitude", lon="longitude"):
    """Values of the nearest cell (clamped) of a regular grid at every point."""
    ax = axes or grid_axes(grid, ("latitude", "longitude"))
    la, lo = ax["latitude"], ax["longitude"]
    p = lo.index_of(la.index_of(points, lat, "_i"), lon, "_j")
    g = lo.index_of(la.index_of(grid, "latitude", "_i", True), "longitude", "_j", True).select("_i", "_j", *columns)
    return p.join(g, ["_i", "_j"], "left").drop("_i", "_j")


def vessel_limits(vessels, cfg=RiskConfig()):
    """Concentration limit by ice class (default for unknown classes) and clearance in km."""
    limits = F.create_map(*[F.lit(x) for kv in cfg.class_limits.items() for x in kv])
    found = F.try_element_at(limits, F.col("ice_class"))
    return (vessels.withColumn("max_concentration", F.coalesce(found, F.lit(cfg.max_safe_concentration)))
            .withColumn("class_known", found.isNotNull())
            .withColumn("clearance_km", F.greatest(F.lit(cfg.min_clearance_km),
                                                   F.coalesce("safety_distance_nm", F.lit(0.0)) * NM_TO_KM)))


def is_ocean(points, mask, lon_min=20.0, lon_max=120.0, axes=None):
    """Add ``is_ocean``: NULL outside the mask's longitude coverage, else by the nearest mask cell."""
    out = sample_grid(points, mask.withColumnRenamed("is_land", "_land"), ["_land"], axes)
    cover = F.col("longitude").between(lon_min, lon_max)
    return out.withColumn("is_ocean", F.when(cover, ~F.col("_land"))).drop("_land")


def drop_known_land(points):
    return points.filter(~F.col("is_ocean").eqNullSafe(F.lit(False)))


def score_land_mask(preds, pred_id, grid, tol_km=5.0, axes=None, levels=None):
    """(classified points, one-row summary): predicted points against the land mask with a coast tolerance."""
    ax = axes or grid_axes(grid, ("latitude", "longitude"))
    la, lo = ax["latitude"].values, ax["longitude"].values
    inside = F.col("latitude").between(la[0], la[-1]) & F.col("longitude").between(lo[0], lo[-1])
    p = preds.withColumn("_ok", F.coalesce(inside, F.lit(False)))
    s = sample_grid(p.filter("_ok"), grid.withColumnRenamed("is_land", "_land"), ["_land"], ax)
    land = grid.filter("is_land").select(F.col("latitude").alias("_cla"), F.col("longitude").alias("_clo"))
    near = nearest_join(s.filter(~F.coalesce("_land", F.lit(False))), pred_id, "latitude", "longitude", land, "_cla", "_clo",
                        ["_cla", "_clo"], dist="_km", levels=levels).select(pred_id, "_km")
    s = s.join(near, pred_id, "left").withColumn(
        "on_land", F.coalesce("_land", F.lit(False)) | F.coalesce(F.col("_km") <= tol_km, F.lit(False)))
    out = p.join(s.select(pred_id, "on_land"), pred_id, "left").withColumn(
        "result", F.when(~F.col("_ok"), "invalid").when(F.col("on_land"), "land").otherwise("ocean")).drop("_ok")
    n = F.count(F.lit(1))
    total = out.agg(n.alias("total_points"), F.count_if(F.col("result") == "ocean").alias("ocean_points"),
                    F.count_if(F.col("result") == "land").alias("land_points"),
                    F.count_if(F.col("result") == "invalid").alias("invalid_points"),
                    rnd(F.try_divide(F.count_if(F.col("result") == "ocean") * 100.0, n), 4).alias("accuracy_percent"),
                    F.when(n > 0, "VERIFIED").otherwise("UNAVAILABLE").alias("status"))
    return out, total


def with_fallback(primary, fallback, key):
    """Primary rows plus fallback rows of keys the primary lacks."""
    return (primary.withColumn("from_fallback", F.lit(False)).unionByName(
        fallback.join(primary.select(key).distinct(), key, "left_anti").withColumn("from_fallback", F.lit(True)),
        allowMissingColumns=True))


def closest(df, lat, lon, id_col):
    """One row: the entity closest to a reference position."""
    km = geo.haversine("latitude", "longitude", F.lit(float(lat)), F.lit(float(lon)))
    best = F.min_by(F.struct(F.col(id_col), km.alias("distance_km")), F.struct(F.round(km, 6), F.col(id_col)))
    return df.agg(best.alias("_b")).select("_b.*")


def grid_edges(grid, w_s=0.6, w_d=0.4, diagonal=True, max_risk=0.95, axes=None):
    """Traversable edges between neighbouring cells ``(i, j) -> (ni, nj)`` with length and weighted cost.

    Cells with ``total_risk >= max_risk`` are obstacles; a diagonal past a blocked corner is excluded.
    """
    if not {"i", "j"} <= set(grid.columns):
        ax = axes or grid_axes(grid, ("latitude", "longitude"))
        grid = ax["longitude"].index_of(ax["latitude"].index_of(grid, "latitude", "i", True), "longitude", "j", True)
    g = grid.select("i", "j", "latitude", "longitude", "total_risk").filter(F.col("total_risk") < max_risk)
    offs = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    moves = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in offs])
    e = g.select("*", F.explode(moves).alias("m")).withColumn("ni", F.col("i") + F.col("m.di")).withColumn("nj", F.col("j") + F.col("m.dj"))
    to = g.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("latitude").alias("nlat"), F.col("longitude").alias("nlon"),
                  F.col("total_risk").alias("nrisk"))
    e = e.join(to, ["ni", "nj"])
    free = grid.filter(F.col("total_risk") >= max_risk).select("i", "j")
    if diagonal:
        # a blocked cell beside a diagonal step removes the step (cells outside the grid do not block)
        diag = (F.col("m.di") != 0) & (F.col("m.dj") != 0)
        e = e.withColumn("_di", F.when(diag, F.col("ni"))).withColumn("_dj", F.when(diag, F.col("j")))
        e = e.withColumn("_ei", F.when(diag, F.col("i"))).withColumn("_ej", F.when(diag, F.col("nj")))
        e = e.join(free.select(F.col("i").alias("_di"), F.col("j").alias("_dj")), ["_di", "_dj"], "left_anti")
        e = e.join(free.select(F.col("i").alias("_ei"), F.col("j").alias("_ej")), ["_ei", "_ej"], "left_anti")
    km = geo.haversine("latitude", "longitude", "nlat", "nlon", R_KM)
    mean = 0.5 * (F.col("total_risk") + F.col("nrisk"))
    return e.select("i", "j", "ni", "nj", km.alias("distance_km"), (km * (w_d + w_s * mean)).alias("step_cost"))
