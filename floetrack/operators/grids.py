"""Long-form grid operators: generation, masks, thinning, gap filling, regridding, lagged stacks, field lookups."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from floetrack.functions import geo
from floetrack.functions.values import rnd, to_number
from floetrack.operators import ordered as od
from floetrack.operators.axes import grid_axes
from floetrack.operators.nearest import nearest_join
from floetrack.operators.stats import attach

CELL = ["latitude", "longitude"]


def make_grid(spark, lat_min, lat_max, lon_min, lon_max, res, wrap_end=True):
    """Regular nodes ``(i, j, latitude, longitude)``; ``wrap_end=False`` leaves the last longitude out."""
    if lat_min >= lat_max or lon_min >= lon_max:
        raise ValueError(f"invalid bounds: lat [{lat_min}, {lat_max}], lon [{lon_min}, {lon_max}]")
    if res <= 0:
        raise ValueError(f"resolution must be positive, got {res}")
    nlat = int((lat_max - lat_min) / res + 0.5 + 1e-9) + 1
    nlon = int((lon_max - lon_min) / res + 0.5 + 1e-9) + (1 if wrap_end else 0)
    ids = spark.range(nlat * nlon)
    i, j = F.floor(F.col("id") / nlon).cast("int"), (F.col("id") % nlon).cast("int")
    return ids.select(i.alias("i"), j.alias("j"), (F.lit(float(lat_min)) + i * F.lit(float(res))).alias("latitude"),
                      (F.lit(float(lon_min)) + j * F.lit(float(res))).alias("longitude"))


def mark_land(grid, points=None, box=None, mask=None, axes=None):
    """Add / extend ``is_land`` by the nearest cells of points, by a bounding box, or by a mask ``(latitude, longitude, is_land)``."""
    out = grid if "is_land" in grid.columns else grid.withColumn("is_land", F.lit(False))
    if mask is not None:
        m = mask.select(*CELL, F.col("is_land").alias("_m"))
        out = out.join(m, CELL, "left").withColumn("is_land", F.coalesce("_m", F.lit(False))).drop("_m")
    if box is not None:
        la0, la1, lo0, lo1 = box
        out = out.withColumn("is_land", F.col("is_land") | (F.col("latitude").between(la0, la1) & F.col("longitude").between(lo0, lo1)))
    if points is not None:
        axes = axes or grid_axes(grid, CELL)
        p = axes["longitude"].index_of(axes["latitude"].index_of(points, "latitude", "_i"), "longitude", "_j")
        hit = p.select("_i", "_j").distinct().withColumn("_hit", F.lit(True))
        g = axes["longitude"].index_of(axes["latitude"].index_of(out, "latitude", "_i", True), "longitude", "_j", True)
        out = g.join(hit, ["_i", "_j"], "left").withColumn(
            "is_land", F.col("is_land") | F.coalesce("_hit", F.lit(False))).drop("_i", "_j", "_hit")
    return out


def autoscale_fraction(df, value, by):
    """Snapshots whose maximum exceeds 1 hold percents: divide them by 100."""
    peak = df.groupBy(by).agg(F.max(value).alias("_max"))
    return (od.null_join(df, peak, [by]).withColumn(value, F.when(F.col("_max") > 1, F.col(value) / 100.0).otherwise(F.col(value)))
            .drop("_max"))


def clip_range(df, value, lo=0.0, hi=1.0):
    """Clip a column; ``<value>_clipped`` says which rows were outside (sum it for the count)."""
    v = F.col(value)
    out = F.coalesce((v < lo) | (v > hi), F.lit(False))
    return df.withColumn(f"{value}_clipped", out).withColumn(value, F.when(v.isNotNull(), geo.clamp(v, lo, hi)))


def flag_nodata(df, value):
    v = to_number(value)
    return (df.withColumn(value, v).withColumn("quality_flag", F.when(v.isNull(), "nodata").otherwise("good"))
            .withColumn("nodata_flag", v.isNull().cast("int")))


def depth_from_elevation(z):
    z = F.col(z) if isinstance(z, str) else z
    return F.when(z < 0, -z)


def bathymetry_table(df, z="z", lat_min=-90.0, lat_max=-50.0):
    """Elevation and depth per point in the latitude band; non-finite or very low values are nodata."""
    v = to_number(z)
    v = F.when(v > -99999, v)
    return (df.filter(F.col("latitude").between(lat_min, lat_max))
            .select(*CELL, rnd(v, 2).alias("elevation_meters"), rnd(depth_from_elevation(v), 2).alias("depth_meters"),
                    v.isNull().cast("int").alias("nodata_flag")))


def thin_grid(df, step, axes=None):
    """Every ``step``-th distinct latitude and longitude (arithmetic on a regular axis, no shuffle)."""
    axes = axes or grid_axes(df, CELL)
    out = axes["longitude"].index_of(axes["latitude"].index_of(df, "latitude", "_i", True), "longitude", "_j", True)
    return out.filter((F.col("_i") % step == 0) & (F.col("_j") % step == 0)).drop("_i", "_j")


def thin_to(df, value, max_points, land=None, axes=None):
    """Adaptive thinning of one field: stride ``ceil(sqrt(n / max_points))`` over visible, non-land cells."""
    axes = axes or grid_axes(df, CELL)
    out = axes["longitude"].index_of(axes["latitude"].index_of(df, "latitude", "_i", True), "longitude", "_j", True)
    if land is not None:
        out = out.join(land.filter("is_land").select(*CELL), CELL, "left_anti")
    out = out.filter(F.col(value) > 0)
    n = F.count(F.lit(1))
    stride = out.agg(F.when(n <= max_points, F.lit(1)).otherwise(F.ceil(F.sqrt(n / F.lit(float(max_points))))).cast("int").alias("_s"))
    return (attach(out, stride).filter((F.col("_i") % F.col("_s") == 0) & (F.col("_j") % F.col("_s") == 0))
            .drop("_i", "_j", "_s"))


def select_depth(df, level=0, depth="depth"):
    """Rows of the ``min(level, n-1)``-th depth value."""
    d = df.select(depth).distinct()                       # a grid's depth levels
    ranked = d.withColumn("_r", F.row_number().over(Window.orderBy(depth)) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy()))
    pick = ranked.filter(F.col("_r") == F.least(F.lit(level), F.col("_n") - 1)).select(depth)
    return df.join(F.broadcast(pick), depth, "left_semi")      # one row


def regrid_nearest(src, target, value_cols, src_axes=None):
    """Nearest-axis value of ``src`` at every target cell; a missing source cell gives NULL."""
    ax = src_axes or grid_axes(src, CELL)
    t = ax["longitude"].index_of(ax["latitude"].index_of(target, "latitude", "_i"), "longitude", "_j")
    s = ax["longitude"].index_of(ax["latitude"].index_of(src, "latitude", "_i", True), "longitude", "_j", True)
    return t.join(s.select("_i", "_j", *value_cols), ["_i", "_j"], "left").drop("_i", "_j")


def nearest_point(left, right, right_id, payload, left_id="cell_id", metric="plane"):
    """Nearest scattered point (degree space) for every left row; equal positions keep the smallest id."""
    hit = nearest_join(left, left_id, "latitude", "longitude", right, "latitude", "longitude", [right_id], payload,
                       metric=metric, dist="dist_deg" if metric == "plane" else "dist_km")
    return left.join(hit, left_id, "left")


def polar_regrid(targets, src, grid_def, value="value"):
    """Value of a polar-stereographic raster ``(iy, ix, value)`` at target points; NULL outside the raster."""
    g = grid_def
    xy = geo.polar_xy("latitude", "longitude", g["a"], g["b"], g["lat_ts"])
    t = targets.withColumn("_xy", xy)
    # bankers' rounding, as the source index convention uses; far from the pole a position may pass every integer
    t = (t.withColumn("ix", F.bround((F.col("_xy.x") - g["x0"]) / g["dx"]))
         .withColumn("iy", F.bround((F.col("_xy.y") - g["y0"]) / g["dy"])))
    ok = F.col("ix").between(0, g["nx"] - 1) & F.col("iy").between(0, g["ny"] - 1)
    t = t.withColumns({c: F.when(ok, F.col(c)).cast("long") for c in ("ix", "iy")}).drop("_xy")
    return t.join(src.select("iy", "ix", value), ["iy", "ix"], "left")


def cell_diff(df, value, out="sic_change", time_col="obs_time", axes=None, chunk=od.AUTO):
    """Difference to the previous time step of the grid's axis; NULL when the cell is absent at that step."""
    ax = (axes or grid_axes(df, [time_col]))[time_col]
    d = ax.index_of(df, time_col, "_t", True)
    width = od.chunk_width(df, CELL, [time_col], chunk)
    h = od.with_halo(d, CELL, [time_col], width, before=1)
    w = od.window(CELL, [time_col], width)
    h = h.withColumn("_pt", F.lag("_t").over(w)).withColumn("_pv", F.lag(value).over(w))
    return (od.drop_halo(h).withColumn(out, F.when(F.col("_pt") == F.col("_t") - 1, F.col(value) - F.col("_pv")))
            .drop("_t", "_pt", "_pv"))


def fill_gaps(df, value, max_gap=1, time_col="obs_time", axes=None, out=None, chunk=od.AUTO):
    """Linear fill in time of runs of at most ``max_gap`` missing steps between two observed ones, per cell.

    A step counts as missing when the row is absent or its value is NULL; only existing rows are filled.
    ``<value>_filled`` marks filled rows.
    """
    ax = (axes or grid_axes(df, [time_col]))[time_col]
    out = out or value
    d = ax.index_of(df, time_col, "_t", True)
    # A run of up to max_gap steps lies within max_gap + 1 neighbouring rows.
    width = od.chunk_width(df, CELL, [time_col], chunk)
    h = od.with_halo(d, CELL, [time_col], width, max_gap + 1, max_gap + 1)
    w = od.window(CELL, [time_col], width)
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col("_t").alias("t"), F.col(value).alias("v")))
    h = (h.withColumn("_a", F.last(seen, ignorenulls=True).over(w.rowsBetween(-(max_gap + 1), -1)))
         .withColumn("_b", F.first(seen, ignorenulls=True).over(w.rowsBetween(1, max_gap + 1))))
    a, b = F.col("_a"), F.col("_b")
    can = F.col(value).isNull() & (b["t"] - a["t"] - 1 <= max_gap)
    lin = a["v"] + (b["v"] - a["v"]) * (F.col("_t") - a["t"]) / (b["t"] - a["t"])
    can = F.coalesce(can, F.lit(False))
    return (od.drop_halo(h).withColumn(f"{value}_filled", can)
            .withColumn(out, F.when(can, lin).otherwise(F.col(value))).drop("_a", "_b", "_t"))


def fill_gaps_multi(df, values, max_gap=1, time_col="obs_time", axes=None, chunk=od.AUTO):
    """``fill_gaps`` for several variables in one pass: one shuffle by cell, ``<value>_filled`` for each."""
    ax = (axes or grid_axes(df, [time_col]))[time_col]
    d = ax.index_of(df, time_col, "_t", True)
    width = od.chunk_width(df, CELL, [time_col], chunk)
    h = od.with_halo(d, CELL, [time_col], width, max_gap + 1, max_gap + 1)
    w = od.window(CELL, [time_col], width)
    seen = {v: F.when(F.col(v).isNotNull(), F.struct(F.col("_t").alias("t"), F.col(v).alias("v"))) for v in values}
    h = h.withColumns({f"_a_{v}": F.last(seen[v], ignorenulls=True).over(w.rowsBetween(-(max_gap + 1), -1)) for v in values}
                      | {f"_b_{v}": F.first(seen[v], ignorenulls=True).over(w.rowsBetween(1, max_gap + 1)) for v in values})
    out = od.drop_halo(h)
    a, b = (lambda v, p=p: F.col(f"_{p}_{v}") for p in "ab")
    can = {v: F.coalesce(F.col(v).isNull() & (b(v)["t"] - a(v)["t"] - 1 <= max_gap), F.lit(False)) for v in values}
    lin = {v: a(v)["v"] + (b(v)["v"] - a(v)["v"]) * (F.col("_t") - a(v)["t"]) / (b(v)["t"] - a(v)["t"]) for v in values}
    out = out.withColumns({f"{v}_filled": can[v] for v in values})
    return out.withColumns({v: F.when(F.col(f"{v}_filled"), lin[v]).otherwise(F.col(v)) for v in values}).drop("_t", *[f"_{p}_{v}" for p in "ab" for v in values])


def field_at(df, value, at, method="nearest", time_col="obs_time"):
    """Field of ``value`` per cell at time ``at`` with provenance columns (method, bracket, weight).

    ``nearest`` takes the closest recorded time (the earlier on a tie); ``linear`` interpolates between the
    bracketing times and falls back to the nearest at the edge of the domain. An exact hit is never interpolated.
    """
    t = F.lit(at).cast("timestamp_ntz")
    us, q = geo.micros(time_col), geo.micros(t)
    b = df.agg(F.max(F.when(us <= q, us)).alias("_t0"), F.min(F.when(us >= q, us)).alias("_t1"))
    t0, t1 = F.col("_t0"), F.col("_t1")
    near = F.when(t0.isNull(), t1).when(t1.isNull(), t0).when(q - t0 <= t1 - q, t0).otherwise(t1)
    exact = t0 == t1
    edge = t0.isNull() | t1.isNull()
    linear = F.lit(method == "linear") & ~edge & ~F.coalesce(exact, F.lit(False))
    b = b.select("_t0", "_t1", near.alias("_near"),
                 F.when(F.coalesce(exact, F.lit(False)), "exact_match").when(linear, "linear_in_time")
                 .when(F.lit(method == "linear"), "nearest_in_time (edge-of-domain)").otherwise("nearest_in_time").alias("method"),
                 F.when(linear, (q - t0) / (t1 - t0)).alias("_w"))
    d = attach(df.withColumn("_us", us), b)
    d = d.filter(F.when(F.col("method") == "linear_in_time", (F.col("_us") == t0) | (F.col("_us") == t1))
                 .otherwise(F.col("_us") == F.col("_near")))
    at0 = F.max(F.when(F.col("_us") == t0, F.col(value)))
    at1 = F.max(F.when(F.col("_us") == t1, F.col(value)))
    g = d.groupBy(*CELL).agg(F.first("method").alias("method"), F.first("_w").alias("_w"), F.first("_t0").alias("_t0"),
                             F.first("_t1").alias("_t1"), F.first("_near").alias("_near"), at0.alias("_v0"), at1.alias("_v1"),
                             F.max(F.when(F.col("_us") == F.col("_near"), F.col(value))).alias("_vn"))
    w = F.col("_w")
    ts = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return g.select(*CELL, F.when(F.col("method") == "linear_in_time", F.col("_v0") * (1 - w) + F.col("_v1") * w)
                    .otherwise(F.col("_vn")).alias(value), "method", rnd("_w", 4).alias("interpolation_weight"),
                    ts(F.when(F.col("method") == "exact_match", F.col("_near")).otherwise(t0)).alias("bracket_start"),
                    ts(F.when(F.col("method") == "exact_match", F.col("_near")).otherwise(t1)).alias("bracket_end"))


def date_split(df, time_col="obs_time", fracs=(0.70, 0.10)):
    """Train / val / test by distinct dates (max(2, int(.7 n)) and max(1, int(.1 n)) dates)."""
    d = F.to_date(time_col)
    dates = df.select(d.alias("_d")).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    r = dates.withColumn("_i", F.row_number().over(Window.orderBy("_d")) - 1).withColumn("_n", n)   # calendar days only
    tr = F.greatest(F.lit(2), F.floor(F.col("_n") * F.lit(fracs[0])))
    va = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(fracs[1])))
    fits = tr + va < F.col("_n")
    split = (F.when(F.col("_i") < tr, "train").when(fits & (F.col("_i") < tr + va), "val").otherwise("test"))
    return od.null_join(df.withColumn("_d", d), r.select("_d", split.alias("split"), F.col("_i").alias("date_index")), ["_d"]).drop("_d")


def consecutive_pairs(df, value, keys=("latitude", "longitude"), time_col="obs_time", axes=None):
    """Value at one grid time as the prediction for the next grid time, per cell present at both."""
    ax = (axes or grid_axes(df, [time_col]))[time_col]
    d = ax.index_of(df.filter(F.col(value).isNotNull()), time_col, "_t", True)
    a = d.select(*keys, (F.col("_t") + 1).alias("_t"), F.col(value).alias("pred"), F.col(time_col).alias("pred_time"))
    return d.withColumnRenamed(value, "actual").join(a, [*keys, "_t"]).drop("_t")


def cell_windows(df, channels, steps=7, horizon=1, target="sic", time_col="obs_time", axes=None, chunk=od.AUTO):
    """Per cell: the last ``steps`` steps of every channel (flattened) and the target ``horizon`` steps later.

    A row is made for every cell and window end that exists; ``valid`` is false when a step, channel or the target is missing.
    """
    ax = (axes or grid_axes(df, [time_col]))[time_col]
    d = ax.index_of(df, time_col, "_t", True)
    width = od.chunk_width(df, CELL, [time_col], chunk)
    h = od.with_halo(d, CELL, [time_col], width, steps - 1, horizon)
    w = od.window(CELL, [time_col], width)
    frame = w.rowsBetween(-(steps - 1), 0)
    item = F.struct(F.col("_t").alias("t"), F.array(*[F.col(c).cast("double") for c in channels]).alias("v"))
    h = h.withColumn("_w", F.collect_list(item).over(frame))
    fut = F.collect_list(F.struct(F.col("_t").alias("t"), F.col(target).alias("y"),
                                  F.col(time_col).alias("at"))).over(w.rowsBetween(1, horizon))
    h = h.withColumn("_f", fut)
    goal = F.filter("_f", lambda x: x["t"] == F.col("_t") + horizon)
    h = od.drop_halo(h).withColumn("_g", F.try_element_at(goal, F.lit(1)))
    recent = F.filter("_w", lambda x: x["t"] > F.col("_t") - steps)
    flat = F.flatten(F.transform(recent, lambda x: x["v"]))
    return (h.withColumn("features", flat).withColumn("target", F.col("_g.y")).withColumn("target_time", F.col("_g.at"))
            .withColumn("valid", (F.size("features") == steps * len(channels)) & F.forall("features", lambda x: x.isNotNull())
                        & F.col("target").isNotNull())
            .select(*CELL, time_col, "target_time", "features", "target", "valid"))


def latest_snapshot(df, time_col="obs_time", value=None):
    """Rows of the newest time, nodata dropped when ``value`` is given."""
    out = df.filter(F.col(time_col) == df.agg(F.max(time_col)).scalar())     # a plain value, so the scan is pruned by it
    return out.filter(F.col(value).isNotNull()) if value else out


def land_from_history(df, value):
    """Cells never observed in any snapshot are land."""
    return df.groupBy(*CELL).agg((~F.bool_or(F.col(value).isNotNull())).alias("is_land"))


def land_mask(df, elevation=None, depth=None):
    """Ocean where depth > 0 (else land), or land where elevation >= 0; one row per position."""
    if depth:
        land = ~F.coalesce(F.col(depth) > 0, F.lit(False))
    else:
        land = F.coalesce(F.col(elevation) >= 0, F.lit(False))
    return df.groupBy(*CELL).agg(F.bool_and(land).alias("is_land"))


def raster_mask(df, step=0.1, lat_max=-50.0, lon_min=20.0):
    """Coarse cells ``(row, col)``: land unless any ocean position rounds into the cell."""
    r = F.round((F.lit(lat_max) - F.col("latitude")) / step).cast("int")
    c = F.round((F.col("longitude") - F.lit(lon_min)) / step).cast("int")
    return df.groupBy(r.alias("row"), c.alias("col")).agg((~F.bool_or(~F.col("is_land"))).alias("is_land"))


def mask_counts(mask):
    return mask.agg(F.count_if(~F.col("is_land")).alias("ocean_cells"), F.count_if("is_land").alias("land_cells"),
                    F.count(F.lit(1)).alias("total_cells"))


def field_summary(df, value, by=()):
    """Mean, max and coverage percent of a field; zeros when nothing is observed."""
    v = to_number(value)
    z = F.lit(0.0)
    return df.groupBy(*by).agg(
        F.coalesce(rnd(F.avg(v), 6), z).alias("mean"), F.coalesce(rnd(F.max(v), 6), z).alias("max"),
        rnd(F.try_divide(F.count(v) * 100.0, F.count(F.lit(1))), 2).alias("coverage_pct")).withColumn(
            "coverage_pct", F.coalesce("coverage_pct", z))


def daily_mean(df, variables, time_col="obs_time"):
    """Daily means per cell, applied only when that lowers the number of time steps."""
    day = F.date_trunc("day", F.col(time_col)).cast("timestamp_ntz")
    steps = df.agg((F.count_distinct(day) < F.count_distinct(time_col)).alias("_reduce"))
    d = attach(df, steps).withColumn("_at", F.when(F.col("_reduce"), day).otherwise(F.col(time_col)))
    return (d.groupBy(F.col("_at").alias(time_col), *CELL).agg(*[F.avg(c).alias(c) for c in variables]))


def to_matrix(df, value, axes=None):
    """One row per latitude: values in longitude order with NULL gaps (row width is the longitude axis).

    Several rows of one cell (two sources on a date) count with their mean.
    """
    ax = (axes or grid_axes(df, CELL))["longitude"]
    d = ax.index_of(df, "longitude", "_j", True).groupBy("latitude", "_j").agg(F.avg(value).alias(value))
    m = d.groupBy("latitude").agg(F.map_from_entries(F.collect_list(F.struct("_j", value))).alias("_m"))
    return m.select("latitude", F.transform(F.sequence(F.lit(0), F.lit(ax.n - 1)),
                                            lambda j: F.try_element_at("_m", j)).alias("values"))
