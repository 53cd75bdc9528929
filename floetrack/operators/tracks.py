"""Per-track operators: kinematics, lags, sequences, splits, latest state."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from floetrack.config import NM_TO_KM, R_KM, R_KM_ROUND, R_NM
from floetrack.functions import geo
from floetrack.functions.values import rnd
from floetrack.operators import ordered as od
from floetrack.operators.stats import attach, exact_median, global_cuts

KEY = ["iceberg_id"]
ORDER = ["obs_time", "event_id"]


def kinematics(tracks, min_hours=0.05, key=KEY, order=ORDER, chunk=od.AUTO):
    """Step time, distance, speed, bearing, heading change, running and total path, first fix and age."""
    width = od.chunk_width(tracks, key, order, chunk)
    h = od.with_halo(tracks, key, order, width, before=2)
    w = od.window(key, order, width)
    lat0, lon0, t0 = (F.lag(c).over(w) for c in ("latitude", "longitude", order[0]))
    h = h.withColumn("_lat0", lat0).withColumn("_lon0", lon0).withColumn("_t0", t0)
    h = (h.withColumn("_dt", F.greatest(geo.hours_between(order[0], "_t0"), F.lit(min_hours)))
         .withColumn("_dt", F.when(F.col("_t0").isNotNull(), F.col("_dt")))
         .withColumn("_nm", geo.haversine("_lat0", "_lon0", "latitude", "longitude", R_NM))
         .withColumn("_brg", geo.bearing("_lat0", "_lon0", "latitude", "longitude")))
    h = h.withColumn("_turn", F.col("_brg") - F.lag("_brg").over(w))
    base = od.drop_halo(h, keep_chunk=True)
    base = base.withColumn("_run", F.sum(F.coalesce("_nm", F.lit(0.0))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    base = od.with_prefix(base, key, width, sums=["_nm"], mins=[order[0]])
    out = (base
           .withColumn("time_diff_hours", rnd("_dt", 4))
           .withColumn("displacement_nm", rnd("_nm", 4))
           .withColumn("speed_knots", rnd(F.col("_nm") / F.col("_dt"), 4))
           .withColumn("bearing_deg", rnd("_brg", 2))
           .withColumn("heading_change_deg", rnd(F.pmod(F.col("_turn") + 180.0, F.lit(360.0)) - 180.0, 2))
           .withColumn("distance_traveled_nm", rnd(F.col("_nm_before") + F.col("_run"), 4))
           .withColumn("track_displacement_nm", rnd(F.coalesce("_nm_total", F.lit(0.0)), 4))
           .withColumn("first_seen", F.col(f"{order[0]}_min"))
           .withColumn("age_hours", rnd(geo.hours_between(order[0], f"{order[0]}_min"), 2)))
    return out.drop(*[c for c in out.columns if c.startswith("_")], f"{order[0]}_min")


def with_lags(df, cols, key=KEY, order=ORDER, prefix="prev_", chunk=od.AUTO):
    """Previous value of each column within its key."""
    width = od.chunk_width(df, key, order, chunk)
    h = od.with_halo(df, key, order, width, before=1)
    w = od.window(key, order, width)
    for c in cols:
        h = h.withColumn(f"{prefix}{c}", F.lag(c).over(w))
    return od.drop_halo(h)


def feature_lags(df, sic="sic", key=KEY, order=ORDER):
    """Lagged concentration and change, previous position, re-derived displacement (nm) and heading."""
    out = with_lags(df, [sic, "latitude", "longitude"], key, order, prefix="_p_")
    return (out.withColumnRenamed(f"_p_{sic}", "sic_lag").withColumnRenamed("_p_latitude", "prev_latitude")
            .withColumnRenamed("_p_longitude", "prev_longitude")
            .withColumn("sic_change", F.col(sic) - F.col("sic_lag"))
            .withColumn("displacement_nm", geo.haversine("prev_latitude", "prev_longitude", "latitude", "longitude", R_NM))
            .withColumn("iceberg_heading_deg", geo.bearing("prev_latitude", "prev_longitude", "latitude", "longitude")))


def _per_key(df, key, aggs, time_col, chunk=od.AUTO):
    """Join per-key aggregates back through (key, chunk), so a hot key stays spread."""
    width = od.chunk_width(df, key, [time_col], chunk)
    return od.with_prefix(od.with_chunk(df, [time_col], width), key, width, **aggs).drop(od.CHUNK)


def time_features(df, key=KEY, time_col="obs_time"):
    """Hour, day of year, month and days since the key's first observation."""
    out = _per_key(df, key, dict(mins=[time_col]), time_col)
    return (out.withColumn("hour_of_day", F.hour(time_col)).withColumn("day_of_year", F.dayofyear(time_col))
            .withColumn("month", F.month(time_col))
            .withColumn("days_since_first_obs", rnd(geo.hours_between(time_col, f"{time_col}_min") / 24.0, 4))
            .drop(f"{time_col}_min"))


def track_max(df, col, out, key=KEY, time_col="obs_time"):
    return _per_key(df, key, dict(maxs=[col]), time_col).withColumnRenamed(f"{col}_max", out)


def latest_state(df, per_column=True, key=KEY, time_col="obs_time", tie="event_id"):
    """Latest state per key: last non-NULL value per column, or the whole row with the greatest time.

    In the whole-row variant the first row seen wins a time tie.
    """
    rest = [c for c in df.columns if c not in key]
    if per_column:
        at = F.struct(time_col, tie)
        return df.groupBy(*key).agg(*[
            F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest])
    return (df.withColumn("_neg", -F.col(tie)).groupBy(*key)
            .agg(F.max_by(F.struct(*rest), F.struct(time_col, "_neg")).alias("_b")).select(*key, "_b.*"))


def first_attributes(df, cols, key=KEY, order=ORDER):
    """Attributes of the first row of each key."""
    return (df.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_b")).select(*key, "_b.*"))


def obs_counts(df, key=KEY):
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_obs"))


def has_multi_time(df, key=KEY, time_col="obs_time"):
    """One row: does any key have more than one distinct time."""
    per = df.groupBy(*key).agg((F.min(time_col) < F.max(time_col)).alias("m"))
    return per.agg(F.coalesce(F.bool_or("m"), F.lit(False)).alias("any_track"))


def median_step_hours(df, key=KEY, order=ORDER, whole_hours=True, name="median_dt_hours", chunk=od.AUTO):
    """Median step per key in hours (whole clock hours by default)."""
    h = with_lags(df.select(*key, *order), [order[0]], key, order, "_p_", chunk)
    t = F.col(order[0])
    if whole_hours:
        step = F.floor(geo.micros(t) / 3.6e9) - F.floor(geo.micros(f"_p_{order[0]}") / 3.6e9)
    else:
        step = geo.hours_between(t, f"_p_{order[0]}")
    return exact_median(h.withColumn("_step", step), "_step", key, name)


def project_tracks(df, key=KEY, order=ORDER, chunk=od.AUTO):
    """Tangent-plane position and velocity around each track's first fix, steps and path in km."""
    width = od.chunk_width(df, key, order, chunk)
    base = od.with_chunk(df, order, width)
    pos = F.struct(F.struct(*order).alias("o"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    base = base.withColumn("_pos", pos)
    base = od.with_prefix(base, key, width, mins=["_pos"])
    xy = geo.to_plane("latitude", "longitude", F.col("_pos_min.lat"), F.col("_pos_min.lon"))
    base = (base.withColumn("origin_lat", F.col("_pos_min.lat")).withColumn("origin_lon", F.col("_pos_min.lon"))
            .withColumn("_xy", xy).withColumn("x_km", F.col("_xy.x")).withColumn("y_km", F.col("_xy.y"))
            .drop("_pos", "_pos_min", "_xy", od.CHUNK))
    h = od.with_halo(base, key, order, width, before=1)
    w = od.window(key, order, width)
    for c in ("x_km", "y_km", "latitude", "longitude", order[0]):
        h = h.withColumn(f"_p_{c}", F.lag(c).over(w))
    hour = lambda c: F.floor(geo.micros(c) / 3.6e9)
    dt = F.nullif((hour(order[0]) - hour(f"_p_{order[0]}")).cast("double"), F.lit(0.0))
    h = od.drop_halo(h.withColumn("_dt", dt), keep_chunk=True)
    h = (h.withColumn("dt_hours", F.col("_dt"))
         .withColumn("vx_kmh", (F.col("x_km") - F.col("_p_x_km")) / F.col("_dt"))
         .withColumn("vy_kmh", (F.col("y_km") - F.col("_p_y_km")) / F.col("_dt"))
         .withColumn("displacement_km", geo.haversine("_p_latitude", "_p_longitude", "latitude", "longitude", R_KM))
         .withColumn("direction_deg", geo.bearing("_p_latitude", "_p_longitude", "latitude", "longitude"))
         .withColumn("speed_kmh", F.col("displacement_km") / F.col("_dt"))
         .withColumn("length_km", F.col("length_nm") * NM_TO_KM).withColumn("width_km", F.col("width_nm") * NM_TO_KM))
    h = h.withColumn("_run", F.sum(F.coalesce("displacement_km", F.lit(0.0))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    h = od.with_prefix(h, key, width, sums=["displacement_km"])
    h = h.withColumn("distance_traveled_km", F.col("displacement_km_before") + F.col("_run"))
    return h.drop(*[c for c in h.columns if c.startswith("_")], "displacement_km_before", "displacement_km_total")


def track_windows(df, features, seq_len=5, horizon=4, target=("x_km", "y_km"), key=KEY, order=ORDER, chunk=od.AUTO):
    """Sliding windows of ``seq_len`` rows with the target ``horizon`` rows after the window's end.

    Windows with a missing feature or target, and tracks shorter than ``seq_len + horizon + 1``, are left out.
    """
    width = od.chunk_width(df, key, order, chunk)
    counted = od.row_numbers(df, key, order, width, "_rn", "_n")
    counted = counted.filter(F.col("_n") >= seq_len + horizon + 1)
    h = od.with_halo(counted, key, order, width, before=seq_len - 1, after=horizon)
    w = od.window(key, order, width)
    fw = w.rowsBetween(-(seq_len - 1), 0)
    h = (h.withColumn("window", F.collect_list(F.struct(*features)).over(fw))
         .withColumn("start_time", F.first(order[0]).over(fw))
         .withColumn("target_time", F.lead(order[0], horizon).over(w)))
    for c in target:
        h = h.withColumn(f"target_{c}", F.lead(c, horizon).over(w))
    ok = (F.size("window") == seq_len) & F.forall("window", lambda r: F.forall(
        F.array(*[r[f].cast("double") for f in features]), lambda x: x.isNotNull()))
    for c in target:
        ok = ok & F.col(f"target_{c}").isNotNull()
    return (od.drop_halo(h).filter(ok)
            .withColumn("last_lat", F.col("latitude")).withColumn("last_lon", F.col("longitude"))
            .drop("_rn", "_n"))


def chrono_split(df, fracs=(0.70, 0.15, 0.15), time_col="obs_time", ties=("iceberg_id", "event_id"), keep_one=False):
    """Train / val / test by global time order and row fractions (half-even rounding); adds ``split``."""
    if abs(sum(fracs) - 1.0) > 1e-8:
        raise ValueError(f"fractions must sum to 1, got {sum(fracs)}")
    n = F.count(F.lit(1))
    tr, va = F.bround(n * F.lit(float(fracs[0]))).cast("long"), F.bround(n * F.lit(float(fracs[1]))).cast("long")
    if keep_one:
        tr = F.least(F.greatest(tr, F.lit(1)), n - 2)
        va = F.least(F.greatest(va, F.lit(1)), n - tr - 1)
    cuts = df.agg(tr.alias("_tr"), (tr + va).alias("_va"))
    ranks = cuts.select(F.array("_tr", "_va").alias("ranks"))
    rows = global_cuts(df, time_col, ties, ranks)
    at = F.struct(time_col, *ties)
    bounds = attach(rows, cuts).agg(
        F.max(F.when(F.col("_rank") == F.col("_tr"), at)).alias("_cut_tr"),
        F.max(F.when(F.col("_rank") == F.col("_va"), at)).alias("_cut_va"))
    out = attach(df, bounds)
    return (out.withColumn("split", F.when(at <= F.col("_cut_tr"), "train").when(at <= F.col("_cut_va"), "val")
                           .otherwise("test")).drop("_cut_tr", "_cut_va"))


def span_split(df, time_col="obs_time", ties=("iceberg_id", "event_id"), bounds=(0.70, 0.85)):
    """Split by the time span; when a part would be empty, by row fractions (truncated) instead."""
    us = geo.micros(time_col)
    span = df.agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    b1 = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * bounds[0]
    b2 = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * bounds[1]
    out = attach(df, span).withColumn("split", F.when(us <= b1, "train").when(us <= b2, "val").otherwise("test"))
    cuts = span.select((F.col("_n") * bounds[0]).cast("long").alias("_tr"), (F.col("_n") * bounds[1]).cast("long").alias("_va"))
    parts = out.agg(F.count_distinct("split").alias("_parts"))
    at = F.struct(time_col, *ties)
    rows = global_cuts(df, time_col, ties, cuts.select(F.array("_tr", "_va").alias("ranks")))
    edge = attach(rows, cuts).agg(F.max(F.when(F.col("_rank") == F.col("_tr"), at)).alias("_ct"),
                                  F.max(F.when(F.col("_rank") == F.col("_va"), at)).alias("_cv"))
    out = attach(attach(out, parts), edge)
    by_row = F.when(at <= F.col("_ct"), "train").when(at <= F.col("_cv"), "val").otherwise("test")
    return (out.withColumn("split", F.when(F.col("_parts") == 3, F.col("split")).otherwise(by_row))
            .drop("_lo", "_hi", "_n", "_parts", "_ct", "_cv"))


def per_track_split(df, key=KEY, order=ORDER, chunk=od.AUTO):
    """Split each track by position: max(1, int(.7 n)) train, int(.15 n) val, rest test; with the previous fix."""
    width = od.chunk_width(df, key, order, chunk)
    h = od.with_halo(df, key, order, width, before=1)
    w = od.window(key, order, width)
    for c in (order[0], "latitude", "longitude"):
        h = h.withColumn(f"prev_{c}", F.lag(c).over(w))
    out = od.drop_halo(h)
    out = od.row_numbers(out, key, order, width, "_rn", "n_obs")
    tr = F.greatest(F.lit(1), F.floor(F.col("n_obs") * F.lit(0.70)))
    va = F.floor(F.col("n_obs") * F.lit(0.15))
    idx = F.col("_rn") - 1
    return (out.withColumn("split", F.when(idx < tr, "train").when(idx < tr + va, "val").otherwise("test"))
            .withColumn("row_index", idx).drop("_rn"))


def sample_history(df, k=6, key=KEY, order=ORDER, chunk=od.AUTO):
    """Keys with more than ``k`` rows keep every k-th row and the last, one row per time."""
    width = od.chunk_width(df, key, order, chunk)
    out = od.row_numbers(df, key, order, width, "_rn", "_n")
    out = out.filter((F.col("_n") <= k) | ((F.col("_rn") - 1) % k == 0) | (F.col("_rn") == F.col("_n")))
    # rows sharing a time keep the last one
    cols = [c for c in out.columns if c not in ("_rn", "_n")]
    few = out.filter(F.col("_n") <= k).select(*cols)
    many = od.last_per_key(out.filter(F.col("_n") > k), list(key) + [order[0]], ["_rn"]).select(*cols)
    return few.unionByName(many)


def drift_features(df, key=KEY, order=ORDER, chunk=od.AUTO):
    """Interior rows with positive gaps: previous move, targets and horizon (no figure of the next fix among the features)."""
    width = od.chunk_width(df, key, order, chunk)
    h = od.with_halo(df, key, order, width, before=1, after=1)
    w = od.window(key, order, width)
    for c in ("latitude", "longitude", order[0]):
        h = h.withColumn(f"prev_{c}", F.lag(c).over(w)).withColumn(f"next_{c}", F.lead(c).over(w))
    h = od.drop_halo(h)
    t = order[0]
    h = (h.withColumn("time_diff_hours", geo.hours_between(t, f"prev_{t}"))
         .withColumn("target_horizon_hours", geo.hours_between(f"next_{t}", t))
         .filter((F.col("time_diff_hours") > 0) & (F.col("target_horizon_hours") > 0)))
    km = geo.haversine("prev_latitude", "prev_longitude", "latitude", "longitude", R_KM_ROUND)
    return (h.withColumn("prev_distance_km", km)
            .withColumn("prev_speed_kmh", F.col("prev_distance_km") / F.col("time_diff_hours"))
            .withColumn("prev_direction_deg", geo.bearing("prev_latitude", "prev_longitude", "latitude", "longitude"))
            .withColumn("month", F.month(t)).withColumn("season", geo.season(t))
            .withColumn("target_lat_delta", F.col("next_latitude") - F.col("latitude"))
            .withColumn("target_lon_delta", F.col("next_longitude") - F.col("longitude"))
            .withColumnRenamed("next_latitude", "target_latitude").withColumnRenamed("next_longitude", "target_longitude")
            .drop(f"prev_{t}", f"next_{t}"))


def tail_trials(df, seq_len=5, max_h=12, env=(), key=KEY, order=ORDER, chunk=od.AUTO):
    """Forecast starts in the last ``seq_len + max_h`` rows of each track, paired with the fixes k = 1..max_h later."""
    width = od.chunk_width(df, key, order, chunk)
    cols = [*key, *order, "latitude", "longitude", *env]
    n = od.row_numbers(df.select(*cols), key, order, width, "_rn", "_n")
    n = n.filter(F.col("_n") >= seq_len + max_h)
    h = od.with_halo(n, key, order, width, before=seq_len - 1, after=max_h)
    w = od.window(key, order, width)
    ok = F.lit(True)
    for c in env:
        ok = ok & (F.count(c).over(w.rowsBetween(-(seq_len - 1), 0)) == seq_len)
    fut = F.collect_list(F.struct(F.col(order[0]).alias("t"), F.col("latitude").alias("lat"),
                                  F.col("longitude").alias("lon"))).over(w.rowsBetween(1, max_h))
    h = h.withColumn("_ok", ok).withColumn("_fut", fut)
    # first start index is n - seq_len - max_h (0-based), i.e. the window ends at row n - max_h or later
    h = od.drop_halo(h).filter(F.col("_ok") & (F.col("_rn") >= F.col("_n") - max_h) & (F.col("_rn") >= seq_len))
    out = h.select(*key, F.col(order[0]).alias("start_time"), F.col("latitude").alias("start_lat"),
                   F.col("longitude").alias("start_lon"), F.posexplode("_fut").alias("_i", "_f"))
    return out.select(*key, "start_time", "start_lat", "start_lon", (F.col("_i") + 1).alias("k"),
                      geo.hours_between("_f.t", "start_time").alias("hours"),
                      F.col("_f.lat").alias("act_lat"), F.col("_f.lon").alias("act_lon"))


def trailing_mean(df, cols, seq_len=5, key=KEY, order=ORDER, chunk=od.AUTO):
    """Mean over the last ``seq_len`` fixes, NULLs skipped; adds ``<col>_mean``."""
    width = od.chunk_width(df, key, order, chunk)
    h = od.with_halo(df, key, order, width, before=seq_len - 1)
    w = od.window(key, order, width).rowsBetween(-(seq_len - 1), 0)
    for c in cols:
        h = h.withColumn(f"{c}_mean", F.avg(c).over(w))
    return od.drop_halo(h)


def interval_pairs(df, hours=2.0, tol=0.25, key=KEY, order=ORDER, chunk=od.AUTO):
    """Consecutive fixes whose gap is within ``tol`` of ``hours``."""
    h = with_lags(df, [order[0], "latitude", "longitude"], key, order, "prev_", chunk)
    gap = geo.hours_between(order[0], f"prev_{order[0]}")
    return h.withColumn("gap_hours", gap).filter(F.abs(F.col("gap_hours") - hours) <= tol)


def drop_speed_outliers(df, max_kmh=200.0, key=KEY, order=ORDER, chunk=od.AUTO):
    """Remove rows faster than ``max_kmh`` from the previous fix or not later than it."""
    h = with_lags(df, [order[0], "latitude", "longitude"], key, order, "_p_", chunk)
    dt = geo.hours_between(order[0], f"_p_{order[0]}")
    km = geo.haversine("_p_latitude", "_p_longitude", "latitude", "longitude", R_KM_ROUND)
    bad = F.col(f"_p_{order[0]}").isNotNull() & ((dt <= 0) | (F.try_divide(km, dt) > max_kmh))
    return h.filter(~F.coalesce(bad, F.lit(False))).drop(f"_p_{order[0]}", "_p_latitude", "_p_longitude")
