"""Forecast baselines, recursion, horizons and trajectories."""
from pyspark.sql import functions as F

from floetrack.functions import geo
from floetrack.functions.values import rnd
from floetrack.operators import ordered as od
from floetrack.operators import tracks as tr


def multi_horizon(df, horizons, time_col="obs_time"):
    """One row per horizon with its valid time."""
    h = F.explode(F.array(*[F.lit(int(x)) for x in horizons]))
    return df.withColumn("horizon_hours", h).withColumn(
        "valid_time", F.col(time_col) + F.make_dt_interval(hours=F.col("horizon_hours")))


def persist_position(df, horizons, time_col="obs_time"):
    """The entity stays where it is."""
    return (multi_horizon(df, horizons, time_col).withColumn("pred_lat", F.col("latitude"))
            .withColumn("pred_lon", F.col("longitude")))


def persist_field(df, value, horizons, time_col="obs_time"):
    """The field stays as it is, clipped to [0, 1]."""
    return multi_horizon(df, horizons, time_col).withColumn(
        "pred", F.when(F.col(value).isNotNull(), geo.clamp(value, 0.0, 1.0)))


def straight_line(df, hours, speed="drift_speed_kmh", bearing="drift_direction_deg"):
    """Straight drift; 1 km/h and 225 degrees where speed or direction is missing."""
    have = set(df.columns)
    s = F.coalesce(F.col(speed), F.lit(1.0)) if speed in have else F.lit(1.0)
    b = F.coalesce(F.col(bearing), F.lit(225.0)) if bearing in have else F.lit(225.0)
    h = F.col(hours) if isinstance(hours, str) else F.lit(float(hours))
    p = geo.destination("latitude", "longitude", b, s * h)
    return df.withColumn("_p", p).withColumn("pred_lat", F.col("_p.lat")).withColumn("pred_lon", F.col("_p.lon")).drop("_p")


def current_drift(df, steps, dt_hours="median_dt_hours", seq_len=5, u="uo", v="vo", key=tr.KEY, order=tr.ORDER, chunk=od.AUTO,
                  default_hours=6.0):
    """Advection at the trailing mean current for ``steps`` steps from every fix (needs tangent-plane columns).

    ``dt_hours`` is the length of a step: a number, or the column that holds it (join ``median_step_hours``), with
    ``default_hours`` where that is NULL or not positive. A column that is not there is an error.
    """
    if isinstance(dt_hours, str) and dt_hours not in df.columns:
        raise ValueError(f"no column {dt_hours}: join median_step_hours or give the hours of a step")
    d = tr.trailing_mean(df, [u, v], seq_len, key, order, chunk)
    fixed = F.lit(float(default_hours if isinstance(dt_hours, str) else dt_hours))
    dt = F.when(F.col(dt_hours) > 0, F.col(dt_hours)).otherwise(fixed) if isinstance(dt_hours, str) else fixed
    d = d.withColumn("_dt", dt).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(int(steps)))))
    x = F.col("x_km") + F.col(f"{u}_mean") * 3.6 * F.col("_dt") * F.col("k")
    y = F.col("y_km") + F.col(f"{v}_mean") * 3.6 * F.col("_dt") * F.col("k")
    p = geo.from_plane(x, y, "origin_lat", "origin_lon")
    return (d.withColumn("_p", p).withColumn("pred_lat", F.col("_p.lat")).withColumn("pred_lon", geo.wrap_lon(F.col("_p.lon")))
            .withColumn("hours_ahead", rnd(F.col("k") * F.col("_dt"), 3))
            .withColumn("step_km", F.hypot(F.col(f"{u}_mean"), F.col(f"{v}_mean")) * 3.6 * F.col("_dt"))
            .drop("_p", "_dt", f"{u}_mean", f"{v}_mean"))


def window_tails(df, seq_len=5, env=("uo", "vo", "u10", "v10"), key=tr.KEY, order=tr.ORDER, chunk=od.AUTO, before=0):
    """The last ``seq_len`` rows of every track as one array with trailing environment means: one small row per track.

    ``before`` more positions are kept in front of the window; they do not enter the means.

    Only the tail of each chunk and then of each track is collected, never the whole track.
    """
    cols = ["x_km", "y_km", "latitude", "longitude", "length_km", "width_km", "origin_lat", "origin_lon", *env]
    rn = od.row_numbers(df.select(*key, *order, *cols), key, order, od.chunk_width(df, key, order, chunk), "_rn", "_n")
    tail = rn.filter(F.col("_rn") > F.col("_n") - (seq_len + before))
    own = F.col("_rn") > F.col("_n") - seq_len
    return tail.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct(*order, "x_km", "y_km"))).alias("tail"),
        F.max_by("length_km", "_rn").alias("length_km"), F.max_by("width_km", "_rn").alias("width_km"),
        F.max_by("latitude", "_rn").alias("latitude"), F.max_by("longitude", "_rn").alias("longitude"),
        F.max("origin_lat").alias("origin_lat"), F.max("origin_lon").alias("origin_lon"), F.max("_n").alias("n_obs"),
        *[F.avg(F.when(own, F.col(c))).alias(c) for c in env])


def recursive_forecast(df, predictor, steps, seq_len=5, key="iceberg_id", env=("uo", "vo", "u10", "v10"), dt_hours=None,
                       chunk=od.AUTO, scale=None):
    """Feed each prediction back as the newest row of the window, the environment held at its trailing mean.

    ``df`` has tangent-plane columns; ``predictor(windows: ndarray[N, T, F]) -> ndarray[N, 2]`` gives the next x and y in km of
    N tracks and is called once per step and batch (tracks shorter than ``seq_len`` form batches of their own T). The window
    features are x, y, vx, vy, the environment means, length, width, sin and cos of the day of year; ``scale=(mean, std)``
    standardises them first. The velocity of a track's first fix is zero; a track without a usable median step takes six
    hours; missing features are NaN; a track whose key is NULL is a track. Tracks are reduced to the window and one fix
    before it first, so a task only ever holds tails.
    """
    tails = window_tails(df, seq_len, env, [key], chunk=chunk, before=1)
    if dt_hours is None:
        med = tr.median_step_hours(df, [key], chunk=chunk).withColumnRenamed(key, "_key")
        tails = tails.join(med, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    else:
        tails = tails.withColumn("median_dt_hours", F.lit(float(dt_hours)))
    part = lambda f: F.transform("tail", f)
    tails = tails.select(key, part(lambda r: geo.micros(r["obs_time"])).alias("ts"), part(lambda r: r["x_km"]).alias("xs"),
                         part(lambda r: r["y_km"]).alias("ys"), *env, "length_km", "width_km", "origin_lat", "origin_lon", "median_dt_hours")
    fixed = [*env, "length_km", "width_km"]

    def run(batches):
        import pandas as pd
        for pdf in batches:
            for _, same in pdf.groupby(pdf["ts"].map(len)):
                yield from (pd.DataFrame(step) for step in _steps(same, predictor, steps, seq_len, key, fixed, scale))

    out = tails.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, step int, forecast_time timestamp_ntz, hours_ahead double, "
                                 "x_km double, y_km double, _px double, _py double, origin_lat double, origin_lon double")
    at = lambda x, y: geo.from_plane(x, y, "origin_lat", "origin_lon")
    out = out.withColumn("_p", at("x_km", "y_km")).withColumn("_q", at("_px", "_py"))
    return out.select(key, "step", "forecast_time", "hours_ahead", F.col("_p.lat").alias("latitude"), geo.wrap_lon(F.col("_p.lon")).alias("longitude"),
                      "x_km", "y_km", geo.haversine("_q.lat", "_q.lon", "_p.lat", "_p.lon").alias("step_km"))


def _steps(tails, predictor, steps, seq_len, key, fixed, scale):
    """Columns of every step of tracks whose tails have one length."""
    import numpy as np
    t, x, y = (np.stack(tails[c].to_list()) for c in ("ts", "xs", "ys"))
    t, x, y = t.astype(np.int64), x.astype(float), y.astype(float)
    dt = tails["median_dt_hours"].to_numpy(float)
    dt = np.where(dt > 0, dt, 6.0)
    still = tails[fixed].to_numpy(float)
    for k in range(1, steps + 1):
        w = min(seq_len, max(1, t.shape[1]))
        back = lambda a: a[:, -w - 1:-1] if a.shape[1] > w else np.concatenate([a[:, :1], a[:, :-1]], axis=1)
        hours = np.maximum((t[:, -w:] - back(t)) / 3.6e9, 1e-9)
        day = t[:, -w:].astype("datetime64[us]").astype("datetime64[D]")
        angle = 2 * np.pi * (day - day.astype("datetime64[Y]").astype("datetime64[D]")).astype(float) / 366.0
        block = np.concatenate([
            np.stack([x[:, -w:], y[:, -w:], (x[:, -w:] - back(x)) / hours, (y[:, -w:] - back(y)) / hours], axis=-1),
            np.repeat(still[:, None, :], w, axis=1),
            np.stack([(np.sin(angle) + 1) / 2, (np.cos(angle) + 1) / 2], axis=-1)], axis=-1)
        if scale is not None:
            block = (block - np.asarray(scale[0], float)) / np.asarray(scale[1], float)
        to = np.asarray(predictor(block), dtype=float)
        if to.shape != (len(tails), 2):
            raise ValueError(f"predictor gave {to.shape} for {len(tails)} windows, (N, 2) is asked for")
        t = np.concatenate([t, t[:, -1:] + (dt * 3.6e9).astype(np.int64)[:, None]], axis=1)
        x, y = np.concatenate([x, to[:, :1]], axis=1), np.concatenate([y, to[:, 1:]], axis=1)
        yield {key: tails[key].to_numpy(), "step": np.full(len(tails), k, np.int32), "forecast_time": t[:, -1].astype("datetime64[us]"),
               "hours_ahead": np.round(k * dt, 3), "x_km": x[:, -1], "y_km": y[:, -1], "_px": x[:, -2], "_py": y[:, -2],
               "origin_lat": tails["origin_lat"].to_numpy(), "origin_lon": tails["origin_lon"].to_numpy()}


def zero_baseline(df):
    return df.withColumn("pred", F.lit(0.0))


def trajectory(observations, predictions, entities, key="iceberg_id", time_col="obs_time"):
    """Sampled history and predictions of every entity in one frame with step label, counts included.

    Entities without history get one observation from their latest position (``entities``: key, time, position).
    """
    hist = tr.sample_history(observations).select(key, F.col(time_col).alias("time"), "latitude", "longitude")
    lone = (entities.join(observations.select(key).distinct(), key, "left_anti")
            .select(key, F.col(time_col).alias("time"), "latitude", "longitude"))
    obs = (hist.unionByName(lone).withColumn("step", F.lit("observation")).withColumn("horizon_hours", F.lit(None).cast("int")))
    pred = predictions.select(key, F.lit(None).cast("timestamp_ntz").alias("time"), F.col("pred_lat").alias("latitude"),
                              F.col("pred_lon").alias("longitude"), F.lit("prediction").alias("step"),
                              F.col("horizon_hours").cast("int").alias("horizon_hours"))
    allr = obs.unionByName(pred)
    n = allr.groupBy(key).agg(F.count_if(F.col("step") == "observation").alias("count_observations"),
                              F.count_if(F.col("step") == "prediction").alias("count_predictions"))
    return allr.join(n, key)
