"""Error metrics, scalers, scores."""
from pyspark.sql import functions as F

from floetrack.config import NM_TO_KM, SCORE_LABELS, SCORE_WEIGHTS
from floetrack.functions import geo
from floetrack.functions.risk import distance_score
from floetrack.functions.values import rnd, to_number
from floetrack.operators import tracks as tr
from floetrack.operators.stats import attach, exact_median


def regression_metrics(df, pred="pred", actual="actual", by=()):
    """n, MAE, MSE, RMSE, R2 (1 - SSE/SST), explained variance, bias (actual - pred), correlation, means."""
    p, a = to_number(pred), to_number(actual)
    ok = p.isNotNull() & a.isNotNull()
    d = df.withColumn("_p", F.when(ok, p)).withColumn("_a", F.when(ok, a)).withColumn("_e", F.col("_a") - F.col("_p"))
    m = d.groupBy(*by).agg(
        F.count("_e").alias("n"), F.avg(F.abs("_e")).alias("mae"), F.avg(F.col("_e") * F.col("_e")).alias("mse"),
        F.var_pop("_a").alias("_va"), F.var_pop("_e").alias("_ve"), F.var_pop("_p").alias("_vp"),
        F.covar_pop("_p", "_a").alias("_cov"), F.avg("_e").alias("mean_bias"), F.avg("_a").alias("mean_actual"),
        F.avg("_p").alias("mean_pred"))
    # a constant column leaves rounding noise in its variance, in proportion to its own scale
    va = F.when(F.col("_va") > 1e-24 * F.col("mean_actual") * F.col("mean_actual"), F.col("_va"))
    vp = F.when(F.col("_vp") > 1e-24 * F.col("mean_pred") * F.col("mean_pred"), F.col("_vp"))
    return m.select(*by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), (1.0 - F.col("mse") / va).alias("r2"),
                    ((va - F.col("_ve")) / va).alias("explained_variance"), "mean_bias",
                    F.when(F.col("n") > 1, F.col("_cov") / F.sqrt(va * vp)).alias("correlation"), "mean_actual", "mean_pred")


def band(col, lo, hi, width, include_last=False):
    """Lower edge of the half-open band holding the value, NULL outside ``[lo, hi)``."""
    c = F.col(col)
    n = int(round((hi - lo) / width))
    edges = [(round(lo + k * width, 10), round(lo + (k + 1) * width, 10)) for k in range(n)]
    out = F.lit(None).cast("double")
    for k, (x, y) in reversed(list(enumerate(edges))):
        top = (c <= y) if include_last and k == n - 1 else (c < y)
        out = F.when((c >= x) & top, F.lit(float(x))).otherwise(out)
    return out


def metrics_by_band(df, col="latitude", lo=-75.0, hi=-55.0, width=5.0, include_last=False, **kw):
    d = df.withColumn("band", band(col, lo, hi, width, include_last)).filter("band is not null")
    return regression_metrics(d, by=["band"], **kw)


def metrics_by_bin(df, col="actual", width=0.2, include_last=False, **kw):
    return metrics_by_band(df, col, 0.0, 1.0, width, include_last, **kw)


def horizon_metrics(df, scheme, hours="hours", km="km", by=()):
    """Count, mean and median error per horizon bucket. ``scheme``: ``day`` (<=36 / 60 / 84 h), ``range`` (half-open gaps)
    or ``cumulative`` (<=24 / 72 / 168 h, a row counts in every bucket it fits)."""
    h = F.col(hours)
    if scheme == "day":
        b = F.when(h <= 36, "24h").when(h <= 60, "48h").when(h <= 84, "72h")
        d = df.withColumn("bucket", b)
    elif scheme == "range":
        b = (F.when((h >= 0) & (h < 30), "0-30h").when((h >= 30) & (h < 96), "30-96h").when((h >= 96) & (h < 192), "96-192h")
             .when((h >= 192) & (h < 360), "192-360h").when(h >= 360, ">360h"))
        d = df.withColumn("bucket", b)
    else:
        limits = F.array(*[F.when(h <= m, F.lit(n)) for n, m in (("24h", 24.0), ("72h", 72.0), ("7d", 168.0))])
        d = df.withColumn("bucket", F.explode(limits))
    d = d.filter("bucket is not null")
    keys = [*by, "bucket"]
    return (d.groupBy(*keys).agg(F.count(km).alias("n"), F.avg(km).alias("mean_km"))
            .join(exact_median(d, km, keys, "median_km"), keys, "left"))


def within_shares(df, km="km", limits=(1, 5, 10, 25, 50)):
    return df.agg(*[F.avg((F.col(km) <= k).cast("int")).alias(f"within_{k}km") for k in limits])


def trajectory_scores(df, by=("model",)):
    """Per group: count, latitude / longitude RMSE in degrees, mean / median error in km, mean in nm.

    Input columns: pred_lat, pred_lon, act_lat, act_lon.
    """
    d = (df.withColumn("_km", geo.haversine("pred_lat", "pred_lon", "act_lat", "act_lon"))
         .withColumn("_dla", F.col("pred_lat") - F.col("act_lat")).withColumn("_dlo", F.col("pred_lon") - F.col("act_lon")))
    sq = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    keys = list(by)
    return (d.groupBy(*keys).agg(F.count("_km").alias("n"), sq("_dla").alias("lat_rmse_deg"), sq("_dlo").alias("lon_rmse_deg"),
                                 F.avg("_km").alias("mean_km"), (F.avg("_km") / NM_TO_KM).alias("mean_nm"))
            .join(exact_median(d, "_km", keys, "median_km"), keys, "left"))


def masked_error(df, pred="pred", actual="actual", mask="mask", by=()):
    p, a = to_number(pred), to_number(actual)
    e = F.when(F.coalesce(F.col(mask), F.lit(False)), p - a)
    return df.groupBy(*by).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def spatial_correlation(df, sample, pred="pred", actual="actual"):
    """Pearson per sample (NULL below two cells or without variance), then the mean over samples."""
    per = regression_metrics(df, pred, actual, by=[sample])
    return per.agg(F.avg("correlation").alias("spatial_correlation"), F.count("correlation").alias("n_samples"))


def fit_scaler(df, columns, mask=None, where=None):
    """One row per channel: mean and population std (1 when the std is negligible) over valid cells."""
    d = df.filter(where) if where is not None else df
    if mask is not None:
        d = d.filter(F.col(mask))
    one = d.agg(*[F.avg(to_number(c)).alias(f"{c}__m") for c in columns], *[F.stddev_pop(to_number(c)).alias(f"{c}__s") for c in columns])
    s = [F.struct(F.lit(c).alias("channel"), F.coalesce(F.col(f"{c}__m"), F.lit(0.0)).alias("mean"),
                  F.when(F.col(f"{c}__s") > 1e-8, F.col(f"{c}__s")).when(F.col(f"{c}__s").isNull(), F.lit(1.0))
                  .otherwise(F.lit(1e-8)).alias("std")) for c in columns]
    return one.select(F.explode(F.array(*s)).alias("s")).select("s.*")


def apply_scaler(df, stats, columns, fill=None):
    """Standardise columns by a fitted scaler (one row per channel); ``fill`` replaces missing results."""
    wide = stats.agg(*[F.max(F.when(F.col("channel") == c, F.col(k))).alias(f"_{k}_{c}") for c in columns for k in ("mean", "std")])
    out = attach(df, wide)
    for c in columns:
        z = (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_std_{c}")
        out = out.withColumn(c, F.coalesce(z, F.lit(fill)) if fill is not None else z)
    return out.drop(*[f"_{k}_{c}" for c in columns for k in ("mean", "std")])


def position_metrics(df, by=()):
    """Latitude / longitude MAE, mean / median / max / RMSE km, mean nm and count of predicted positions."""
    d = (df.withColumn("_km", geo.haversine("pred_lat", "pred_lon", "act_lat", "act_lon"))
         .withColumn("_dla", F.abs(F.col("pred_lat") - F.col("act_lat"))).withColumn("_dlo", F.abs(F.col("pred_lon") - F.col("act_lon"))))
    keys = list(by)
    out = d.groupBy(*keys).agg(
        F.count("_km").alias("samples"), F.avg("_dla").alias("lat_mae_deg"), F.avg("_dlo").alias("lon_mae_deg"),
        F.avg("_km").alias("mean_km"), F.max("_km").alias("max_km"), F.sqrt(F.avg(F.col("_km") * F.col("_km"))).alias("rmse_km"),
        (F.avg("_km") / NM_TO_KM).alias("mean_nm"))
    med = exact_median(d, "_km", keys, "median_km")
    return out.join(med, keys, "left") if keys else attach(out, med)


def per_track_errors(df, key=tr.KEY, order=tr.ORDER, chunk=tr.od.AUTO):
    """Persistence error over each track's test part; tracks below two fixes need more data."""
    s = tr.per_track_split(df, key, order, chunk)
    km = F.when((F.col("split") == "test") & (F.col("row_index") > 0),
                geo.haversine("prev_latitude", "prev_longitude", "latitude", "longitude"))
    s = s.withColumn("_km", km)
    out = (s.groupBy(*key).agg(F.max("n_obs").alias("n_obs"), F.count("_km").alias("pairs"), F.avg("_km").alias("mean_km"))
           .join(exact_median(s, "_km", key, "median_km"), list(key), "left"))
    return out.withColumn("status", F.when(F.col("n_obs") < 2, "needs_more_data").otherwise("ok"))


def two_hour_eval(tracks, predictor=None, hours=2.0, tol=0.25, error_km=20.0, key=tr.KEY, time_col="obs_time",
                  chunk=tr.od.AUTO):
    """One row: evaluation of consecutive fixes about ``hours`` apart.

    Duplicate ``(id, time)`` rows and rows without time or position are counted and left out.
    ``predictor(prev_lat, prev_lon, gap_hours) -> (lat, lon)`` works on columns; without it the previous position is the prediction.
    """
    raw = tracks.withColumn("_lat", to_number("latitude")).withColumn("_lon", to_number("longitude"))
    bad = F.col(time_col).isNull() | F.col("_lat").isNull() | F.col("_lon").isNull()
    per = raw.groupBy(*key, time_col).agg(F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_bad"))
    counts = per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("records"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("_inv"),
                     F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_records"))
    ok = raw.filter(~bad & F.col(key[0]).isNotNull()).drop("latitude", "longitude").withColumnsRenamed({"_lat": "latitude", "_lon": "longitude"})
    rest = [c for c in ("event_id",) if c in ok.columns]
    clean = (ok.groupBy(*key, time_col).agg(F.min_by(F.struct("latitude", "longitude"), F.struct(*(rest or ["latitude", "longitude"]))).alias("_b"))
             .select(*key, time_col, "_b.*"))
    # the uncleaned table bounds the rows per track, so the skew check can use it
    width = tr.od.chunk_width(tracks, key, [time_col], chunk)
    h = tr.with_lags(clean, [time_col, "latitude", "longitude"], key, [time_col], "prev_", width)
    h = h.withColumn("gap_hours", geo.hours_between(time_col, f"prev_{time_col}"))
    pred = predictor(F.col("prev_latitude"), F.col("prev_longitude"), F.col("gap_hours")) if predictor else (
        F.col("prev_latitude"), F.col("prev_longitude"))
    hit = F.abs(F.col("gap_hours") - hours) <= tol
    h = h.withColumn("_err", F.when(hit, geo.haversine(pred[0], pred[1], "latitude", "longitude")))
    agg = h.agg(F.count_distinct(*key).alias("tracks"), F.count("_err").alias("pairs"), F.avg("_err").alias("_mean"),
                F.avg(F.when(F.col("_err").isNotNull(), distance_score("_err", error_km))).alias("_score"))
    out = attach(attach(agg, counts), exact_median(h, "gap_hours", name="median_gap_hours"))
    return out.select(
        "records", "tracks", "pairs", "duplicate_records", (F.col("_inv") + F.col("duplicate_records")).alias("missing_or_invalid"),
        rnd("median_gap_hours", 6).alias("median_gap_hours"), rnd("_mean", 4).alias("mean_error_km"),
        rnd(F.col("_mean") / NM_TO_KM, 4).alias("mean_error_nm"), rnd("_score", 4).alias("accuracy_percent"),
        F.when(F.col("pairs") > 0, "VERIFIED").otherwise("INSUFFICIENT_DATA").alias("status"))


def check_weights(weights):
    total = 0.0
    for k in SCORE_WEIGHTS:
        w = weights.get(k)
        if w is None or isinstance(w, bool) or not 0.0 <= float(w) <= 1.0:
            raise ValueError(f"missing or invalid weight for {k}")
        total += float(w)
    if abs(total - 1.0) > 1e-9:
        raise ValueError(f"component weights must sum to 1.0, got {total}")
    return {k: float(weights[k]) for k in SCORE_WEIGHTS}


def score_breakdown(components, weights=SCORE_WEIGHTS, by=()):
    """Component rows ``(component, value)`` against the weights: accuracy (NULL when invalid), weight, contribution, status.

    A missing value carries ``source_status`` when the frame has one, else N/A. With ``by`` every group is scored.
    """
    weights = check_weights(weights)
    keys = list(by)
    arr = F.array(*[F.struct(F.lit(k).alias("component"), F.lit(SCORE_LABELS[k]).alias("label"), F.lit(w).alias("weight"))
                    for k, w in weights.items()])
    have_status = "source_status" in components.columns
    v = to_number("value")
    c = components.select(*keys, "component", F.when((v >= 0) & (v <= 100), v).alias("accuracy"),
                          (F.col("source_status") if have_status else F.lit(None).cast("string")).alias("_st"))
    if keys:
        base = components.select(*keys).distinct().withColumn("_w", F.explode(arr)).select(*keys, "_w.*")
    else:
        base = components.sparkSession.range(1).select(F.explode(arr).alias("_w")).select("_w.*")
    out = base.join(c, keys + ["component"], "left")
    return out.select(*keys, "component", "label", "weight", "accuracy", (F.col("accuracy") * F.col("weight")).alias("contribution"),
                      F.when(F.col("accuracy").isNotNull(), "Valid").otherwise(F.coalesce("_st", F.lit("N/A"))).alias("status"))


def weighted_score(components, weights=SCORE_WEIGHTS, by=()):
    """Weighted score over the available components, with provisional flag, coverage and missing list."""
    b = score_breakdown(components, weights, by)
    s = F.sum("contribution")
    w = F.sum(F.when(F.col("accuracy").isNotNull(), F.col("weight")))
    miss = F.sort_array(F.collect_list(F.when(F.col("accuracy").isNull(), F.col("component"))))   # at most one per weight
    out = b.groupBy(*by).agg(s.alias("_s"), w.alias("_w"), miss.alias("missing_components"))
    score = F.round("_s", 12) / F.round("_w", 12)
    full = F.size("missing_components") == 0
    return out.select(
        *by, score.alias("score"), (~full & score.isNotNull()).alias("provisional"),
        F.coalesce(F.round("_w", 12) * 100.0, F.lit(0.0)).alias("coverage_percent"), "missing_components",
        F.when(full, "Valid").when(F.col("_w").isNull(), "N/A").otherwise("Provisional").alias("status"))


def grade(score, provisional):
    s, p = F.col(score), F.col(provisional)
    return (F.when(s.isNull(), "Not Available").when(p, "PROVISIONAL").when(s >= 85, "A (Production-Ready)")
            .when(s >= 70, "B (Research-Grade)").when(s >= 50, "C (Functional)").otherwise("D (Experimental)"))


def derive_components(reports, by=()):
    """Component rows from a report frame with sea_ice_r2, iceberg_mean_km, route_status, recalc_percent, recalc_status,
    land_percent, land_status."""
    st = lambda c: (F.when(F.col(c) == "INSUFFICIENT_DATA", "Insufficient data").when(F.col(c) == "FAILED", "Error").otherwise("N/A"))
    item = lambda n, v, s: F.struct(F.lit(n).alias("component"), v.cast("double").alias("value"), s.alias("source_status"))
    na = F.lit("N/A")
    arr = F.array(
        item("sea_ice", F.col("sea_ice_r2") * 100.0, na), item("iceberg", 100.0 - F.col("iceberg_mean_km"), na),
        item("route", F.when(F.col("route_status") == "VERIFIED", 100.0), na),
        item("recalc", F.when(F.col("recalc_status") == "VERIFIED", F.col("recalc_percent")), st("recalc_status")),
        item("land_mask", F.when(F.col("land_status") == "VERIFIED", F.col("land_percent")), st("land_status")))
    return reports.select(*by, F.explode(arr).alias("c")).select(*by, "c.*")


def accuracy_summary(reports, by=()):
    out = weighted_score(derive_components(reports, by), by=by)
    return out.withColumn("grade", grade("score", "provisional"))
