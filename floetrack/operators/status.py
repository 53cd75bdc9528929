"""Logs, inventories, model status, dashboards, upserts and purges."""
from pyspark.sql import functions as F

from floetrack.config import REAL_LABELS
from floetrack.functions.values import rnd
from floetrack.operators.stats import attach


def upsert(target, source, keys, keep_if_null=(), insert_only=False):
    """Rows of ``target`` updated and extended by ``source`` on null-safe keys.

    New values win; a column in ``keep_if_null`` keeps the old value where the new one is NULL; ``insert_only``
    leaves existing rows alone. Write the result to a new path and swap, as the inputs may be read from the old one.
    """
    cols = target.columns
    t = target.withColumn("_t", F.lit(True)).alias("t")
    s = source.withColumn("_s", F.lit(True)).alias("s")
    cond = None
    for k in keys:
        c = F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
        cond = c if cond is None else cond & c
    j = t.join(s, cond, "full_outer")
    out = []
    for c in cols:
        old = F.col(f"t.{c}")
        if c not in source.columns:
            out.append(old.alias(c))
            continue
        new = F.col(f"s.{c}")
        if c in keys:
            v = F.coalesce(new, old)
        elif insert_only:
            v = F.when(F.col("_t"), old).otherwise(new)
        elif c in keep_if_null:
            v = F.coalesce(new, old)
        else:
            v = F.when(F.col("_s"), new).otherwise(old)
        out.append(v.alias(c))
    return j.select(*out)


def purge(df, cond):
    """Rows for which the condition is not true."""
    return df.filter(~F.coalesce(cond, F.lit(False)))


def log_stats(df, group, demo="demo"):
    """Total, per-group count and demo count of a forecast or route log, one row per group."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(demo)).alias("_d"))
    t = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("_d"), F.lit(0)).alias("demo_count"))
    return attach(g.drop("_d"), t)


def forecast_stats(df):
    return log_stats(df, "model")


def route_stats(df):
    return log_stats(df, "preference")


def model_status(registry, metrics):
    """Status per pipeline by priority: trained on real data, source unknown, evaluated on real data, demo only, not available.

    ``registry`` has (pipeline, name, available, trained_on_demo); ``metrics`` has (pipeline, demo).
    """
    on = F.col("available")
    r = registry.groupBy("pipeline").agg(
        F.coalesce(F.bool_or(on), F.lit(False)).alias("file"),
        F.coalesce(F.bool_or(on & (~F.col("trained_on_demo"))), F.lit(False)).alias("real"),
        F.coalesce(F.bool_or(on & F.col("trained_on_demo").isNull()), F.lit(False)).alias("unk"))
    m = metrics.filter(~F.col("demo")).groupBy("pipeline").agg(F.count(F.lit(1)).alias("real_metrics"))
    j = r.join(m, "pipeline", "full_outer").withColumn("real_metrics", F.coalesce("real_metrics", F.lit(0)))
    f, real, unk = (F.coalesce(c, F.lit(False)) for c in ("file", "real", "unk"))
    status = (F.when(f & real, "trained_on_real_data").when(f & unk, "model_available_source_unknown")
              .when(F.col("real_metrics") > 0, "evaluated_on_real_data").when(f, "demo_only").otherwise("not_available"))
    src = (F.when(status.isin("trained_on_real_data", "evaluated_on_real_data"), "real")
           .when(status == "demo_only", "demo"))
    return j.select("pipeline", status.alias("status"), src.alias("training_data_source"),
                    (F.col("real_metrics") > 0).alias("metrics_available"), "real_metrics")


def dataset_inventory(classes, sources=None, descriptions=None):
    """Classified datasets with display label, status (demo / missing / ok), source and description, and an any-real flag."""
    raw = F.coalesce("classification", F.lit("unclassified"))
    labels = F.create_map(*[F.lit(x) for kv in REAL_LABELS.items() for x in kv])
    shown = F.when(raw.isin("pipeline_data", "raw"), F.coalesce(F.try_element_at(labels, F.col("dataset")), raw)).otherwise(raw)
    out = classes.withColumn("classification", shown)
    out = out.withColumn("status", F.when(F.col("classification") == "synthetic_demo", "demo")
                         .when(F.col("classification").isin("", "unknown", "unclassified"), "missing").otherwise("ok"))
    if sources is not None:
        first = sources.groupBy("dataset").agg(F.min(F.struct("source_id", "source_name")).alias("_s"))
        out = out.join(first, "dataset", "left").withColumn("source_id", F.col("_s.source_id")).withColumn(
            "source_name", F.col("_s.source_name")).drop("_s")
    if descriptions is not None:
        out = out.join(descriptions, "dataset", "left")
    real = ((~F.col("classification").isin("", "unknown", "unclassified", "synthetic_demo"))
            | ~F.coalesce(F.col("demo"), F.lit(True)))
    any_real = out.agg(F.coalesce(F.bool_or(real), F.lit(False)).alias("any_real"))
    return attach(out, any_real)


def analytics_summary(routes, icebergs, forecasts, metrics):
    """One row of dashboard counts with warnings."""
    n = F.count(F.lit(1))
    out = routes.agg(n.alias("routes_stored"))
    out = attach(out, icebergs.agg(F.count_distinct("iceberg_id").alias("icebergs_tracked")))
    out = attach(out, forecasts.agg(n.alias("forecasts_stored")))
    out = attach(out, metrics.agg(n.alias("model_metrics_count"), F.count_if(~F.col("demo")).alias("_real")))
    warn = F.filter(F.array(
        F.when((F.col("_real") == 0) & (F.col("model_metrics_count") > 0), "No trained real-data model metrics found."),
        F.when(F.col("routes_stored") == 0, "No routes have been stored yet."),
        F.when(F.col("icebergs_tracked") == 0, "No icebergs seeded.")), lambda x: x.isNotNull())
    return out.withColumn("metrics_available", F.col("model_metrics_count") > 0).withColumn("warnings", warn).drop("_real")


def alert_counts(alerts, time_col="timestamp"):
    s = F.col("severity")
    return alerts.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("read")).alias("unread"),
                      F.count_if(s == "critical").alias("critical"), F.count_if(s.isin("warning", "high", "medium")).alias("warnings"),
                      F.max(time_col).alias("last_updated"))


def multi_horizon_summary(df, horizon="horizon_hours", value="concentration"):
    v = F.col(value)
    return df.groupBy(horizon).agg(rnd(F.avg(v) * 100.0, 2).alias("mean_pct"), rnd(F.max(v) * 100.0, 2).alias("max_pct"),
                                   rnd(F.count(v) * 100.0 / F.count(F.lit(1)), 1).alias("coverage_pct"))


def order_metrics(df):
    return df.orderBy("pipeline", "model", "metric_name")


def forecast_log(summary, model, horizon_hours, forecast_time, demo=False):
    """A forecast-log row from a one-row field summary (mean, max, coverage_pct)."""
    t = F.lit(forecast_time).cast("timestamp_ntz")
    return summary.select(
        t.alias("forecast_time"), (t + F.expr(f"interval {int(horizon_hours)} hours")).alias("valid_time"),
        F.lit(int(horizon_hours)).alias("horizon_hours"), F.lit(model).alias("model"), F.col("mean").alias("mean_concentration"),
        F.col("max").alias("max_concentration"), "coverage_pct", F.lit(demo).alias("demo"))
