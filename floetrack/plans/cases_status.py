"""Log, inventory and dashboard queries."""
from pyspark.sql import functions as F

from floetrack.functions import risk
from floetrack.functions.values import rnd
from floetrack.operators import grids as g
from floetrack.operators import status as st
from floetrack.sources import store
from floetrack.operators.stats import attach
from floetrack.plans.cases_joins import latest
from floetrack.plans.registry import case
from floetrack.plans.scratch import scratch


@case("s17_upsert", """
select coalesce(s.pipeline,t.pipeline) as pipeline, coalesce(s.model,t.model) as model, coalesce(s.metric_name,t.metric_name) as metric_name,
 case when s.pipeline is not null then s.v else t.v end as v, coalesce(s.seen,t.seen) as seen
from (select pipeline, model, metric_name, avg(metric_value)::double as v, 'old' as seen from v_metrics where model <> 'model_2' group by 1,2,3) t
full join (select pipeline, model, metric_name, max(metric_value) as v, case when metric_name='view' then null else 'new' end as seen from v_metrics where model <> 'model_0' group by 1,2,3) s
on s.pipeline=t.pipeline and s.model=t.model and s.metric_name=t.metric_name""")
def s17(v):
    k = ["pipeline", "model", "metric_name"]
    old = v.metrics.filter("model <> 'model_2'").groupBy(*k).agg(F.avg("metric_value").alias("v")).withColumn("seen", F.lit("old"))
    new = v.metrics.filter("model <> 'model_0'").groupBy(*k).agg(F.max("metric_value").alias("v")).withColumn(
        "seen", F.when(F.col("metric_name") != "view", "new"))
    return st.upsert(old, new, k, keep_if_null=("seen",))


@case("s17_upsert_store", """
select coalesce(s.pipeline,t.pipeline) as pipeline, coalesce(s.model,t.model) as model, coalesce(s.metric_name,t.metric_name) as metric_name,
 case when s.pipeline is not null then s.v else t.v end as v, coalesce(s.seen,t.seen) as seen
from (select pipeline, model, metric_name, avg(metric_value)::double as v, 'old' as seen from v_metrics where model <> 'model_2' group by 1,2,3) t
full join (select pipeline, model, metric_name, max(metric_value) as v, case when metric_name='view' then null else 'new' end as seen from v_metrics where model <> 'model_0' group by 1,2,3) s
on s.pipeline=t.pipeline and s.model=t.model and s.metric_name=t.metric_name""")
def s17c(v):
    k = ["pipeline", "model", "metric_name"]
    at = store.Store(v.spark, f"{scratch(v.spark)}/metrics", k, 16)
    store.upsert_into(at, v.metrics.filter("model <> 'model_2'").groupBy(*k).agg(F.avg("metric_value").alias("v")).withColumn("seen", F.lit("old")))
    new = v.metrics.filter("model <> 'model_0'").groupBy(*k).agg(F.max("metric_value").alias("v")).withColumn("seen", F.when(F.col("metric_name") != "view", "new"))
    store.upsert_into(at, new, keep_if_null=("seen",))
    return at.read().select(*k, "v", "seen")


@case("s17_insert_only", """
select s_suppkey, s_nationkey from supplier where s_suppkey < 50 union all select s_suppkey, -1 from supplier where s_suppkey >= 50""")
def s17b(v):
    s = v.table("supplier").select("s_suppkey", "s_nationkey")
    return st.upsert(s.filter("s_suppkey < 50"), s.withColumn("s_nationkey", F.lit(-1).cast(s.schema["s_nationkey"].dataType)), ["s_suppkey"], insert_only=True)


@case("s18_purge", "select route_id from v_routes where not demo")
def s18(v):
    return st.purge(v.routes, F.col("demo")).select("route_id")


@case("a25_forecast_stats", """
select model, count(*) as n, (select count(*) from v_forecasts) as total, (select count(*) filter (where demo) from v_forecasts) as demo_count from v_forecasts group by 1""")
def a25(v):
    return st.forecast_stats(v.forecasts)


@case("a26_route_stats", """
select preference, count(*) as n, (select count(*) from v_routes) as total, (select count(*) filter (where demo) from v_routes) as demo_count from v_routes group by 1""")
def a26(v):
    return st.route_stats(v.routes)


@case("a27_analytics_summary", """
select (select count(*) from v_routes) as routes_stored, (select count(distinct iceberg_id) from v_tracks) as icebergs_tracked, (select count(*) from v_forecasts) as forecasts_stored,
 (select count(*) from v_metrics) as model_metrics_count, true as metrics_available, 0 as n_warnings""")
def a27(v):
    out = st.analytics_summary(v.routes, v.tracks, v.forecasts, v.metrics)
    return out.withColumn("n_warnings", F.size("warnings")).drop("warnings")


@case("a35_alert_counts", """
select count(*) as total, count(*) filter (where user_id % 2 = 0) as unread, count(*) filter (where value<5D) as critical, count(*) filter (where value>=5D and value<=30D) as warnings, max(ts) as last_updated from events""")
def a35(v):
    d = v.table("events").select(risk.alert_severity("iceberg", "value").alias("severity"), (F.col("user_id") % 2 != 0).alias("read"), F.col("ts").alias("timestamp"))
    return st.alert_counts(d)


@case("a36_multi_horizon_summary", """
select horizon_hours, round(avg(mean_concentration)*100D,2)+0.0D as mean_pct, round(max(mean_concentration)*100D,2)+0.0D as max_pct, 100D as coverage_pct from v_forecasts group by 1""")
def a36(v):
    return st.multi_horizon_summary(v.forecasts, value="mean_concentration")


@case("t04_order_metrics", "select pipeline, model, metric_name, metric_value from v_metrics order by 1,2,3")
def t04(v):
    return st.order_metrics(v.metrics).select("pipeline", "model", "metric_name", "metric_value")


@case("m09_forecast_log", """
select timestamp '2024-01-30' as forecast_time, timestamp '2024-01-31' as valid_time, 24 as horizon_hours, 'persistence' as model, round(avg(sic),6)+0.0D as mean_concentration,
 round(max(sic),6)+0.0D as max_concentration, round(count(sic)*100D/count(*),2)+0.0D as coverage_pct, false as demo from o_last""")
def m09(v):
    s = g.field_summary(g.latest_snapshot(v.grid), "sic")
    return st.forecast_log(s, "persistence", 24, "2024-01-30")
