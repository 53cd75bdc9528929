"""Streaming queries: the tables are replayed as streams to completion and the result is read back."""
from pyspark.sql import functions as F

from floetrack.functions.values import rnd
from floetrack.operators import grids as g
from floetrack.operators.axes import grid_axes
from floetrack.plans.registry import case
from floetrack.plans.scratch import scratch
from floetrack.streaming import jobs


def _events(v):
    """The events table as a stream."""
    static = v.table("events")
    return v.spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(v.dir)


def _tracks(ev):
    return ev.selectExpr(
        "concat('B', cast(user_id as string)) as iceberg_id", "ts as obs_time",
        "-74.5D + (user_id*7 % 180)/10.0D + event_id/20000.0D as latitude",
        "-180.0D + (user_id*37 % 3600)/10.0D + (event_id*13 % 1000)/5000.0D as longitude", "event_id", "value")


def _run(v, df, mode="append"):
    """Run a streaming frame over all available input and return what it wrote."""
    out = scratch(v.spark)
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data").option("checkpointLocation", f"{out}/cp")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return v.spark.read.schema(df.schema).parquet(f"{out}/data")


@case("r01_stream_latest", """
select iceberg_id, arg_max(event_id,(obs_time,-event_id)) as event_id, max(obs_time) as obs_time from v_tracks group by 1""")
def r01(v):
    out = scratch(v.spark)
    jobs.stream_latest(_tracks(_events(v)), f"{out}/t", f"{out}/cp").awaitTermination()
    return jobs.read_latest(v.spark, f"{out}/t").select("iceberg_id", "event_id", "obs_time")


def _with_state(v, frame):
    """Run a stateful stream with the RocksDB provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = v.spark.conf.get(key, None)
    v.spark.conf.set(key, jobs.STATE_CONF[key])
    try:
        return _run(v, frame())
    finally:
        if old is None:
            v.spark.conf.unset(key)
        else:
            v.spark.conf.set(key, old)


@case("r02_stream_kinematics", """
select iceberg_id, event_id, round(dt,4)+0.0D as time_diff_hours, round(nm,4)+0.0D as displacement_nm from o_kin""")
def r02(v):
    out = _with_state(v, lambda: jobs.stream_kinematics(_tracks(_events(v))))
    return out.select("iceberg_id", "event_id", rnd("time_diff_hours", 4).alias("time_diff_hours"), rnd("displacement_nm", 4).alias("displacement_nm"))


@case("r02_stream_ordered", """
select k.iceberg_id, k.event_id, round(dt,4)+0.0D as time_diff_hours, round(nm,4)+0.0D as displacement_nm, false as late
from o_kin k where k.obs_time <= (select max(obs_time) - interval 1 day from v_tracks)""")
def r02b(v):
    out = _with_state(v, lambda: jobs.stream_kinematics_ordered(_tracks(_events(v)), "1 day"))
    return out.select("iceberg_id", "event_id", rnd("time_diff_hours", 4).alias("time_diff_hours"), rnd("displacement_nm", 4).alias("displacement_nm"), "late")


@case("r03_stream_monitor", """
select w as window_start, w + interval 2 hour as window_end, count(*) as n, round(avg(value),6)+0.0D as mean_value from (
 select value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as w from events) where w + interval 2 hour <= (select max(ts) - interval 1 day from events) group by 1""")
def r03(v):
    out = _run(v, jobs.stream_monitor(_tracks(_events(v)), "2 hours", "1 hour", value="value"))
    return out.withColumn("mean_value", rnd("mean_value", 6))


@case("r03_monitor_batch", """
select to_timestamp(floor(epoch(ts)/7200)*7200)::timestamp as window_start, count(*) as n from events group by 1""")
def r03b(v):
    return jobs.stream_monitor(_tracks(v.table("events"))).select("window_start", "n")


@case("r04_stream_gaps", """
select iceberg_id, min(obs_time) as first_fix, max(obs_time) as last_fix, count(*) as n from (select *, sum(s) over (partition by iceberg_id order by obs_time, event_id) as k from (
 select *, case when t0 is null or obs_time > t0 + interval 12 hour then 1 else 0 end as s from o_lag)) group by iceberg_id, k
having max(obs_time) + interval 12 hour <= (select max(obs_time) - interval 1 day from v_tracks)""")
def r04(v):
    return _run(v, jobs.stream_gaps(_tracks(_events(v)), "12 hours")).select("iceberg_id", "first_fix", "last_fix", "n")


@case("r04_gaps_batch", """
select iceberg_id, min(obs_time) as first_fix, max(obs_time) as last_fix, count(*) as n from (select *, sum(s) over (partition by iceberg_id order by obs_time, event_id) as k from (
 select *, case when t0 is null or obs_time > t0 + interval 12 hour then 1 else 0 end as s from o_lag)) group by iceberg_id, k""")
def r04b(v):
    return jobs.stream_gaps(_tracks(v.table("events")), "12 hours").select("iceberg_id", "first_fix", "last_fix", "n")


@case("r05_stream_unique_alerts", "select distinct user_id as alert_id from events")
def r05(v):
    a = _events(v).select(F.col("user_id").alias("alert_id"), F.col("ts").alias("timestamp"))
    return _run(v, jobs.stream_unique_alerts(a, "365 days")).select("alert_id")


@case("r06_stream_hazard", """
select t.event_id, c.is_land, round(c.z,3)+0.0D as total_risk from v_tracks t join o_navc c on c.ci=cast(least((select mi from o_b),greatest(0,ceil((t.latitude+74.5D)-0.5D))) as int)
 and c.cj=cast(least(35,greatest(0,ceil((t.longitude+180D)/10D-0.5D))) as int)""")
def r06(v):
    cells = v.cells.withColumn("total_risk", F.col("z"))
    ax = grid_axes(cells, ("latitude", "longitude"))
    out = _run(v, jobs.stream_hazard(_tracks(_events(v)), cells, ax, ("is_land", "total_risk")))
    return out.select("event_id", "is_land", rnd("total_risk", 3).alias("total_risk"))
