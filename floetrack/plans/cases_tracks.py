"""Track queries."""
from pyspark.sql import functions as F

from floetrack.functions import geo
from floetrack.functions.values import rnd
from floetrack.operators import tracks as tr
from floetrack.plans.registry import case, shared_cte

# Shared oracle blocks -------------------------------------------------------------------------------------------
HAV = ("2*{R}D*asin(sqrt(pow(sin(radians({b}-{a})/2),2)+cos(radians({a}))*cos(radians({b}))"
       "*pow(sin(radians({d}-{c})/2),2)))")


def hav(a, c, b, d, R="6371.0088"):
    """Oracle text of the haversine distance from (a, c) to (b, d)."""
    return HAV.format(a=a, b=b, c=c, d=d, R=R)


def brg(a, c, b, d):
    x = (f"degrees(atan2(sin(radians({d}-{c}))*cos(radians({b})), cos(radians({a}))*sin(radians({b}))"
         f"-sin(radians({a}))*cos(radians({b}))*cos(radians({d}-{c}))))")
    return f"((({x}) % 360D) + 360D) % 360D"


shared_cte("o_lag", f"""
select *, lag(latitude) over w as lat0, lag(longitude) over w as lon0, lag(obs_time) over w as t0,
  lead(latitude) over w as lat2, lead(longitude) over w as lon2, lead(obs_time) over w as t2,
  row_number() over w as rn, count(*) over (partition by iceberg_id) as n
from v_tracks window w as (partition by iceberg_id order by obs_time, event_id)""")

shared_cte("o_kin0", f"""
select *, case when t0 is not null then greatest((epoch_us(obs_time)-epoch_us(t0))/3.6e9D, 0.05D) end as dt,
  {hav('lat0', 'lon0', 'latitude', 'longitude', '3440.065')} as nm,
  {brg('lat0', 'lon0', 'latitude', 'longitude')} as b
from o_lag""")

shared_cte("o_kin", """
select *, b - lag(b) over w as turn, sum(coalesce(nm,0)) over w as run, sum(nm) over p as total, min(obs_time) over p as t_first
from o_kin0 window w as (partition by iceberg_id order by obs_time, event_id), p as (partition by iceberg_id)""")


@case("w01_kinematics", """
select iceberg_id, obs_time, event_id, round(dt,4)+0.0D as time_diff_hours, round(nm,4)+0.0D as displacement_nm,
  round(nm/dt,4)+0.0D as speed_knots, round(b,2)+0.0D as bearing_deg,
  round((((turn+180D) % 360D)+360D) % 360D - 180D, 2)+0.0D as heading_change_deg,
  round(run,4)+0.0D as distance_traveled_nm, round(coalesce(total,0),4)+0.0D as track_displacement_nm,
  t_first as first_seen, round((epoch_us(obs_time)-epoch_us(t_first))/3.6e9D,2)+0.0D as age_hours
from o_kin""")
def w01(v):
    return tr.kinematics(v.tracks).select(
        "iceberg_id", "obs_time", "event_id", "time_diff_hours", "displacement_nm", "speed_knots", "bearing_deg",
        "heading_change_deg", "distance_traveled_nm", "track_displacement_nm", "first_seen", "age_hours")


shared_cte("o_obs", "select *, length_nm as sic from v_tracks")


@case("w02_feature_lags", f"""
select iceberg_id, event_id, round(lag(length_nm) over w,6)+0.0D as sic_lag,
  round(length_nm-lag(length_nm) over w,6)+0.0D as sic_change, round(lat0,6)+0.0D as prev_latitude,
  round(lon0,6)+0.0D as prev_longitude, round(nm,6)+0.0D as displacement_nm, round(b,4)+0.0D as iceberg_heading_deg
from o_kin0 window w as (partition by iceberg_id order by obs_time, event_id)""")
def w02(v):
    out = tr.feature_lags(v.tracks, sic="length_nm")
    return out.select("iceberg_id", "event_id", *[rnd(c, 6).alias(c) for c in (
        "sic_lag", "sic_change", "prev_latitude", "prev_longitude", "displacement_nm")],
        rnd("iceberg_heading_deg", 4).alias("iceberg_heading_deg"))


@case("w03_time_features", """
select event_id, cast(hour(obs_time) as int) as hour_of_day, cast(dayofyear(obs_time) as int) as day_of_year,
  cast(month(obs_time) as int) as month,
  round((epoch_us(obs_time)-epoch_us(min(obs_time) over (partition by iceberg_id)))/86400e6D,4)+0.0D as days_since_first_obs
from v_tracks""")
def w03(v):
    return tr.time_features(v.tracks).select("event_id", "hour_of_day", "day_of_year", "month", "days_since_first_obs")


@case("w04_track_max", """
select event_id, round(max(length_nm) over (partition by iceberg_id),6)+0.0D as max_length from v_tracks""")
def w04(v):
    return tr.track_max(v.tracks, "length_nm", "m").select("event_id", rnd("m", 6).alias("max_length"))


shared_cte("o_plane", f"""
select *, (longitude-first_value(longitude) over w)*(pi()*6371.0088D/180D)*cos(radians(first_value(latitude) over w)) as x,
  (latitude-first_value(latitude) over w)*(pi()*6371.0088D/180D) as y,
  first_value(latitude) over w as lat_o, first_value(longitude) over w as lon_o,
  nullif((floor(epoch_us(obs_time)/3.6e9D)-floor(epoch_us(t0)/3.6e9D))::double,0D) as dth,
  {hav('lat0', 'lon0', 'latitude', 'longitude')} as km, {brg('lat0', 'lon0', 'latitude', 'longitude')} as dir
from o_lag window w as (partition by iceberg_id order by obs_time, event_id)""")


@case("w05_project_tracks", """
select event_id, round(x,6)+0.0D as x_km, round(y,6)+0.0D as y_km,
  round((x-lag(x) over w)/dth,6)+0.0D as vx_kmh, round((y-lag(y) over w)/dth,6)+0.0D as vy_kmh,
  round(km,6)+0.0D as displacement_km, round(km/dth,6)+0.0D as speed_kmh, round(dir,4)+0.0D as direction_deg,
  round(sum(coalesce(km,0)) over w,5)+0.0D as distance_traveled_km
from o_plane window w as (partition by iceberg_id order by obs_time, event_id)""")
def w05(v):
    out = tr.project_tracks(v.tracks)
    return out.select("event_id", *[rnd(c, 6).alias(c) for c in (
        "x_km", "y_km", "vx_kmh", "vy_kmh", "displacement_km", "speed_kmh")],
        rnd("direction_deg", 4).alias("direction_deg"), rnd("distance_traveled_km", 5).alias("distance_traveled_km"))


@case("w05_median_step", """
select iceberg_id, median(floor(epoch_us(obs_time)/3.6e9D)-floor(epoch_us(t0)/3.6e9D))::double as median_dt_hours
from o_lag where t0 is not null group by 1""")
def w05m(v):
    return tr.median_step_hours(v.tracks)


@case("w06_track_windows", """
select iceberg_id, event_id, start_time, target_time, round(tx,6)+0.0D as target_x_km, round(ty,6)+0.0D as target_y_km,
  round(s,4)+0.0D as window_sum
from (select *, first_value(obs_time) over f as start_time, lead(obs_time,4) over w as target_time, lead(x,4) over w as tx,
    lead(y,4) over w as ty, sum(x) over f as s, count(*) over f as c
  from o_plane window w as (partition by iceberg_id order by obs_time, event_id),
    f as (partition by iceberg_id order by obs_time, event_id rows between 4 preceding and current row)) q
where c = 5 and n >= 10 and tx is not null""")
def w06(v):
    t = v.tracks
    width = tr.od.chunk_width(t, tr.KEY, tr.ORDER)
    p = tr.project_tracks(t, chunk=width)
    out = tr.track_windows(p, ["x_km", "y_km", "length_km", "width_km"], chunk=width)
    total = F.aggregate("window", F.lit(0.0), lambda a, r: a + r["x_km"])
    return out.select("iceberg_id", "event_id", "start_time", "target_time", rnd("target_x_km", 6).alias("target_x_km"),
                      rnd("target_y_km", 6).alias("target_y_km"), rnd(total, 4).alias("window_sum"))


@case("w10_chrono_split", """
select event_id, case when r <= round_even(n*0.70D,0) then 'train'
  when r <= round_even(n*0.70D,0) + round_even(n*0.15D,0) then 'val' else 'test' end as split
from (select event_id, row_number() over (order by obs_time, iceberg_id, event_id) as r, count(*) over () as n from v_tracks)""")
def w10(v):
    return tr.chrono_split(v.tracks).select("event_id", "split")


@case("w11_span_split", """
select event_id, case when epoch_us(obs_time) <= lo+(hi-lo)*0.70D then 'train'
  when epoch_us(obs_time) <= lo+(hi-lo)*0.85D then 'val' else 'test' end as split
from v_tracks, (select epoch_us(min(obs_time)) lo, epoch_us(max(obs_time)) hi from v_tracks)""")
def w11(v):
    return tr.span_split(v.tracks).select("event_id", "split")


@case("w12_per_track_split", """
select event_id, n as n_obs, case when rn-1 < greatest(1, floor(n*0.70D)) then 'train'
  when rn-1 < greatest(1, floor(n*0.70D)) + floor(n*0.15D) then 'val' else 'test' end as split,
  round(lat0,6)+0.0D as prev_latitude
from o_lag""")
def w12(v):
    return tr.per_track_split(v.tracks).select("event_id", "n_obs", "split", rnd("prev_latitude", 6).alias("prev_latitude"))


@case("w14_sample_history", """
select iceberg_id, event_id, obs_time from (select *, row_number() over (partition by iceberg_id, obs_time order by rn desc) as k
  from o_lag where n <= 6 or (rn-1) % 6 = 0 or rn = n) where n <= 6 or k = 1""")
def w14(v):
    return tr.sample_history(v.tracks).select("iceberg_id", "event_id", "obs_time")


shared_cte("o_drift", f"""
select *, (epoch_us(obs_time)-epoch_us(t0))/3.6e9D as dt, (epoch_us(t2)-epoch_us(obs_time))/3.6e9D as ld,
  {hav('lat0', 'lon0', 'latitude', 'longitude', '6371.0')} as pk, {brg('lat0', 'lon0', 'latitude', 'longitude')} as pd
from o_lag where t0 is not null and t2 is not null and t0 < obs_time and obs_time < t2""")


@case("w15_drift_features", """
select iceberg_id, event_id, round(dt,6)+0.0D as time_diff_hours, round(pk/dt,6)+0.0D as prev_speed_kmh,
  round(pd,4)+0.0D as prev_direction_deg, cast(month(obs_time) as int) as month,
  case when month(obs_time) in (12,1,2) then 'summer' when month(obs_time) in (3,4,5) then 'autumn'
    when month(obs_time) in (6,7,8) then 'winter' else 'spring' end as season,
  round(lat2-latitude,6)+0.0D as target_lat_delta, round(lon2-longitude,6)+0.0D as target_lon_delta,
  round(ld,6)+0.0D as target_horizon_hours
from o_drift""")
def w15(v):
    return tr.drift_features(v.tracks).select(
        "iceberg_id", "event_id", rnd("time_diff_hours", 6).alias("time_diff_hours"),
        rnd("prev_speed_kmh", 6).alias("prev_speed_kmh"), rnd("prev_direction_deg", 4).alias("prev_direction_deg"),
        "month", "season", *[rnd(c, 6).alias(c) for c in ("target_lat_delta", "target_lon_delta", "target_horizon_hours")])


@case("w16_tail_trials", """
select a.iceberg_id, a.obs_time as start_time, cast(b.rn-a.rn as int) as k,
  round((epoch_us(b.obs_time)-epoch_us(a.obs_time))/3.6e9D,6)+0.0D as hours, round(b.latitude,6)+0.0D as act_lat
from o_lag a join o_lag b on a.iceberg_id=b.iceberg_id and b.rn between a.rn+1 and a.rn+12
where a.n >= 17 and a.rn >= a.n-12 and a.rn >= 5""")
def w16(v):
    return tr.tail_trials(v.tracks).select("iceberg_id", "start_time", F.col("k").cast("int").alias("k"),
                                           rnd("hours", 6).alias("hours"), rnd("act_lat", 6).alias("act_lat"))


@case("w20_trailing_mean", """
select event_id, round(avg(length_nm) over (partition by iceberg_id order by obs_time, event_id
  rows between 4 preceding and current row),6)+0.0D as length_mean from v_tracks""")
def w20(v):
    return tr.trailing_mean(v.tracks, ["length_nm"]).select("event_id", rnd("length_nm_mean", 6).alias("length_mean"))


@case("a01_latest_per_column", """
select iceberg_id, arg_max(nullif(remarks,'click'), (obs_time, event_id)) filter (where nullif(remarks,'click') is not null) as remarks,
  round(arg_max(latitude,(obs_time,event_id)),6)+0.0D as latitude from v_tracks group by 1""")
def a01a(v):
    d = v.tracks.withColumn("remarks", F.nullif("remarks", F.lit("click")))
    return tr.latest_state(d).select("iceberg_id", "remarks", rnd("latitude", 6).alias("latitude"))


@case("a01_latest_row", """
select iceberg_id, arg_max(event_id,(obs_time,-event_id)) as event_id, max(obs_time) as obs_time,
  arg_min(remarks,(obs_time,event_id)) as name from v_tracks group by 1""")
def a01b(v):
    t = v.tracks
    names = tr.first_attributes(t, ["remarks"]).withColumnRenamed("remarks", "name")
    return tr.latest_state(t, per_column=False).join(names, "iceberg_id").select("iceberg_id", "event_id", "obs_time", "name")


@case("a39_obs_counts", "select iceberg_id, count(*) as n_obs from v_tracks group by 1")
def a39(v):
    return tr.obs_counts(v.tracks)


@case("a39_any_track", """
select bool_or(m) as any_track from (select count(distinct obs_time) > 1 as m from v_tracks group by iceberg_id)""")
def a39b(v):
    return tr.has_multi_time(v.tracks)


@case("j19_interval_pairs", """
select iceberg_id, event_id, round((epoch_us(obs_time)-epoch_us(t0))/3.6e9D,6)+0.0D as gap_hours,
  round(lat0,6)+0.0D as prev_latitude from o_lag
where abs((epoch_us(obs_time)-epoch_us(t0))/3.6e9D - 2.0D) <= 0.25D""")
def j19(v):
    return tr.interval_pairs(v.tracks).select("iceberg_id", "event_id", rnd("gap_hours", 6).alias("gap_hours"),
                                              rnd("prev_latitude", 6).alias("prev_latitude"))


@case("p23_speed_outliers", f"""
select iceberg_id, event_id from (select *, (epoch_us(obs_time)-epoch_us(t0))/3.6e9D as dt,
  {hav('lat0', 'lon0', 'latitude', 'longitude', '6371.0')} as km from o_lag)
where t0 is null or not (dt <= 0 or km/nullif(dt,0) > 20D)""")
def p23(v):
    return tr.drop_speed_outliers(v.tracks, max_kmh=20.0).select("iceberg_id", "event_id")
