"""Forecast, evaluation and model queries."""
from pyspark.sql import functions as F

from floetrack.functions import geo
from floetrack.functions.values import rnd
from floetrack.operators import forecast as fc
from floetrack.operators import grids as g
from floetrack.operators import joins as j
from floetrack.operators import metrics as m
from floetrack.operators import ml
from floetrack.operators import ordered as od
from floetrack.operators import tracks as tr
from floetrack.plans.cases_functions import dest
from floetrack.plans.cases_joins import latest
from floetrack.plans.cases_tracks import hav
from floetrack.plans.registry import case, shared_cte


@case("m01_persist_position", """
select iceberg_id, cast(h as int) as horizon_hours, obs_time + to_hours(h) as valid_time, round(latitude,6) as pred_lat from o_latest, (select unnest([2,4,6,12,24,48,72]) as h)""")
def m01(v):
    from floetrack.config import TRACK_HORIZONS
    return fc.persist_position(latest(v), TRACK_HORIZONS).select("iceberg_id", "horizon_hours", "valid_time", rnd("pred_lat", 6).alias("pred_lat"))


@case("m01_persist_field", """
select latitude, longitude, cast(h as int) as horizon_hours, least(1D,greatest(0D,sic)) as pred from o_last, (select unnest([6,12,24,48,72]) as h) where sic is not null""")
def m01b(v):
    from floetrack.config import SEA_ICE_HORIZONS
    return fc.persist_field(g.latest_snapshot(v.grid, value="sic"), "sic", SEA_ICE_HORIZONS).select("latitude", "longitude", "horizon_hours", "pred")


@case("m02_straight_line", f"""
select event_id, round({dest('225D', '24D')[0]},6)+0.0D as pred_lat, round({dest('225D', '24D')[1]},6)+0.0D as pred_lon from v_tracks""")
def m02(v):
    return fc.straight_line(v.tracks, 24).select("event_id", rnd("pred_lat", 6).alias("pred_lat"), rnd("pred_lon", 6).alias("pred_lon"))


def _env_tracks(v):
    t = v.tracks
    width = od.chunk_width(t, tr.KEY, tr.ORDER)          # measured once, on the plain tracks
    e = j.env_join(t, v.grid, ["uo", "vo", "u10", "v10"], "x", None).drop("x_gap_hours", "x_stale")
    return tr.project_tracks(e, chunk=width), width


shared_cte("o_cur", """
select p.event_id, p.iceberg_id, p.x, p.y, p.lat_o, p.lon_o, avg(e.uo) over w as u, avg(e.vo) over w as vv from o_plane p join o_env e using(event_id)
window w as (partition by p.iceberg_id order by p.obs_time, p.event_id rows between 4 preceding and current row)""")


@case("m03_current_drift", """
with m as (select iceberg_id, median(floor(epoch_us(obs_time)/3.6e9D)-floor(epoch_us(t0)/3.6e9D))::double as m from o_lag where t0 is not null group by 1),
s as (select o.*, case when m > 0 then m else 6D end as h from o_cur o left join m using(iceberg_id))
select event_id, cast(k as int) as k, round(h*k,3)+0.0D as hours_ahead, round(lat_o + (y+vv*3.6D*h*k)/(pi()*6371.0088D/180D),6)+0.0D as pred_lat,
 round((((lon_o + (x+u*3.6D*h*k)/((pi()*6371.0088D/180D)*cos(radians(lat_o)))+180D) % 360D)+360D) % 360D - 180D,6)+0.0D as pred_lon from s, (select unnest([1,2,3]) as k)""")
def m03(v):
    d, width = _env_tracks(v)
    d = od.null_join(d, tr.median_step_hours(v.tracks, chunk=width), ["iceberg_id"], "left")
    return fc.current_drift(d, 3, chunk=width).select("event_id", "k", rnd("hours_ahead", 3).alias("hours_ahead"), rnd("pred_lat", 6).alias("pred_lat"),
                                                      rnd("pred_lon", 6).alias("pred_lon"))


shared_cte("o_tail", """
select p.*, (x-px)/((epoch_us(obs_time)-epoch_us(t0))/3.6e9D) as vx, (y-py)/((epoch_us(obs_time)-epoch_us(t0))/3.6e9D) as vy, 6D/d.m as q, d.m from (
 select *, lag(x) over w as px, lag(y) over w as py from o_plane window w as (partition by iceberg_id order by obs_time, event_id)) p
join (select iceberg_id, median(floor(epoch_us(obs_time)/3.6e9D)-floor(epoch_us(t0)/3.6e9D))::double as m from o_lag where t0 is not null group by 1) d using(iceberg_id) where rn = n""")


@case("m04_recursive_forecast", """
select iceberg_id, cast(k as int) as step, obs_time + to_microseconds(cast(k*m*3.6e9D as bigint)) as forecast_time, round(k*m,3)+0.0D as hours_ahead, round(x+vx*6D*g,4)+0.0D as x_km,
 round(lat_o + (y+vy*6D*g)/(pi()*6371.0088D/180D),6)+0.0D as latitude
from (select *, case k when 1 then 1D when 2 then 1+q when 3 then 1+q+q*q else 1+q+q*q+q*q*q end as g from o_tail, (select unnest([1,2,3,4]) as k))""")
def m04(v):
    def advance(windows):
        # constant-velocity predictor: last position plus the last velocity over six hours
        return windows[:, -1, :2] + windows[:, -1, 2:4] * 6.0
    d, width = _env_tracks(v)
    out = fc.recursive_forecast(d, advance, 4, chunk=width)
    return out.select("iceberg_id", "step", "forecast_time", rnd("hours_ahead", 3).alias("hours_ahead"), rnd("x_km", 4).alias("x_km"),
                      rnd("latitude", 6).alias("latitude"))


@case("x02_window_predictor", """
with v as (select p.*, coalesce((x-px)/h,0D) as vx, coalesce((y-py)/h,0D) as vy from (
 select *, lag(x) over w as px, lag(y) over w as py, (epoch_us(obs_time)-epoch_us(t0))/3.6e9D as h from o_plane window w as (partition by iceberg_id order by obs_time, event_id)) p),
s as (select iceberg_id, m, max_by(x,rn) as x, max_by(y,rn) as y, sum(vx) filter (rn>n-5) as sx, sum(vy) filter (rn>n-5) as sy, count(*) filter (rn>n-5) as c,
 coalesce(sum(vx) filter (rn>n-4),0D) as zx, coalesce(sum(vy) filter (rn>n-4),0D) as zy, count(*) filter (rn>n-4) as b from v join (select iceberg_id, m from o_tail) using(iceberg_id) group by 1,2),
a as (select *, x+6D*sx/c as x1, y+6D*sy/c as y1 from s),
z as (select *, x1+6D*(zx+(x1-x)/m)/(b+1) as x2, y1+6D*(zy+(y1-y)/m)/(b+1) as y2 from a)
select iceberg_id, cast(k as int) as step, round(k*m,3)+0.0D as hours_ahead, round(if(k=1,x1,x2),4)+0.0D as x_km, round(if(k=1,y1,y2),4)+0.0D as y_km from z, (select unnest([1,2]) as k)""")
def x02(v):
    def mean_drift(windows):
        # last position plus the mean velocity of the whole window over six hours
        return windows[:, -1, :2] + windows[:, :, 2:4].mean(axis=1) * 6.0
    d, width = _env_tracks(v)
    out = fc.recursive_forecast(d, mean_drift, 2, chunk=width)
    return out.select("iceberg_id", "step", rnd("hours_ahead", 3).alias("hours_ahead"), rnd("x_km", 4).alias("x_km"), rnd("y_km", 4).alias("y_km"))


@case("m05_track_forest")
def m05(v):
    d = tr.span_split(tr.drift_features(v.tracks))
    d = d.withColumn("month", F.col("month").cast("double"))
    model = ml.fit_track_forest(d.filter("split = 'train'"), trees=10, depth=5)
    return ml.score_track_forest(ml.predict_track_forest(model, d.filter("split = 'test'")))


@case("m06_cell_forest")
def m06(v):
    d = g.date_split(g.cell_windows(v.grid, ["sic", "uo", "vo"], steps=3))
    model = ml.fit_cell_forest(d.filter("split = 'train'"), trees=10, depth=5)
    return ml.score_cell_forest(ml.predict_cell_forest(model, d.filter("split <> 'train'")))


@case("m08_multi_horizon", """
select event_id, cast(h as int) as horizon_hours, forecast_time + to_hours(h) as valid_time from v_forecasts, (select unnest([6,12,24,48,72]) as h)""")
def m08(v):
    from floetrack.config import SEA_ICE_HORIZONS
    d = v.forecasts.drop("horizon_hours")
    return fc.multi_horizon(d, SEA_ICE_HORIZONS, "forecast_time").select("event_id", "horizon_hours", "valid_time")


@case("m10_trajectory", """
with h as (select iceberg_id, obs_time as time, latitude, n, row_number() over (partition by iceberg_id, obs_time order by rn desc) as k from o_lag where n <= 6 or (rn-1) % 6 = 0 or rn = n),
o as (select iceberg_id, time, round(latitude,6) as latitude, 'observation' as step from h where n <= 6 or k = 1),
p as (select iceberg_id, null::timestamp as time, round(latitude,6) as latitude, 'prediction' as step from o_latest)
select u.*, c.a as count_observations, 1 as count_predictions from (select * from o union all select * from p) u join (select iceberg_id, count(*) as a from o group by 1) c using(iceberg_id)""")
def m10(v):
    ents = latest(v)
    preds = fc.persist_position(ents, [24])
    out = fc.trajectory(v.tracks, preds, ents)
    return out.select("iceberg_id", "time", rnd("latitude", 6).alias("latitude"), "step", "count_observations",
                      F.col("count_predictions").cast("int").alias("count_predictions"))


shared_cte("o_err", f"""
select *, {hav('lat0', 'lon0', 'latitude', 'longitude')} as km, (epoch_us(obs_time)-epoch_us(t0))/3.6e9D as hours from o_lag where t0 is not null""")


def _errors(v):
    d = tr.with_lags(v.tracks, ["latitude", "longitude", "obs_time"])
    d = d.filter("prev_obs_time is not null")
    return (d.withColumn("km", geo.haversine("prev_latitude", "prev_longitude", "latitude", "longitude"))
            .withColumn("hours", geo.hours_between("obs_time", "prev_obs_time"))
            .withColumn("pred_lat", F.col("prev_latitude")).withColumn("pred_lon", F.col("prev_longitude"))
            .withColumn("act_lat", F.col("latitude")).withColumn("act_lon", F.col("longitude")))


for _scheme, _expr in (("day", "case when hours<=36 then '24h' when hours<=60 then '48h' when hours<=84 then '72h' end"),
                       ("range", "case when hours<30 then '0-30h' when hours<96 then '30-96h' when hours<192 then '96-192h' when hours<360 then '192-360h' else '>360h' end")):
    def _make(scheme):
        def fn(v):
            out = m.horizon_metrics(_errors(v), scheme)
            return out.select("bucket", "n", rnd("mean_km", 6).alias("mean_km"), rnd("median_km", 6).alias("median_km"))
        return fn
    case(f"a16_horizon_{_scheme}", f"""
select bucket, count(*) as n, round(avg(km),6)+0.0D as mean_km, round(median(km),6)+0.0D as median_km from (select *, {_expr} as bucket from o_err) where bucket is not null group by 1""")(_make(_scheme))


@case("a16_horizon_cumulative", """
select b as bucket, count(*) as n, round(avg(km),6)+0.0D as mean_km, round(median(km),6)+0.0D as median_km from o_err, (select unnest(['24h','72h','7d']) as b, unnest([24,72,168]) as lim) where hours <= lim group by 1""")
def a16c(v):
    out = m.horizon_metrics(_errors(v), "cumulative")
    return out.select("bucket", "n", rnd("mean_km", 6).alias("mean_km"), rnd("median_km", 6).alias("median_km"))


@case("a17_within_shares", """
select round(avg((km<=1)::int),6) as within_1km, round(avg((km<=5)::int),6) as within_5km, round(avg((km<=10)::int),6) as within_10km, round(avg((km<=25)::int),6) as within_25km, round(avg((km<=50)::int),6) as within_50km from o_err""")
def a17(v):
    d = m.within_shares(_errors(v))
    return d.select(*[rnd(c, 6).alias(c) for c in d.columns])


@case("a18_trajectory_scores", f"""
select remarks as model, count(*) as n, round(sqrt(avg(pow(lat0-latitude,2))),6)+0.0D as lat_rmse_deg, round(avg(km),6)+0.0D as mean_km, round(median(km),6)+0.0D as median_km, round(avg(km)/1.852D,6)+0.0D as mean_nm from o_err group by 1""")
def a18(v):
    out = m.trajectory_scores(_errors(v).withColumn("model", F.col("remarks")))
    return out.select("model", "n", *[rnd(c, 6).alias(c) for c in ("lat_rmse_deg", "mean_km", "median_km", "mean_nm")])


@case("a33_position_metrics", """
select count(*) as samples, round(avg(abs(lat0-latitude)),6)+0.0D as lat_mae_deg, round(avg(km),6)+0.0D as mean_km, round(median(km),6)+0.0D as median_km, round(max(km),6)+0.0D as max_km, round(sqrt(avg(km*km)),6)+0.0D as rmse_km from o_err""")
def a33(v):
    out = m.position_metrics(_errors(v))
    return out.select("samples", *[rnd(c, 6).alias(c) for c in ("lat_mae_deg", "mean_km", "median_km", "max_km", "rmse_km")])


@case("a32_per_track_errors", f"""
select iceberg_id, max(n) as n_obs, count(km) as pairs, round(avg(km),6)+0.0D as mean_km, round(median(km),6)+0.0D as median_km, case when max(n)<2 then 'needs_more_data' else 'ok' end as status from (
 select iceberg_id, n, case when rn-1 >= greatest(1,floor(n*0.70D))+floor(n*0.15D) then {hav('lat0', 'lon0', 'latitude', 'longitude')} end as km from o_lag) group by 1""")
def a32(v):
    out = m.per_track_errors(v.tracks)
    return out.select("iceberg_id", "n_obs", "pairs", rnd("mean_km", 6).alias("mean_km"), rnd("median_km", 6).alias("median_km"), "status")


@case("a30_two_hour_eval", f"""
select count(*) as records, count(distinct iceberg_id) as tracks, count(*) filter (where hit) as pairs, round(median(h),6)+0.0D as median_gap_hours,
 round(avg(km) filter (where hit),4)+0.0D as mean_error_km, round(avg(round(least(100D,greatest(0D,(40D-km)/20D*100D)),4)) filter (where hit),4)+0.0D as accuracy_percent, 'VERIFIED' as status
from (select *, (epoch_us(obs_time)-epoch_us(t0))/3.6e9D as h, coalesce(abs((epoch_us(obs_time)-epoch_us(t0))/3.6e9D-2D)<=0.25D,false) as hit, {hav('lat0', 'lon0', 'latitude', 'longitude')} as km from o_lag)""")
def a30(v):
    return m.two_hour_eval(v.tracks).select("records", "tracks", "pairs", "median_gap_hours", "mean_error_km", "accuracy_percent", "status")


@case("x01_pluggable_predictor", f"""
select count(*) filter (where hit) as pairs, round(avg({hav('(lat0+0.01D*h)', 'lon0', 'latitude', 'longitude')}) filter (where hit),4)+0.0D as mean_error_km
from (select *, (epoch_us(obs_time)-epoch_us(t0))/3.6e9D as h, coalesce(abs((epoch_us(obs_time)-epoch_us(t0))/3.6e9D-2D)<=0.25D,false) as hit from o_lag)""")
def x01(v):
    return m.two_hour_eval(v.tracks, lambda la, lo, gap: (la + 0.01 * gap, lo)).select("pairs", "mean_error_km")


shared_cte("o_comp", """
select user_id as grp, component, value from (select user_id, case event_type when 'click' then 'sea_ice' when 'view' then 'iceberg' when 'purchase' then 'route' when 'signup' then 'recalc' else 'land_mask' end as component,
 avg(value)*1.5D as value from events group by 1,2)""")


def _components(v):
    e = F.col("event_type")
    d = v.table("events").select(F.col("user_id").alias("grp"), F.when(e == "click", "sea_ice").when(e == "view", "iceberg").when(e == "purchase", "route")
                                 .when(e == "signup", "recalc").otherwise("land_mask").alias("component"), "value")
    return d.groupBy("grp", "component").agg((F.avg("value") * 1.5).alias("value"))


@case("a28_weighted_score", """
select g.grp, round(sum(case when c.value between 0 and 100 then c.value*w end)/sum(case when c.value between 0 and 100 then w end),6)+0.0D as score,
 count(*) filter (where not coalesce(c.value between 0 and 100,false)) > 0 and count(*) filter (where c.value between 0 and 100) > 0 as provisional,
 round(coalesce(sum(case when c.value between 0 and 100 then w end),0)*100D,6)+0.0D as coverage_percent
from (select distinct grp from o_comp) g cross join (select unnest(['sea_ice','iceberg','route','recalc','land_mask']) as k, unnest([0.35D,0.30D,0.20D,0.10D,0.05D]) as w)
left join o_comp c on c.grp=g.grp and c.component=k group by 1""")
def a28(v):
    out = m.weighted_score(_components(v), by=["grp"])
    return out.select("grp", rnd("score", 6).alias("score"), "provisional", rnd("coverage_percent", 6).alias("coverage_percent"))


@case("a29_accuracy_summary", """
select grp, round(s,6)+0.0D as score, case when s is null then 'Not Available' when prov then 'PROVISIONAL' when s>=85 then 'A (Production-Ready)' when s>=70 then 'B (Research-Grade)' when s>=50 then 'C (Functional)' else 'D (Experimental)' end as grade from (
 select grp, prov, num/nullif(den,0) as s from (select grp, (r2 between 0 and 1 and km between 0 and 100 and ok) is not true as prov,
  coalesce(case when r2 between 0 and 1 then r2*100D*0.35D end,0)+coalesce(case when km between 0 and 100 then (100D-km)*0.30D end,0)+case when ok then 100D*0.20D else 0 end+50D*0.10D+75D*0.05D as num,
  case when r2 between 0 and 1 then 0.35D else 0 end + case when km between 0 and 100 then 0.30D else 0 end + case when ok then 0.20D else 0 end + 0.15D as den
 from (select user_id as grp, avg(value)/100D as r2, min(value)*5D as km, count(*) % 2 = 0 as ok from events group by 1)))""")
def a29(v):
    rep = v.table("events").groupBy(F.col("user_id").alias("grp")).agg(
        (F.avg("value") / 100.0).alias("sea_ice_r2"), (F.min("value") * 5.0).alias("iceberg_mean_km"),
        F.when(F.count(F.lit(1)) % 2 == 0, "VERIFIED").alias("route_status"))
    rep = (rep.withColumn("recalc_status", F.lit("VERIFIED")).withColumn("recalc_percent", F.lit(50.0))
           .withColumn("land_status", F.lit("VERIFIED")).withColumn("land_percent", F.lit(75.0)))
    return m.accuracy_summary(rep, ["grp"]).select("grp", rnd("score", 6).alias("score"), "grade")
