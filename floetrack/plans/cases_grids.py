"""Grid queries."""
from pyspark.sql import functions as F

from floetrack.config import POLAR_GRIDS
from floetrack.functions import geo
from floetrack.functions.values import rnd
from floetrack.operators import grids as g
from floetrack.operators import metrics as m
from floetrack.operators.stats import attach
from floetrack.plans.cases_tracks import hav
from floetrack.plans.registry import case, shared_cte

K = ["obs_time", "latitude", "longitude"]


@case("s21_make_grid", """
select cast(i as int) as i, cast(j as int) as j, -74.5D+i*0.5D as latitude, -180D+j*2.5D*0.2D as longitude, n
from (select l_suppkey % 40 as i, l_orderkey % 721 as j, count(*) as n from lineitem group by 1, 2) t""")
def s21(v):
    """Line items counted on the nodes of a made grid."""
    n = v.table("lineitem").groupBy((F.col("l_suppkey") % 40).cast("int").alias("i"), (F.col("l_orderkey") % 721).cast("int").alias("j")).agg(F.count("*").alias("n"))
    return g.make_grid(v.spark, -74.5, -55.0, -180.0, 180.0, 0.5).join(n, ["i", "j"]).select("i", "j", "latitude", "longitude", "n")


@case("p14_autoscale", """
select obs_time, latitude, longitude, case when max(sic*120) over (partition by obs_time) > 1 then round(sic*120/100,9)+0.0D else round(sic*120,9)+0.0D end as sic from v_grid""")
def p14(v):
    d = v.grid.withColumn("sic", F.col("sic") * 120)
    return g.autoscale_fraction(d, "sic", "obs_time").select(*K, rnd("sic", 9).alias("sic"))


@case("p15_clip_range", """
select obs_time, latitude, longitude, round(least(greatest(x,0D),1D),9)+0.0D as x, coalesce(x<0 or x>1,false) as x_clipped
from (select *, sic*2-0.3D as x from v_grid where sic is not null) union all
select obs_time, latitude, longitude, null, false from v_grid where sic is null""")
def p15(v):
    return g.clip_range(v.grid.withColumn("x", F.col("sic") * 2 - 0.3), "x").select(*K, rnd("x", 9).alias("x"), "x_clipped")


@case("p16_flag_nodata", """
select obs_time, latitude, longitude, sic, case when sic is null then 'nodata' else 'good' end as quality_flag, cast(sic is null as int) as nodata_flag from v_grid""")
def p16(v):
    return g.flag_nodata(v.grid, "sic").select(*K, "sic", "quality_flag", "nodata_flag")


@case("p17_depth", "select latitude, longitude, case when z<0 then -z end as depth from v_cells")
def p17(v):
    return v.cells.select("latitude", "longitude", g.depth_from_elevation("z").alias("depth"))


@case("s08_bathymetry", """
select latitude, longitude, round(z2,2)+0.0D as elevation_meters, round(case when z2<0 then -z2 end,2)+0.0D as depth_meters, cast(z2 is null as int) as nodata_flag
from (select *, case when longitude = -180D then null else z end as z2 from v_cells) where latitude between -90 and -60""")
def s08(v):
    d = v.cells.withColumn("z", F.when(F.col("longitude") == -180.0, F.lit(-99999.0)).otherwise(F.col("z")))
    return g.bathymetry_table(d, lat_max=-60.0)


@case("p18_wind_from_uv", """
select obs_time, latitude, longitude, round(sqrt(u10*u10+v10*v10),6)+0.0D as speed, round((degrees(atan2(-u10,-v10))+360D) % 360D,4)+0.0D as direction from v_grid""")
def p18(v):
    d = v.grid.withColumn("w", geo.wind_from_uv("u10", "v10"))
    return d.select(*K, rnd("w.speed", 6).alias("speed"), rnd("w.direction", 4).alias("direction"))


@case("p22_thin_grid", """
select obs_time, latitude, longitude from (select *, dense_rank() over (order by latitude)-1 as i, dense_rank() over (order by longitude)-1 as j from v_grid) where i % 3 = 0 and j % 3 = 0""")
def p22(v):
    return g.thin_grid(v.grid, 3).select(*K)


@case("p22_thin_to", """
with s as (select * from v_grid where obs_time = (select max(obs_time) from v_grid)),
r as (select *, dense_rank() over (order by latitude)-1 as i, dense_rank() over (order by longitude)-1 as j from s),
vis as (select r.* from r where sic > 0 and not exists (select 1 from v_cells c where c.is_land and c.latitude=r.latitude and c.longitude=r.longitude)),
st as (select case when count(*) <= 50 then 1 else cast(ceil(sqrt(count(*)/50D)) as int) end as k from vis)
select latitude, longitude, sic from vis, st where i % k = 0 and j % k = 0""")
def p22b(v):
    snap = g.latest_snapshot(v.grid)
    return g.thin_to(snap, "sic", 50, v.cells).select("latitude", "longitude", "sic")


@case("p24_select_depth", """
select latitude, longitude, depth from (select latitude, longitude, (case when obs_time < timestamp '2024-01-16' then 0.5D else 10D end) as depth from v_grid) where depth = 10D""")
def p24(v):
    d = v.grid.withColumn("depth", F.when(F.col("obs_time") < F.lit("2024-01-16").cast("timestamp_ntz"), 0.5).otherwise(10.0))
    return g.select_depth(d, 7).select("latitude", "longitude", "depth")


@case("p34_mark_land", """
with pts as (select distinct cast(least((select mi from o_b),greatest(0,ceil((latitude+74.5D)-0.5D))) as int) as i, cast(least(35,greatest(0,ceil((longitude+180D)/10D-0.5D))) as int) as j from v_places)
select latitude, longitude, (is_land or (latitude between -60D and -58D and longitude between 0D and 50D)
  or exists (select 1 from pts where pts.i = latitude+74.5D and pts.j = (longitude+180D)/10D)) as is_land from v_cells""")
def p34(v):
    return g.mark_land(v.cells, points=v.places, box=(-60.0, -58.0, 0.0, 50.0)).select("latitude", "longitude", "is_land")


shared_cte("o_last", "select * from v_grid where obs_time = (select max(obs_time) from v_grid)")
shared_cte("o_nav", """
select i*721+j as cell_id, -74.5D+i*0.5D as latitude, -180D+j*0.5D as longitude from (select distinct (l_suppkey % 20)*2 as i from lineitem) a,
 (select distinct (l_orderkey % 36)*20+(l_partkey % 5)*3 as j from lineitem) b""")


def nav(v):
    """Navigation cells derived from the line items (finer than the field grid, off its nodes)."""
    li = v.table("lineitem")
    i = li.select(((F.col("l_suppkey") % 20) * 2).alias("i")).distinct()
    j = li.agg(F.collect_set((F.col("l_orderkey") % 36) * 20 + (F.col("l_partkey") % 5) * 3).alias("js"))    # one axis
    c = attach(i, j).select("i", F.explode("js").alias("j"))
    return c.select((F.col("i") * 721 + F.col("j")).alias("cell_id"), (F.lit(-74.5) + F.col("i") * 0.5).alias("latitude"),
                    (F.lit(-180.0) + F.col("j") * 0.5).alias("longitude"))


@case("j03_regrid_nearest", """
with ax as (select distinct latitude as a from o_last), ox as (select distinct longitude as o from o_last),
la as (select latitude, arg_min(a,(abs(a-latitude),a)) as a from (select distinct latitude from o_nav), ax group by 1),
lo as (select longitude, arg_min(o,(abs(o-longitude),o)) as o from (select distinct longitude from o_nav), ox group by 1)
select cell_id, n.latitude, n.longitude, s.sic from o_nav n join la using(latitude) join lo using(longitude) left join o_last s on s.latitude=a and s.longitude=o""")
def j03(v):
    return g.regrid_nearest(g.latest_snapshot(v.grid), nav(v), ["sic"]).select("cell_id", "latitude", "longitude", "sic")


@case("j04_nearest_point", """
select n.cell_id, arg_min(p.place_id,(round(sqrt(pow(p.latitude-n.latitude,2)+pow(p.longitude-n.longitude,2)),6),p.place_id)) as place_id,
  round(min(sqrt(pow(p.latitude-n.latitude,2)+pow(p.longitude-n.longitude,2))),5)+0.0D as dist_deg from o_nav n, v_places p group by 1""")
def j04(v):
    return g.nearest_point(nav(v), v.places, "place_id", ["name"]).select("cell_id", "place_id", rnd("dist_deg", 5).alias("dist_deg"))


_PG = POLAR_GRIDS["3125m"]
_E = (1 - _PG["b"] ** 2 / _PG["a"] ** 2) ** 0.5


@case("j05_polar_regrid", f"""
with src as (select l_orderkey % 2656 as iy, l_partkey % 2528 as ix, avg(l_quantity) as value from lineitem group by 1,2),
k as (select {_E!r}D as e, radians(70D) as pc), kk as (select e, pi()/4 as q, {_PG['a']}D*(cos(pc)/sqrt(1-pow(e*sin(pc),2)))/(tan(pi()/4-pc/2)/pow((1-e*sin(pc))/(1+e*sin(pc)),e/2)) as f from k),
t as (select event_id, f*tan(q-radians(-latitude)/2)/pow((1-e*sin(radians(-latitude)))/(1+e*sin(radians(-latitude))),e/2) as rho, radians(longitude) as lam from v_tracks, kk),
i as (select event_id, round_even((rho*sin(lam)+3950000D)/3125D,0) as ix, round_even((rho*cos(lam)-4350000D)/-3125D,0) as iy from t)
select event_id, case when ix between 0 and 2527 and iy between 0 and 2655 then cast(ix as bigint) end as ix, case when ix between 0 and 2527 and iy between 0 and 2655 then cast(iy as bigint) end as iy, round(value,6) as value
from i left join src using(ix,iy)""")
def j05(v):
    gd = POLAR_GRIDS["3125m"]
    src = v.table("lineitem").select((F.col("l_orderkey") % gd["ny"]).cast("long").alias("iy"), (F.col("l_partkey") % gd["nx"]).cast("long").alias("ix"),
                                     F.col("l_quantity").alias("value")).groupBy("iy", "ix").agg(F.avg("value").alias("value"))
    out = g.polar_regrid(v.tracks.select("event_id", "latitude", "longitude"), src, gd)
    return out.select("event_id", "ix", "iy", rnd("value", 6).alias("value"))


@case("w07_cell_diff", """
select obs_time, latitude, longitude, case when p = obs_time - interval 1 day then round(sic - ps,9)+0.0D end as sic_change from (
 select *, lag(obs_time) over w as p, lag(sic) over w as ps from v_grid window w as (partition by latitude, longitude order by obs_time))""")
def w07(v):
    return g.cell_diff(v.grid, "sic").select(*K, rnd("sic_change", 9).alias("sic_change"))


@case("w08_fill_gaps", """
with o as (select *, epoch_us(obs_time)/86400e6D as t from v_grid), ob as (select * from o where sic is not null),
b as (select o.*, (select max(t) from ob where ob.latitude=o.latitude and ob.longitude=o.longitude and ob.t<o.t) as t0,
 (select min(t) from ob where ob.latitude=o.latitude and ob.longitude=o.longitude and ob.t>o.t) as t1 from o)
select b.obs_time, b.latitude, b.longitude, round(coalesce(b.sic, case when t1-t0-1<=2 then p.sic+(n.sic-p.sic)*(b.t-t0)/(t1-t0) end),9)+0.0D as sic,
 (b.sic is null and coalesce(t1-t0-1<=2,false)) as sic_filled
from b left join ob p on p.latitude=b.latitude and p.longitude=b.longitude and p.t=t0 left join ob n on n.latitude=b.latitude and n.longitude=b.longitude and n.t=t1""")
def w08(v):
    return g.fill_gaps(v.grid, "sic", 2).select(*K, rnd("sic", 9).alias("sic"), "sic_filled")


def fill_sql(x):
    return f"""select b.obs_time, b.latitude, b.longitude, round(coalesce(b.{x}, case when t1-t0-1<=2 then p.{x}+(n.{x}-p.{x})*(b.t-t0)/(t1-t0) end),9)+0.0D as {x},
 (b.{x} is null and coalesce(t1-t0-1<=2,false)) as {x}_filled
from (select o.*, (select max(t) from o ob where ob.{x} is not null and ob.latitude=o.latitude and ob.longitude=o.longitude and ob.t<o.t) as t0,
 (select min(t) from o ob where ob.{x} is not null and ob.latitude=o.latitude and ob.longitude=o.longitude and ob.t>o.t) as t1 from o) b
left join o p on p.latitude=b.latitude and p.longitude=b.longitude and p.t=t0 left join o n on n.latitude=b.latitude and n.longitude=b.longitude and n.t=t1"""


@case("w08_fill_gaps_multi", f"""
with o as (select obs_time, latitude, longitude, sic, case when day(obs_time) % 5 <> 2 then u10 end as gust, epoch_us(obs_time)/86400e6D as t from v_grid)
select * from ({fill_sql("sic")}) s join ({fill_sql("gust")}) g using (obs_time, latitude, longitude)""")
def w08m(v):
    d = v.grid.withColumn("gust", F.when(F.dayofmonth("obs_time") % 5 != 2, F.col("u10")))
    return g.fill_gaps_multi(d, ["sic", "gust"], 2).select(*K, rnd("sic", 9).alias("sic"), "sic_filled", rnd("gust", 9).alias("gust"), "gust_filled")


@case("w09_field_linear", """
select c.latitude, c.longitude, round(a.uo*(1-0.25D)+b.uo*0.25D,9)+0.0D as uo, 'linear_in_time' as method, 0.25D as interpolation_weight,
  timestamp '2024-01-10' as bracket_start, timestamp '2024-01-11' as bracket_end
from (select distinct latitude, longitude from v_grid where obs_time in (timestamp '2024-01-10', timestamp '2024-01-11')) c
left join v_grid a on a.latitude=c.latitude and a.longitude=c.longitude and a.obs_time = timestamp '2024-01-10'
left join v_grid b on b.latitude=c.latitude and b.longitude=c.longitude and b.obs_time = timestamp '2024-01-11'""")
def w09(v):
    return g.field_at(v.grid, "uo", "2024-01-10 06:00:00", "linear").withColumn("uo", rnd("uo", 9))


@case("w09_field_exact", """
select latitude, longitude, vo, 'exact_match' as method, obs_time as bracket_start, obs_time as bracket_end from v_grid where obs_time = timestamp '2024-01-12'""")
def w09d(v):
    return g.field_at(v.grid, "vo", "2024-01-12", "linear").drop("interpolation_weight")


@case("w09_field_nearest", """
select latitude, longitude, uo, 'nearest_in_time' as method, timestamp '2024-01-10' as bracket_start, timestamp '2024-01-11' as bracket_end
from v_grid where obs_time = timestamp '2024-01-11'""")
def w09b(v):
    return g.field_at(v.grid, "uo", "2024-01-10 18:00:00").drop("interpolation_weight")


@case("w09_field_edge", """
select latitude, longitude, uo, 'nearest_in_time (edge-of-domain)' as method from v_grid where obs_time = timestamp '2024-01-30'""")
def w09c(v):
    return g.field_at(v.grid, "uo", "2024-02-10", "linear").select("latitude", "longitude", "uo", "method")


@case("w13_date_split", """
select split, count(*) as n, min(i) as first_index from (select r - 1 as i, case when r-1 < 21 then 'train' when r-1 < 24 then 'val' else 'test' end as split
 from (select dense_rank() over (order by cast(obs_time as date)) as r from v_grid)) group by 1""")
def w13(v):
    d = g.date_split(v.grid)
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("date_index").cast("long").alias("first_index"))


shared_cte("o_pairs", """
select b.obs_time, b.latitude, b.longitude, a.sic as pred, b.sic as actual, a.obs_time as pred_time from v_grid a join v_grid b
 on a.latitude=b.latitude and a.longitude=b.longitude and b.obs_time = a.obs_time + interval 1 day where a.sic is not null and b.sic is not null""")


@case("j18_consecutive_pairs", "select * from o_pairs")
def j18(v):
    return g.consecutive_pairs(v.grid, "sic").select(*K, "pred", "actual", "pred_time")


@case("w19_cell_windows", """
select latitude, longitude, obs_time, n as n_features, target, valid from (select *, count(*) over f as c, min(obs_time) over f as t0,
  count(sic) over f + count(uo) over f as present, lead(sic) over w as nx, lead(obs_time) over w as nt,
  case when nt = obs_time + interval 1 day then nx end as target, cn*2 as n,
  (cn = 7 and present = 14 and target is not null) as valid
 from (select *, (select count(*) from v_grid q where q.latitude=g.latitude and q.longitude=g.longitude and q.obs_time > g.obs_time - interval 7 day and q.obs_time <= g.obs_time) as cn from v_grid g)
 window w as (partition by latitude, longitude order by obs_time), f as (partition by latitude, longitude order by obs_time rows between 6 preceding and current row))""")
def w19(v):
    out = g.cell_windows(v.grid, ["sic", "uo"])
    return out.select(*K, F.size("features").cast("long").alias("n_features"), "target", "valid")


@case("a02_latest_snapshot", "select latitude, longitude, sic from o_last where sic is not null")
def a02(v):
    return g.latest_snapshot(v.grid, value="sic").select("latitude", "longitude", "sic")


@case("a22_land_from_history", """
select latitude, longitude, not bool_or(sic is not null and obs_time > timestamp '2024-01-28') as is_land from v_grid group by 1,2""")
def a22(v):
    d = v.grid.withColumn("s", F.when(F.col("obs_time") > F.lit("2024-01-28").cast("timestamp_ntz"), F.col("sic")))
    return g.land_from_history(d, "s")


@case("a23_land_mask", "select latitude, longitude, z >= 0 as is_land from v_cells")
def a23(v):
    return g.land_mask(v.cells, elevation="z")


@case("a23_raster_counts", """
select count(*) filter (where not l) as ocean_cells, count(*) filter (where l) as land_cells, count(*) as total_cells from (
 select cast(round((-50D-latitude)/2.1D) as int) as r, cast(round((longitude-20D)/25D) as int) as c, not bool_or(not is_land) as l from v_cells group by 1,2)""")
def a23b(v):
    d = v.cells.withColumn("longitude", F.lit(20.0) + (F.col("longitude") - 20.0) * 2.1 / 25.0)
    return g.mask_counts(g.raster_mask(d, 2.1))


@case("a24_field_summary", """
select obs_time, round(avg(sic),6)+0.0D as mean, round(max(sic),6)+0.0D as max, round(count(sic)*100D/count(*),2)+0.0D as coverage_pct from v_grid group by 1""")
def a24(v):
    return g.field_summary(v.grid, "sic", ["obs_time"])


@case("a38_daily_mean", """
select date_trunc('day', obs_time) as obs_time, round(latitude) as latitude, round(longitude,-1) as longitude, round(avg(length_nm),9) as length_nm from v_tracks group by 1,2,3""")
def a38(v):
    d = v.tracks.withColumn("latitude", F.round("latitude")).withColumn("longitude", F.round("longitude", -1))
    return g.daily_mean(d, ["length_nm"]).withColumn("length_nm", rnd("length_nm", 9))


@case("a38_daily_mean_same", "select obs_time, latitude, longitude, round(avg(uo),6)+0.0D as uo from v_grid group by 1,2,3")
def a38b(v):
    return g.daily_mean(v.grid, ["uo"]).withColumn("uo", rnd("uo", 6))


@case("a43_to_matrix", """
select la.latitude, list(s.sic order by lo.longitude) as "values" from (select distinct latitude from o_last) la cross join (select distinct longitude from o_last) lo
left join o_last s on s.latitude=la.latitude and s.longitude=lo.longitude group by 1""")
def a43(v):
    return g.to_matrix(g.latest_snapshot(v.grid), "sic")


REG = """n, round(mae,6)+0.0D as mae, round(mse,6)+0.0D as mse, round(sqrt(mse),6)+0.0D as rmse, round(1-mse*n/(va*n),6)+0.0D as r2, round((va-ve)/va,6)+0.0D as explained_variance,
 round(bias,6)+0.0D as mean_bias, round(co,6)+0.0D as correlation, round(ma,6)+0.0D as mean_actual, round(mp,6)+0.0D as mean_pred"""
AGG = """count(*) as n, avg(abs(actual-pred)) as mae, avg(pow(actual-pred,2)) as mse, var_pop(actual) as va, var_pop(actual-pred) as ve, avg(actual-pred) as bias,
 corr(pred,actual) as co, avg(actual) as ma, avg(pred) as mp"""
MET = ("mae", "mse", "rmse", "r2", "explained_variance", "mean_bias", "correlation", "mean_actual", "mean_pred")


def met(df, *keys):
    return df.select(*keys, "n", *[rnd(c, 6).alias(c) for c in MET])


@case("a13_regression_metrics", f"select {REG} from (select {AGG} from o_pairs)")
def a13(v):
    return met(m.regression_metrics(g.consecutive_pairs(v.grid, "sic")))


@case("a13_by_split", f"""
select split, {REG} from (select split, {AGG} from (select p.*, case when a < 21 then 'train' when a < 24 then 'val' else 'test' end as split from
 (select *, epoch_us(pred_time)/86400e6D - 19723 as a, epoch_us(obs_time)/86400e6D - 19723 as b from o_pairs) p
 where not (a < 21 and b >= 21) and not (a < 24 and b >= 24)) group by 1)""")
def a13b(v):
    d = g.date_split(v.grid).select(*K, "sic", "split")
    p = g.consecutive_pairs(d, "sic", keys=("latitude", "longitude", "split"))
    return met(m.regression_metrics(p, by=["split"]), "split")


@case("a14_by_band", f"""
select floor((latitude+75)/5)*5-75D as band, {REG} from (select latitude, n, mae, mse, va, ve, bias, co, ma, mp from (select floor((latitude+75)/5)*5-75 as latitude, {AGG} from o_pairs where latitude >= -75 and latitude < -55 group by 1))""")
def a14(v):
    return met(m.metrics_by_band(g.consecutive_pairs(v.grid, "sic")), "band")


@case("a15_by_bin", f"""
select band, {REG} from (select case when actual<0.2D then 0D when actual<0.4D then 0.2D when actual<0.6D then 0.4D when actual<0.8D then 0.6D else 0.8D end as band, {AGG} from o_pairs where actual < 1.0D group by 1)""")
def a15(v):
    return met(m.metrics_by_bin(g.consecutive_pairs(v.grid, "sic")), "band")


@case("a19_masked_error", """
select count(*) as n, round(avg(abs(pred-actual)),6)+0.0D as mae, round(sqrt(avg(pow(pred-actual,2))),6)+0.0D as rmse from o_pairs where latitude < -60""")
def a19(v):
    return m.masked_error(g.consecutive_pairs(v.grid, "sic").withColumn("mask", F.col("latitude") < -60)).select(
        "n", rnd("mae", 6).alias("mae"), rnd("rmse", 6).alias("rmse"))


@case("a20_spatial_correlation", """
select round(avg(c),6)+0.0D as spatial_correlation, count(c) as n_samples from (select corr(pred,actual) as c from o_pairs group by obs_time)""")
def a20(v):
    return m.spatial_correlation(g.consecutive_pairs(v.grid, "sic"), "obs_time").withColumn("spatial_correlation", rnd("spatial_correlation", 6))


@case("a21_fit_scaler", """
select c as channel, round(mean,6)+0.0D as mean, round(std,6)+0.0D as std from (select unnest(['sic','u10']) as c, unnest([avg(sic),avg(u10)]) as mean, unnest([stddev_pop(sic),stddev_pop(u10)]) as std
 from v_grid where obs_time < timestamp '2024-01-20')""")
def a21(v):
    s = m.fit_scaler(v.grid, ["sic", "u10"], where=F.col("obs_time") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return s.select("channel", rnd("mean", 6).alias("mean"), rnd("std", 6).alias("std"))


@case("a21_apply_scaler", """
select obs_time, latitude, longitude, round(coalesce((sic-m)/s,0),6)+0.0D as sic from v_grid, (select avg(sic) m, stddev_pop(sic) s from v_grid)""")
def a21b(v):
    gr = v.grid
    return m.apply_scaler(gr, m.fit_scaler(gr, ["sic"]), ["sic"], fill=0.0).select(*K, rnd("sic", 6).alias("sic"))


@case("m07_zero_baseline", """
select round(avg(abs(actual)),6) as zero_mae, round(avg(abs(actual-pred)),6) as model_mae, avg(abs(actual-pred)) < avg(abs(actual)) as beats_zero from o_pairs""")
def m07(v):
    from floetrack.operators.forecast import zero_baseline
    p = g.consecutive_pairs(v.grid, "sic")
    z = m.regression_metrics(zero_baseline(p)).select(F.col("mae").alias("z"))
    x = m.regression_metrics(p).select(F.col("mae").alias("x"))
    return attach(z, x).select(rnd("z", 6).alias("zero_mae"), rnd("x", 6).alias("model_mae"), (F.col("x") < F.col("z")).alias("beats_zero"))
