"""Join queries."""
from pyspark.sql import functions as F

from floetrack.config import DEPLOYED
from floetrack.functions import geo
from floetrack.functions.values import rnd
from floetrack.operators import forecast as fc
from floetrack.operators import grids as g
from floetrack.operators import joins as j
from floetrack.operators import tracks as tr
from floetrack.operators.axes import grid_axes
from floetrack.operators.stats import attach
from floetrack.plans.cases_grids import nav
from floetrack.plans.cases_tracks import brg, hav
from floetrack.plans.flagship import feature_table, track_environment, track_environments
from floetrack.plans.registry import case, shared_cte

shared_cte("ax_t", "select distinct obs_time as axt, epoch_us(obs_time) as av from v_grid")
shared_cte("ax_la", "select distinct latitude as a from v_grid")
shared_cte("ax_lo", "select distinct longitude as o from v_grid")
shared_cte("o_snap", """
select t.*, (select arg_min(axt,(abs(av-epoch_us(t.obs_time)),av)) from ax_t) as st, (select arg_min(a,(abs(a-t.latitude),a)) from ax_la) as sa,
 (select arg_min(o,(abs(o-t.longitude),o)) from ax_lo) as so from v_tracks t""")
shared_cte("o_env", """
select s.*, abs(epoch_us(s.obs_time)-epoch_us(st))/3.6e9D as gap, g.sic, g.uo, g.vo, g.u10, g.v10, g.t2m, g.msl
from o_snap s left join v_grid g on g.obs_time=st and g.latitude=sa and g.longitude=so""")


@case("j01_env_join", """
select event_id, case when gap<=24D then sic end as sic, round(gap,2)+0.0D as sea_ice_gap_hours, cast(gap>24D as int) as sea_ice_stale from o_env""")
def j01(v):
    return j.env_join(v.tracks, v.grid, ["sic"], "sea_ice").select("event_id", "sic", "sea_ice_gap_hours", "sea_ice_stale")


@case("j01_env_join_tight", """
select event_id, case when gap<=1D then uo end as uo, case when gap<=1D then t2m end as t2m, cast(gap>1D as int) as x_stale from o_env""")
def j01b(v):
    return j.env_join(v.tracks, v.grid, ["uo", "t2m"], "x", 1.0).select("event_id", "uo", "t2m", "x_stale")


READINGS = "select ts as obs_time, 0.0D as latitude, 0.0D as longitude, avg(value) as sic from events where event_type <> 'click' group by ts"


@case("j01_asof_long_axis", f"""
with g as ({READINGS}), a as (select t.event_id, t.obs_time, g.obs_time as t0, g.sic as v0 from v_tracks t asof left join g on t.obs_time >= g.obs_time),
b as (select t.event_id, g.obs_time as t1, g.sic as v1 from v_tracks t asof left join g on t.obs_time <= g.obs_time),
n as (select event_id, obs_time, t0 is not null and (t1 is null or obs_time - t0 <= t1 - obs_time) as low, t0, t1, v0, v1 from a join b using (event_id))
select event_id, round(case when abs(epoch_us(obs_time) - epoch_us(case when low then t0 else t1 end)) <= 3600000000 then case when low then v0 else v1 end end, 6)+0.0D as sic,
 round(abs(epoch_us(obs_time) - epoch_us(case when low then t0 else t1 end))/3.6e9D, 2)+0.0D as x_gap_hours from n""")
def j01_long(v):
    g = v.sql(READINGS)
    out = j.env_join(v.tracks, g, ["sic"], "x", 1.0, grid_axes(g, listed=0))    # the times as a table, whatever their number
    return out.select("event_id", rnd("sic", 6).alias("sic"), "x_gap_hours")


@case("j02_env_nearest", "select event_id, uo, vo, u10, v10 from o_env")
def j02(v):
    return j.env_join(v.tracks, v.grid, ["uo", "vo", "u10", "v10"], "x", None).select("event_id", "uo", "vo", "u10", "v10")


FLAG = """
select k.iceberg_id, k.obs_time, k.event_id, round(dt,4)+0.0D as time_diff_hours, round(nm,4)+0.0D as displacement_nm,
  round(nm/dt,4)+0.0D as speed_knots, round(b,2)+0.0D as bearing_deg, round(run,4)+0.0D as distance_traveled_nm,
  case when gap<=24D then sic end as sic, case when gap<=24D then t2m end as t2m, round(gap,2)+0.0D as sea_ice_gap_hours, cast(gap>24D as int) as sea_ice_stale,
  round(sqrt(pow(coalesce(case when gap<=24D then uo end,0),2)+pow(coalesce(case when gap<=24D then vo end,0),2)),6)+0.0D as current_magnitude,
  case when gap<=24D then round((degrees(atan2(u10,v10))+360D) % 360D,4)+0.0D end as wind_direction
from o_kin k join o_env e on e.event_id=k.event_id"""


@case("j01_flagship", FLAG)
def flagship(v):
    return track_environment(v.tracks, v.grid).select(
        "iceberg_id", "obs_time", "event_id", "time_diff_hours", "displacement_nm", "speed_knots", "bearing_deg", "distance_traveled_nm",
        "sic", "t2m", "sea_ice_gap_hours", "sea_ice_stale", "current_magnitude", "wind_direction")


@case("j01_three_grids", """
with oc as (select obs_time + interval 6 hour as t, latitude as la, longitude as lo, uo, vo from v_grid where day(obs_time) % 3 = 1),
ta as (select distinct t from oc), laa as (select distinct la from oc), loa as (select distinct lo from oc),
n as (select event_id, obs_time, (select arg_min(t,(abs(epoch_us(t)-epoch_us(v.obs_time)),t)) from ta) as nt, (select arg_min(la,(round(abs(la-v.latitude),9),la)) from laa) as nla,
  (select arg_min(lo,(round(abs(lo-v.longitude),9),lo)) from loa) as nlo from v_tracks v),
o as (select n.event_id, abs(epoch_us(nt)-epoch_us(n.obs_time))/3.6e9D as ogap, oc.uo, oc.vo from n left join oc on oc.t=n.nt and oc.la=n.nla and oc.lo=n.nlo)
select k.iceberg_id, k.obs_time, k.event_id, round(dt,4)+0.0D as time_diff_hours, round(nm,4)+0.0D as displacement_nm,
  case when e.gap<=24D then e.sic end as sic, round(e.gap,2)+0.0D as sea_ice_gap_hours, cast(e.gap>24D as int) as sea_ice_stale,
  case when ogap<=24D then o.uo end as uo, case when ogap<=24D then o.vo end as vo, round(ogap,2)+0.0D as ocean_gap_hours, cast(ogap>24D as int) as ocean_stale,
  round(sqrt(pow(coalesce(case when ogap<=24D then o.uo end,0),2)+pow(coalesce(case when ogap<=24D then o.vo end,0),2)),6)+0.0D as current_magnitude,
  cast(null as double) as t2m, cast(null as double) as weather_gap_hours, 1 as weather_stale
from o_kin k join o_env e on e.event_id=k.event_id join o on o.event_id=k.event_id""")
def three_grids(v):
    ocean = v.grid.filter("day(obs_time) % 3 = 1").withColumn("obs_time", F.col("obs_time") + F.expr("interval 6 hours"))
    return track_environments(v.tracks, {"sea_ice": v.grid, "ocean": ocean}).select(
        "iceberg_id", "obs_time", "event_id", "time_diff_hours", "displacement_nm", "sic", "sea_ice_gap_hours", "sea_ice_stale", "uo", "vo",
        "ocean_gap_hours", "ocean_stale", "current_magnitude", "t2m", "weather_gap_hours", "weather_stale")


@case("j01_feature_table", """
with s as (select event_id, row_number() over w as rn0, count(*) over (partition by iceberg_id) as cn, lag(latitude) over w as pla from v_tracks
  window w as (partition by iceberg_id order by obs_time nulls first, event_id)),
f as (select k.event_id, k.iceberg_id, round(dt,4)+0.0D as time_diff_hours, case when e.gap<=24D then e.sic end as sic,
  case when rn0-1 < greatest(1, floor(cn*0.70D)) then 'train' when rn0-1 < greatest(1, floor(cn*0.70D)) + floor(cn*0.15D) then 'val' else 'test' end as split, rn0-1 as row_index, pla as prev_latitude
  from o_kin k join o_env e on e.event_id=k.event_id join s on s.event_id=k.event_id)
select f.*, lag(sic) over (partition by iceberg_id order by row_index) as sic_lag from f""")
def features(v):
    return feature_table(v.tracks, {"sea_ice": v.grid}).select("event_id", "iceberg_id", "time_diff_hours", "sic", "split", "row_index", "prev_latitude", "sic_lag")


shared_cte("o_latest", """
select iceberg_id, arg_max(latitude,(obs_time,-event_id)) as latitude, arg_max(longitude,(obs_time,-event_id)) as longitude,
 arg_max(length_nm,(obs_time,-event_id)) as length_nm, max(obs_time) as obs_time, arg_max(event_id,(obs_time,-event_id)) as event_id from v_tracks group by 1""")


def latest(v):
    return tr.latest_state(v.tracks, per_column=False)


shared_cte("o_pred", """
select *, case when event_id % 3 = 0 then latitude + 1.0D end as predicted_lat, case when event_id % 3 = 0 then longitude - 2.0D end as predicted_lon from o_latest""")
shared_cte("o_berg", "select iceberg_id, coalesce(predicted_lat, latitude) as latitude, coalesce(predicted_lon, longitude) as longitude from o_pred")


def predicted(v):
    t = F.col("event_id") % 3 == 0
    return (latest(v).withColumn("predicted_lat", F.when(t, F.col("latitude") + 1.0))
            .withColumn("predicted_lon", F.when(t, F.col("longitude") - 2.0)))


@case("j08_pairs_within", f"""
select a.iceberg_id as iceberg_id_a, b.iceberg_id as iceberg_id_b, round({hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')},6)+0.0D as distance_km
from o_latest a join o_latest b on a.iceberg_id < b.iceberg_id where {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 150D""")
def j08w(v):
    return j.pairwise_within(latest(v), "iceberg_id", 150.0).withColumn("distance_km", rnd("distance_km", 6))


@case("j06_min_distance", f"""
select cell_id, round(min(d),5)+0.0D as iceberg_distance_km, arg_min(iceberg_id,(round(d,6),iceberg_id)) as iceberg_id from (
 select n.cell_id, b.iceberg_id, {hav('n.latitude', 'n.longitude', 'b.latitude', 'b.longitude')} as d from o_nav n, o_berg b) group by 1""")
def j06(v):
    return j.min_distance(nav(v), "cell_id", predicted(v)).select("cell_id", rnd("iceberg_distance_km", 5).alias("iceberg_distance_km"), "iceberg_id")


@case("j06_min_distance_reach", f"""
select cell_id, case when d<150D then round(d,5)+0.0D end as iceberg_distance_km from (select n.cell_id, min({hav('n.latitude', 'n.longitude', 'b.latitude', 'b.longitude')}) as d from o_nav n, o_berg b group by 1)""")
def j06b(v):
    return j.min_distance(nav(v), "cell_id", predicted(v), reach_km=150.0).select("cell_id", rnd("iceberg_distance_km", 5).alias("iceberg_distance_km"))


@case("j07_annotate_coast", f"""
select iceberg_id, round(d,1)+0.0D as distance_to_coast_km, d <= 111.19492664455873D as on_land from (select b.iceberg_id, min({hav('b.latitude', 'b.longitude', 'c.latitude', 'c.longitude', '6371.0')}) as d
 from o_latest b, v_cells c where c.is_land group by 1)""")
def j07(v):
    out = j.annotate_coast(latest(v), "iceberg_id", v.cells.filter("is_land"), 111.19492664455873)
    return out.select("iceberg_id", "distance_to_coast_km", "on_land")


@case("j08_pair_distance", f"""
select p.a as id_a, p.b as id_b, round({hav('x.latitude', 'x.longitude', 'y.latitude', 'y.longitude')},6)+0.0D as distance_km,
  case when x.iceberg_id is null or y.iceberg_id is null then 'not_found' else 'ok' end as status
from (select distinct concat('B', user_id) as a, concat('B', event_id % 200) as b from events) p left join o_latest x on x.iceberg_id=p.a left join o_latest y on y.iceberg_id=p.b""")
def j08(v):
    pairs = v.table("events").select(F.concat(F.lit("B"), "user_id").alias("id_a"), F.concat(F.lit("B"), F.col("event_id") % 200).alias("id_b")).distinct()
    return j.pair_distance(pairs, latest(v), "iceberg_id").select("id_a", "id_b", rnd("distance_km", 6).alias("distance_km"), "status")


shared_cte("o_wp", """
select *, lead(latitude) over w as la2, lead(longitude) over w as lo2, count(*) over (partition by route_id) as n from v_waypoints window w as (partition by route_id order by wp_index)""")
shared_cte("o_s50", """
select route_id, latitude + coalesce((la2-latitude)*(s/50D),0) as latitude, longitude + coalesce((lo2-longitude)*(s/50D),0) as longitude from o_wp, range(0,50) r(s) where la2 is not null or s = 0""")
shared_cte("o_s5", """
select route_id, latitude + coalesce((la2-latitude)*(s/5D),0) as latitude, longitude + coalesce((lo2-longitude)*(s/5D),0) as longitude from o_wp, range(0,5) r(s) where la2 is not null or s = 0""")


@case("j09_route_distance_pairs", f"""
with p as (select route_id, concat('B', route_id % 150) as iceberg_id from v_routes), w as (select route_id, max(n) as n from o_wp group by 1),
d as (select p.route_id, p.iceberg_id, min({hav('s.latitude', 's.longitude', 'b.latitude', 'b.longitude')}) as km from p join o_s50 s using(route_id) join o_latest b using(iceberg_id) group by 1,2)
select p.route_id, p.iceberg_id, case when w.n >= 2 then round(km,6)+0.0D end as distance_km,
 case when coalesce(w.n, 0) < 2 then 'invalid' when km is null then 'not_found' else 'ok' end as status from p left join w using(route_id) left join d using(route_id, iceberg_id)""")
def j09(v):
    pairs = v.routes.select("route_id", F.concat(F.lit("B"), F.col("route_id") % 150).alias("iceberg_id"))
    return j.route_distance(v.waypoints, latest(v), "iceberg_id", pairs=pairs).select("route_id", "iceberg_id", rnd("distance_km", 6).alias("distance_km"), "status")


shared_cte("o_pos", "select distinct latitude, longitude from o_s5")
shared_cte("o_posberg", f"""
select p.latitude, p.longitude, arg_min({{'id': b.iceberg_id, 'km': d, 'la': b.bla, 'lo': b.blo}}, (round(d,6), b.iceberg_id)) as m from (
 select p.latitude, p.longitude, b.iceberg_id, b.latitude as bla, b.longitude as blo, {hav('p.latitude', 'p.longitude', 'b.latitude', 'b.longitude')} as d from o_pos p, o_latest b) p,
 lateral (select p.iceberg_id, p.bla, p.blo) b group by 1,2""")
shared_cte("o_routeberg", """
select route_id, arg_min(m, (round(m.km,6), m.id)) as m from o_s5 join o_posberg using(latitude, longitude) group by 1""")


@case("j10_nearest_berg_per_route", "select route_id, m.id as iceberg_id, round(m.km,5)+0.0D as distance_km from o_routeberg")
def j10(v):
    return j.nearest_hazard(j.route_samples(v.waypoints, 5), latest(v), ["iceberg_id"]).select("route_id", "iceberg_id", rnd("distance_km", 5).alias("distance_km"))


@case("j11_match_place", f"""
select iceberg_id as pid, arg_min(place_id,(round(d,6), kind<>'port', place_id)) as place_id, arg_min(kind,(round(d,6), kind<>'port', place_id)) as kind from (
 select b.iceberg_id, p.place_id, p.kind, {hav('b.latitude', 'b.longitude', 'p.latitude', 'p.longitude')} as d from o_latest b, v_places p) where d <= 500D group by 1""")
def j11(v):
    return j.match_place(latest(v).withColumnRenamed("iceberg_id", "pid"), "pid", v.places, 500.0).select("pid", "place_id", "kind")


shared_cte("o_b", "select max(latitude) as mla, cast(max(latitude)+74.5D as int) as mi from v_cells")
shared_cte("o_navq", """
select p.*, cast(least((select mi from o_b),greatest(0,ceil((la+74.5D)-0.5D))) as int) as i, cast(least(35,greatest(0,ceil((lo+180D)/10D-0.5D))) as int) as j from (
 select place_id, name, kind, least(greatest(latitude,-74.5D),(select mla from o_b)) as la, least(greatest(longitude,-180D),170D) as lo, latitude, longitude from v_places) p""")
shared_cte("o_navc", "select *, cast(latitude+74.5D as int) as ci, cast((longitude+180D)/10D as int) as cj from v_cells")
shared_cte("o_nearnav", f"""
select q.place_id, arg_min({{'la': c.latitude, 'lo': c.longitude, 'km': d}}, (tier, round(d,6), c.latitude, c.longitude)) as m from (
 select q.*, c.*, {hav('q.la', 'q.lo', 'c.clat', 'c.clon')} as d, case when abs(c.cj-q.j) <= 3 then 1 else 2 end as tier, least(abs(c.clon-q.lo), 360D-abs(c.clon-q.lo)) as dl
 from o_navq q, (select latitude as clat, longitude as clon, cj, is_land from o_navc) c where not c.is_land) q,
 (select 1) z, lateral (select q.clat as latitude, q.clon as longitude) c where tier = 1 or dl <= 30D group by 1""")


@case("j12_nearest_navigable", """
select q.place_id, case when not o.is_land then o.latitude else m.la end as nav_lat, case when not o.is_land then o.longitude else m.lo end as nav_lon,
 case when not o.is_land then 0D else round(m.km,5)+0.0D end as nav_km from o_navq q join o_navc o on o.ci=q.i and o.cj=q.j join o_nearnav n on n.place_id=q.place_id""")
def j12(v):
    return j.nearest_navigable(v.places, "place_id", v.cells).select("place_id", "nav_lat", "nav_lon", rnd("nav_km", 5).alias("nav_km"))


@case("j13_resolve_endpoints", """
select q.place_id, case when not o.is_land then 'navigable' else 'approach' end as status, case when not o.is_land then o.latitude else m.la end as lat,
 case when o.is_land then q.name end as place_name,
 case when o.is_land then case when m.km <= 300D then printf('%s (%d) lies on land; routing to the nearest valid ocean approach point (%.2f, %.2f, %.1f km offshore).', q.name, q.place_id, m.la, m.lo, m.km)
  else printf('%s (%d) lies on land. The nearest valid ocean approach point in the configured land mask is %.1f km away at (%.2f, %.2f), which exceeds the configured approach distance (300 km). Decision support routes to that cell; it is not station-side anchorage.', q.name, q.place_id, m.km, m.la, m.lo) end end as note
from o_navq q join o_navc o on o.ci=q.i and o.cj=q.j join o_nearnav n on n.place_id=q.place_id""")
def j13(v):
    pts = v.places.select(F.col("place_id").alias("pid"), "latitude", "longitude")
    out = j.resolve_endpoints(pts, "pid", v.cells, v.places, 300.0)
    return out.select(F.col("pid").alias("place_id"), "status", "lat", "place_name", "note")


@case("j13_rejected", """
select count(*) filter (where o.is_land) as rejected, count(*) filter (where not o.is_land) as navigable from o_latest b
join o_navc o on o.ci=cast(least((select mi from o_b),greatest(0,ceil((least(greatest(b.latitude,-74.5D),(select mla from o_b))+74.5D)-0.5D))) as int) and o.cj=cast(least(35,greatest(0,ceil((least(greatest(b.longitude,-180D),170D)+180D)/10D-0.5D))) as int)""")
def j13b(v):
    far = v.places.withColumn("latitude", F.lit(10.0))
    out = j.resolve_endpoints(latest(v), "iceberg_id", v.cells, far)
    return out.agg(F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("status") == "navigable").alias("navigable"))


@case("j14_sample_grid", """
select w.route_id, w.wp_index, c.is_land, c.z from v_waypoints w join o_navc c on c.ci=cast(least((select mi from o_b),greatest(0,ceil((w.latitude+74.5D)-0.5D))) as int)
 and c.cj=cast(least(35,greatest(0,ceil((w.longitude+180D)/10D-0.5D))) as int)""")
def j14(v):
    return j.sample_grid(v.waypoints, v.cells, ["is_land", "z"]).select("route_id", "wp_index", "is_land", "z")


@case("j15_vessel_limits", """
select vessel_id, case ice_class when 'PC3' then 1D when 'PC5' then 0.6D when 'PC7' then 0.3D when 'NO' then 0.2D else 0.6D end as max_concentration,
  round(greatest(10D, safety_distance_nm*1.852D),6) as clearance_km from v_vessels""")
def j15(v):
    return j.vessel_limits(v.vessels).select("vessel_id", "max_concentration", rnd("clearance_km", 6).alias("clearance_km"))


@case("j16_is_ocean", """
select event_id, case when t.longitude between 20 and 120 then not c.is_land end as is_ocean from v_tracks t
 join o_navc c on c.ci=cast(least((select mi from o_b),greatest(0,ceil((t.latitude+74.5D)-0.5D))) as int) and c.cj=cast(least(35,greatest(0,ceil((t.longitude+180D)/10D-0.5D))) as int)
where not (t.longitude between 20 and 120 and c.is_land)""")
def j16(v):
    return j.drop_known_land(j.is_ocean(v.tracks, v.cells)).select("event_id", "is_ocean")


@case("j17_score_land_mask", f"""
select count(*) as total_points, count(*) filter (where ok and not land) as ocean_points, count(*) filter (where ok and land) as land_points, count(*) filter (where not ok) as invalid_points,
  round(count(*) filter (where ok and not land)*100D/count(*),4)+0.0D as accuracy_percent from (
 select b.iceberg_id, (b.latitude between -74.5D and (select mla from o_b) and b.longitude between -180D and 170D) as ok,
  (own.is_land or (select min({hav('b.latitude', 'b.longitude', 'c.latitude', 'c.longitude')}) from v_cells c where c.is_land) <= 250D) as land
 from o_latest b join o_navc own on own.ci=cast(least((select mi from o_b),greatest(0,ceil((least(greatest(b.latitude,-74.5D),(select mla from o_b))+74.5D)-0.5D))) as int)
  and own.cj=cast(least(35,greatest(0,ceil((least(greatest(b.longitude,-180D),170D)+180D)/10D-0.5D))) as int))""")
def j17(v):
    return j.score_land_mask(latest(v), "iceberg_id", v.cells, 250.0)[1].drop("status")


@case("j20_align_channels", """
select r.obs_time, r.latitude, r.longitude, g.u10, g.t2m from v_grid r left join v_grid g on g.latitude = r.latitude and g.obs_time=r.obs_time
 and g.longitude = (select arg_min(o,(abs(o+4D-r.longitude),o)) from (select distinct longitude as o from v_grid))""")
def j20(v):
    wx = v.grid.withColumn("longitude", F.col("longitude") + 4.0)
    return j.align_channels(v.grid.select("obs_time", "latitude", "longitude", "sic"), [(wx, ["u10", "t2m"])]).select(
        "obs_time", "latitude", "longitude", "u10", "t2m")


@case("j21_with_fallback", """
select iceberg_id, case when event_id % 3 = 0 then 'rf' else 'persistence' end as model, event_id % 3 <> 0 as from_fallback from o_latest""")
def j21(v):
    d = latest(v)
    rf = d.filter(F.col("event_id") % 3 == 0).select("iceberg_id", F.lit("rf").alias("model"))
    base = d.select("iceberg_id", F.lit("persistence").alias("model"))
    return j.with_fallback(rf, base, "iceberg_id")


@case("j23_closest", f"""
select arg_min(iceberg_id,(round(d,6),iceberg_id)) as iceberg_id, round(min(d),6)+0.0D as distance_km from (select iceberg_id, {hav('latitude', 'longitude', '-66.5D', '140.0D')} as d from o_latest)""")
def j23(v):
    return j.closest(latest(v), -66.5, 140.0, "iceberg_id").withColumn("distance_km", rnd("distance_km", 6))


shared_cte("o_risk0", """
select ci as i, cj as j, c.latitude, c.longitude, case when is_land then 1D else coalesce(s.sic,0D)*0.5D end as r from o_navc c left join o_last s on s.latitude=c.latitude and s.longitude=c.longitude""")


@case("j25_grid_edges", f"""
select a.i, a.j, b.i as ni, b.j as nj, round({hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')},6)+0.0D as distance_km,
 round({hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}*(0.4D+0.6D*0.5D*(a.r+b.r)),6)+0.0D as step_cost
from o_risk0 a join o_risk0 b on abs(a.i-b.i)<=1 and abs(a.j-b.j)<=1 and not (a.i=b.i and a.j=b.j)
where a.r < 0.95D and b.r < 0.95D and not (a.i<>b.i and a.j<>b.j and exists (select 1 from o_risk0 x where x.r >= 0.95D and ((x.i=b.i and x.j=a.j) or (x.i=a.i and x.j=b.j))))""")
def j25(v):
    s = g.latest_snapshot(v.grid).select("latitude", "longitude", "sic")
    c = v.cells.join(s, ["latitude", "longitude"], "left").withColumn(
        "total_risk", F.when(F.col("is_land"), 1.0).otherwise(F.coalesce("sic", F.lit(0.0)) * 0.5))
    e = j.grid_edges(c)
    return e.select("i", "j", "ni", "nj", rnd("distance_km", 6).alias("distance_km"), rnd("step_cost", 6).alias("step_cost"))


@case("j22_model_status", """
select 'iceberg' as pipeline, 'trained_on_real_data' as status, bool_or(not demo) as metrics_available from v_metrics where pipeline='iceberg'
union all select 'sea_ice', 'evaluated_on_real_data', bool_or(not demo) from v_metrics where pipeline='sea_ice'""")
def j22(v):
    from floetrack.operators.status import model_status
    m = v.metrics
    reg = m.select("pipeline", "model").distinct().select(
        "pipeline", F.col("model").alias("name"), (F.col("model") != "model_0").alias("available"), (F.col("pipeline") == "sea_ice").alias("trained_on_demo"))
    return model_status(reg, m).select("pipeline", "status", "metrics_available")


@case("j24_dataset_inventory", """
select dataset, classification, status, any_real from (select dataset, case when c = 'pipeline_data' then 'real_' || dataset else c end as classification,
 case when c='synthetic_demo' then 'demo' when c='unknown' then 'missing' else 'ok' end as status, true as any_real from (
 select distinct case event_type when 'click' then 'sea_ice' when 'view' then 'iceberg' when 'purchase' then 'weather' else 'ocean' end as dataset,
  case event_type when 'click' then 'pipeline_data' when 'view' then 'synthetic_demo' when 'purchase' then 'unknown' else 'imported' end as c from events))""")
def j24(v):
    from floetrack.operators.status import dataset_inventory
    e = F.col("event_type")
    d = v.table("events").select(
        F.when(e == "click", "sea_ice").when(e == "view", "iceberg").when(e == "purchase", "weather").otherwise("ocean").alias("dataset"),
        F.when(e == "click", "pipeline_data").when(e == "view", "synthetic_demo").when(e == "purchase", "unknown").otherwise("imported").alias("classification"),
        (e == "view").alias("demo")).distinct()
    return dataset_inventory(d).select("dataset", "classification", "status", "any_real")
