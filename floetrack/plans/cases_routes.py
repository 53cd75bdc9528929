"""Risk-grid and route queries."""
from pyspark.sql import functions as F

from floetrack.config import DEPLOYED
from floetrack.functions import risk
from floetrack.functions.values import rnd
from floetrack.operators import grids as g
from floetrack.operators import joins as j
from floetrack.operators import routes as r
from floetrack.operators.axes import grid_axes
from floetrack.plans.cases_functions import BERG, ICE
from floetrack.plans.cases_joins import latest
from floetrack.plans.cases_tracks import brg, hav
from floetrack.plans.registry import case, shared_cte

# Navigation cells of the route queries are the field's own cells.
shared_cte("o_berg_cell", f"""
select ci as i, cj as j, c.latitude, c.longitude, c.is_land, min({hav('c.latitude', 'c.longitude', 'b.latitude', 'b.longitude')}) as bkm
from o_navc c, o_latest b group by 1,2,3,4,5""")
shared_cte("o_wx", """
select c.latitude, c.longitude, arg_min(w.ws,(round(sqrt(pow(w.la-c.latitude,2)+pow(w.lo-c.longitude,2)),6),w.wx_id)) as ws from v_cells c,
 (select latitude-0.2D as la, longitude+3.0D as lo, cast((latitude+74.5D)*1000 + (longitude+180D) as bigint) as wx_id, sqrt(u10*u10+v10*v10) as ws from o_last) w group by 1,2""")
shared_cte("o_layers", f"""
select b.*, least(greatest(s.sic,0D),1D) as conc, s.sic is null as nosic, least(1D,greatest(0D,w.ws/30D)) as wx, coalesce(s.sic > 0.85D,false) or coalesce(bkm < 20D,false) as blocked
from o_berg_cell b left join o_last s using(latitude, longitude) left join o_wx w using(latitude, longitude)""")
shared_cte("o_risk", f"""
select *, case when nosic then null else conc end as concentration, case when is_land or blocked then 1D else least(1D,greatest(0D,0.4D*case when nosic then 0D else {ICE.format(c='conc')} end
 +0.35D*{BERG.format(d='bkm')}+0.25D*coalesce(wx,0))) end as total_risk from o_layers""")


def weather(v):
    s = g.latest_snapshot(v.grid)
    return s.select((F.col("latitude") - 0.2).alias("latitude"), (F.col("longitude") + 3.0).alias("longitude"),
                    ((F.col("latitude") + 74.5) * 1000 + (F.col("longitude") + 180.0)).cast("long").alias("wx_id"),
                    F.hypot("u10", "v10").alias("wind_speed"))


def the_grid(v):
    cells = v.cells.withColumn("cell_id", ((F.col("latitude") + 74.5) * 1000 + (F.col("longitude") + 180.0)).cast("long"))
    ice = g.latest_snapshot(v.grid).select("latitude", "longitude", "sic")
    return r.risk_grid(cells.select("cell_id", "latitude", "longitude"), ice, latest(v), weather(v), v.cells, DEPLOYED)


def vessels(v):
    return j.vessel_limits(v.vessels, DEPLOYED).withColumn("rate", F.col("tons_per_day"))


@case("j27_risk_grid", """
select latitude, longitude, round(concentration,6)+0.0D as concentration, round(bkm,5)+0.0D as iceberg_km, round(wx,6)+0.0D as weather_risk, is_land, blocked,
  round(total_risk,6)+0.0D as total_risk from o_risk""")
def j27(v):
    return the_grid(v).select("latitude", "longitude", rnd("concentration", 6).alias("concentration"), rnd("iceberg_km", 5).alias("iceberg_km"),
                              rnd("weather_risk", 6).alias("weather_risk"), "is_land", "blocked", rnd("total_risk", 6).alias("total_risk"))


@case("j27_risk_grid_neutral", f"""
select latitude, longitude, round(case when is_land then 1D when coalesce(conc > 0.85D,false) then 1D else least(1D,0.4D*case when nosic then 0D else {ICE.format(c='conc')} end) end,6)+0.0D as total_risk from o_layers""")
def j27b(v):
    cells = v.cells.withColumn("cell_id", F.monotonically_increasing_id())
    ice = g.latest_snapshot(v.grid).select("latitude", "longitude", "sic")
    out = r.risk_grid(cells.select("cell_id", "latitude", "longitude"), ice, land=v.cells, cfg=DEPLOYED)
    return out.select("latitude", "longitude", rnd("total_risk", 6).alias("total_risk"))


@case("a31_grid_counts", """
select count(*) as cells, count(*) filter (where is_land) as land_cells, count(*) filter (where blocked) as blocked_cells,
 count(*) filter (where coalesce(concentration > 0.85D,false) and not coalesce(bkm < 20D,false)) as newly_ice_blocked,
 count(*) filter (where concentration is null) as missing_cells, count(*) filter (where total_risk >= 0.95D) as obstacle_cells from o_risk""")
def a31(v):
    return r.grid_counts(the_grid(v))


@case("f24_notes_explanation", """
select cast((case when m > 0 then 1 else 0 end) + (case when n > 0 then 1 else 0 end) + 5 as bigint) as n_lines from (select count(*) filter (where concentration is null) as m,
 count(*) filter (where coalesce(concentration > 0.85D,false) and not coalesce(bkm < 20D,false)) as n from o_risk)""")
def f24(v):
    e = r.explanation(r.risk_notes(the_grid(v)))
    return e.select(F.size("explanation").cast("long").alias("n_lines"))


@case("f24_hazard_config", "select 0.85D as block, 20D as radius, 60D as warn, count(*) as tracked from o_latest")
def f24b(v):
    from floetrack.operators.stats import attach
    n = latest(v).agg(F.count(F.lit(1)).alias("tracked"))
    return attach(r.hazard_config(v.spark), n).select(F.col("sea_ice.block_threshold").alias("block"), F.col("iceberg.block_radius_km").alias("radius"),
                                                      F.col("iceberg.warning_radius_km").alias("warn"), "tracked")


shared_cte("o_wps", """
select w.route_id, w.wp_index, w.latitude, w.longitude, x.vessel_id, coalesce(q.cruise_speed_knots,12D) as spd, q.tons_per_day as rate, q.safety_distance_nm,
 case q.ice_class when 'PC3' then 1D when 'PC5' then 0.6D when 'PC7' then 0.3D when 'NO' then 0.2D end as lim, k.concentration, k.bkm, k.is_land,
 case when coalesce(k.concentration > (case q.ice_class when 'PC3' then 1D when 'PC5' then 0.6D when 'PC7' then 0.3D when 'NO' then 0.2D else 0.6D end),false) then 1D else coalesce(k.total_risk,0) end as risk,
 (w.latitude between -74.5D and (select mla from o_b) and w.longitude between -180D and 170D) as inside
from v_waypoints w join v_routes x using(route_id) left join v_vessels q using(vessel_id)
left join o_risk k on k.i=cast(least((select mi from o_b),greatest(0,ceil((w.latitude+74.5D)-0.5D))) as int) and k.j=cast(least(35,greatest(0,ceil((w.longitude+180D)/10D-0.5D))) as int)""")
shared_cte("o_seg", f"""
select *, coalesce(km0,0) as km, case when km0 is not null then greatest(risk, prisk) end as srisk from (
 select *, {hav('lag(latitude) over w', 'lag(longitude) over w', 'latitude', 'longitude')} as km0, lag(risk) over w as prisk,
 {brg('lag(latitude) over w', 'lag(longitude) over w', 'latitude', 'longitude')} as hd from o_wps window w as (partition by route_id order by wp_index))""")


@case("w17_score_waypoints", """
select route_id, wp_index, round(km,6)+0.0D as segment_km, round(coalesce(hd,0),4)+0.0D as heading_deg, round(sum(km) over w,6)+0.0D as cumulative_km,
  round(sum(km/1.852D/spd) over w,6)+0.0D as elapsed_hours, round(sum(rate*km/1.852D/spd/24D) over w,6)+0.0D as fuel_tons, round(risk,6)+0.0D as risk_score,
  case when risk>=0.8D then 'extreme' when risk>=0.6D then 'high' when risk>=0.3D then 'moderate' else 'low' end as risk_level
from o_seg window w as (partition by route_id order by wp_index)""")
def w17(v):
    s = r.score_waypoints(v.waypoints, the_grid(v), v.routes, vessels(v), axes=grid_axes(v.cells, ("latitude", "longitude")))
    return s.select("route_id", "wp_index", rnd("segment_km", 6).alias("segment_km"), rnd("heading_deg", 4).alias("heading_deg"),
                    rnd("cumulative_km", 6).alias("cumulative_km"), rnd("elapsed_hours", 6).alias("elapsed_hours"),
                    rnd("fuel_tons", 6).alias("fuel_tons"), rnd("risk_score", 6).alias("risk_score"), "risk_level")


@case("a37_route_rollup", """
select route_id, count(*) as n_waypoints, round(sum(km),2)+0.0D as distance_km, round(sum(km/1.852D/spd),2)+0.0D as travel_time_hours,
 round(sum(rate*km/1.852D/spd/24D),2)+0.0D as fuel_tons, round(case when sum(km)>0 then sum(km*srisk)/sum(km) else arg_max(risk, wp_index) end,4)+0.0D as risk_score,
 ['low','moderate','high','extreme'][max(case when risk>=0.8D then 4 when risk>=0.6D then 3 when risk>=0.3D then 2 else 1 end)] as max_risk_level,
 (count(*) >= 2 and bool_and(inside) and not bool_or(is_land and inside) and not bool_or(risk >= 0.95D)) as valid from o_seg group by 1""")
def a37(v):
    s = r.score_waypoints(v.waypoints, the_grid(v), v.routes, vessels(v), axes=grid_axes(v.cells, ("latitude", "longitude")))
    return r.route_rollup(s).select("route_id", "n_waypoints", "distance_km", "travel_time_hours", "fuel_tons", "risk_score", "max_risk_level", "valid")


@case("f21_route_valid", """
select route_id, (count(*) >= 2 and bool_and(inside) and not bool_or(is_land)) as valid from o_wps group by 1""")
def f21(v):
    c = v.cells
    ax = grid_axes(c, ("latitude", "longitude"))
    la, lo = ax["latitude"].values, ax["longitude"].values
    s = j.sample_grid(v.waypoints, c, ["is_land"], ax).withColumn(
        "inside", F.col("latitude").between(la[0], la[-1]) & F.col("longitude").between(lo[0], lo[-1]))
    a = s.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("inside").alias("i"), F.bool_or("is_land").alias("l"))
    return a.select("route_id", risk.route_valid("n", F.col("i"), F.col("l"), F.lit(False)).alias("valid"))


@case("f17_route_warnings", """
select route_id, count(*) as n_over_limit from (select distinct route_id, latitude, longitude, concentration from o_wps where concentration > coalesce(lim,0.6D)) group by 1""")
def f17r(v):
    s = r.score_waypoints(v.waypoints, the_grid(v), v.routes, vessels(v), axes=grid_axes(v.cells, ("latitude", "longitude")))
    w = r.route_warnings(s).filter(F.col("warning").contains("exceeds vessel limit"))
    return w.groupBy("route_id").agg(F.count(F.lit(1)).alias("n_over_limit"))



shared_cte("o_posice", f"""
select p.latitude, p.longitude, arg_min({{'sic': p.sic, 'km': d, 'la': p.cla, 'lo': p.clo}}, (round(d,6), p.cla, p.clo)) as m from (
 select p.latitude, p.longitude, c.sic, c.latitude as cla, c.longitude as clo, {hav('p.latitude', 'p.longitude', 'c.latitude', 'c.longitude')} as d
 from o_pos p, (select * from o_last where sic is not null) c) p group by 1,2""")
shared_cte("o_routeice", """
select route_id, arg_min(m, (round(m.km,6), m.la, m.lo)) as m from o_s5 join o_posice using(latitude, longitude) group by 1""")


@case("t06_nearest_hazard", "select route_id, m.la as cell_lat, m.lo as cell_lon, m.sic as sic, round(m.km,5)+0.0D as km from o_routeice")
def t06(v):
    ice = g.latest_snapshot(v.grid, value="sic").select("latitude", "longitude", "sic", F.col("latitude").alias("la"), F.col("longitude").alias("lo"))
    out = j.nearest_hazard(j.route_samples(v.waypoints, 5), ice, ["la", "lo"], ["sic"])
    return out.select("route_id", F.col("la").alias("cell_lat"), F.col("lo").alias("cell_lon"), "sic", rnd("distance_km", 5).alias("km"))


def alerts(v, cfg=None):
    ice = g.latest_snapshot(v.grid).select("latitude", "longitude", "sic")
    routes = v.routes.select("route_id", F.lit("main").alias("label"))
    return r.route_alerts(routes, v.waypoints, ice, latest(v).select("iceberg_id", "latitude", "longitude"), cfg)


@case("j28_route_alerts", """
select 'iceberg-' || route_id || '-main-' as alert_key, route_id, 'iceberg' as type,
 case when m.km<5D then 'critical' when m.km<=15D then 'high' when m.km<=30D then 'medium' else 'low' end as severity, round(m.km,5)+0.0D as distance_km,
 round(m.km*0.5399568D,5)+0.0D as distance_nm, m.id as iceberg_id from o_routeberg
union all select 'sea-ice-' || route_id || '-main-', route_id, 'sea-ice',
 case when m.sic>=0.8D then 'critical' when m.sic>=0.6D then 'high' when m.sic>=0.3D then 'medium' else 'low' end, round(m.km,5)+0.0D,
 round(m.km*0.5399568D,5)+0.0D, null from o_routeice
union all select t || '-' || route_id || '-main-', route_id, t, 'info', null, null, null from v_routes, (select unnest(['sea-ice','iceberg']) as t) where route_id not in (select route_id from v_waypoints)""")
def j28(v):
    return alerts(v).select(F.regexp_extract("alert_id", "^[a-z-]+[0-9]+-main-", 0).alias("alert_key"), "route_id", "type", "severity", rnd("distance_km", 5).alias("distance_km"),
                            rnd("distance_nm", 5).alias("distance_nm"), "iceberg_id")


@case("j28_alerts_without_sources", """
select route_id, t as type, 'info' as severity, t || '-' || route_id || '-main-unavailable-unavailable' as alert_id from v_routes, (select unnest(['sea-ice','iceberg']) as t)""")
def j28b(v):
    a = r.route_alerts(v.routes.select("route_id", F.lit("main").alias("label")), v.waypoints)
    return a.select("route_id", "type", "severity", "alert_id")


shared_cte("o_at", """
select route_id, latitude, longitude, la2, lo2, n, wp_index, seg, e - seg as st, e, tot, tot*((route_id % 11)/10D) as tg from (
 select *, sum(seg) over (partition by route_id order by wp_index) as e, sum(seg) over (partition by route_id) as tot from (
 select *, coalesce(""" + hav("latitude", "longitude", "la2", "lo2", "3440.065") + """,0) as seg from o_wp))""")


@case("w18_position_along", """
select route_id, round(greatest(tot-tg,0),5)+0.0D as remaining_nm, round(case when tot>0 then tg/tot*100D else 100D end,5)+0.0D as progress_pct,
 round(case when d<1e-10D then latitude else degrees(atan2(z, sqrt(x*x+y*y))) end,5)+0.0D as latitude
from (select *, a*cos(p1)*cos(l1)+b*cos(p2)*cos(l2) as x, a*cos(p1)*sin(l1)+b*cos(p2)*sin(l2) as y, a*sin(p1)+b*sin(p2) as z from (
 select *, sin((1-f)*d)/nullif(sin(d),0) as a, sin(f*d)/nullif(sin(d),0) as b from (
 select *, radians(latitude) as p1, radians(longitude) as l1, radians(la2) as p2, radians(lo2) as l2, seg/3440.065D as d, least(1D, coalesce((tg-st)/nullif(seg,0),0)) as f from (
 select *, row_number() over (partition by route_id order by wp_index) as k from o_at where la2 is not null and e + 1e-9D >= tg) where k = 1)))
union all select route_id, 0D, 100D, round(latitude,5)+0.0D from o_at where n = 1""")
def w18(v):
    at = v.routes.select("route_id", ((F.col("route_id") % 11) / 10.0).alias("fraction"))
    out = r.position_along(v.waypoints, at)
    return out.select("route_id", rnd("remaining_nm", 5).alias("remaining_nm"), rnd("progress_pct", 5).alias("progress_pct"), rnd("latitude", 5).alias("latitude"))


@case("t01_nearest_k", f"""
select iceberg_id, round(d,6)+0.0D as distance_km from (select iceberg_id, {hav('latitude', 'longitude', '-66.5D', '140.0D')} as d from o_latest) order by round(d,6), iceberg_id limit 10""")
def t01(v):
    return r.nearest_k(latest(v), -66.5, 140.0).select("iceberg_id", "distance_km")


@case("t02_largest_k", "select iceberg_id, round(length_nm,6) as length_nm from o_latest where length_nm > 0 order by length_nm desc, iceberg_id limit 10")
def t02(v):
    return r.largest_k(latest(v), "length_nm").select("iceberg_id", rnd("length_nm", 6).alias("length_nm"))


@case("t03_order_alerts", """
select event_id as alert_id, s as severity, value as distance_km, case s when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end as sort_rank
from (select *, case when value<5D then 'critical' when value<=15D then 'high' when value<=30D then 'medium' else 'low' end as s from events) order by 4, 3, 1""")
def t03(v):
    d = v.table("events").select(F.col("event_id").alias("alert_id"), risk.alert_severity("iceberg", "value").alias("severity"), F.col("value").alias("distance_km"))
    return r.order_alerts(d).withColumn("sort_rank", risk.severity_rank("severity"))


@case("t05_distinct_topk", """
select route_id, sig, k as rank from (select *, row_number() over (partition by route_id order by p, sig) as k from (select o_custkey as route_id, o_orderpriority as sig, min(o_totalprice) as p from orders group by 1,2)) where k <= 2""")
def t05(v):
    d = v.table("orders").select(F.col("o_custkey").alias("route_id"), F.col("o_orderpriority").alias("sig"), F.col("o_totalprice").alias("p"))
    return r.distinct_topk(d, "route_id", "sig", ["p"]).select("route_id", "sig", F.col("rank").cast("long").alias("rank"))
