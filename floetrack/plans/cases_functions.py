"""Scalar-function queries: each function runs over a whole table of positions, cells or texts."""
from pyspark.sql import functions as F

from floetrack.config import DEPLOYED, LEGACY
from floetrack.functions import geo, risk
from floetrack.functions import values as val
from floetrack.functions.values import rnd
from floetrack.plans.cases_tracks import brg, hav
from floetrack.plans.registry import case

P0 = ("-66.5D", "140.0D")


def _r(df, keys, **cols):
    return df.select(*keys, *[rnd(c, 6).alias(n) for n, c in cols.items()])


@case("f01_haversine", f"""
select event_id, round({hav('latitude', 'longitude', *P0)},6)+0.0D as km,
  round({hav('latitude', 'longitude', *P0, '6371.0')},6)+0.0D as km_round,
  round({hav('latitude', 'longitude', *P0, '3440.065')},6)+0.0D as nm from v_tracks""")
def f01(v):
    a = ("latitude", "longitude", F.lit(-66.5), F.lit(140.0))
    return _r(v.tracks, ["event_id"], km=geo.haversine(*a), km_round=geo.haversine(*a, 6371.0), nm=geo.haversine(*a, 3440.065))


@case("f02_bearing", f"select event_id, round({brg('latitude', 'longitude', *P0)},6)+0.0D as deg from v_tracks")
def f02(v):
    return _r(v.tracks, ["event_id"], deg=geo.bearing("latitude", "longitude", F.lit(-66.5), F.lit(140.0)))


DEST_LAT = ("asin(least(1D,greatest(-1D,sin(radians(latitude))*cos({d}/6371.0088D)+cos(radians(latitude))*sin({d}/6371.0088D)"
            "*cos(radians({b})))))")


def dest(b, d):
    la = DEST_LAT.format(b=b, d=d)
    lo = (f"degrees(radians(longitude)+atan2(sin(radians({b}))*sin({d}/6371.0088D)*cos(radians(latitude)), "
          f"cos({d}/6371.0088D)-sin(radians(latitude))*sin({la})))")
    return f"degrees({la})", lo


@case("f03_destination", f"""
select event_id, round({dest('(event_id % 360)::double', '25D')[0]},6)+0.0D as lat,
  round({dest('(event_id % 360)::double', '25D')[1]},6)+0.0D as lon from v_tracks""")
def f03(v):
    p = geo.destination("latitude", "longitude", (F.col("event_id") % 360).cast("double"), F.lit(25.0))
    return _r(v.tracks, ["event_id"], lat=p["lat"], lon=p["lon"])


@case("f04_intermediate", f"""
select event_id, round(degrees(atan2(z, sqrt(x*x+y*y))),6)+0.0D as lat, round(degrees(atan2(y,x)),6)+0.0D as lon from (
 select event_id, a*cos(p1)*cos(l1)+b*cos(p2)*cos(l2) as x, a*cos(p1)*sin(l1)+b*cos(p2)*sin(l2) as y, a*sin(p1)+b*sin(p2) as z from (
 select *, sin(0.7D*d)/sin(d) as a, sin(0.3D*d)/sin(d) as b from (
 select event_id, radians(latitude) p1, radians(longitude) l1, radians(-66.5D) p2, radians(140.0D) l2,
  {hav('latitude', 'longitude', *P0, '1.0')} as d from v_tracks)))""")
def f04(v):
    p = geo.intermediate("latitude", "longitude", F.lit(-66.5), F.lit(140.0), F.lit(0.3))
    return _r(v.tracks, ["event_id"], lat=p["lat"], lon=p["lon"])


@case("f05_compass", """
select event_id, case t when 'N' then 0D when 'SW' then 225D when 'NE' then 45D when 'W' then 270D when '370' then 10D when '-45.5' then 314.5D end as deg
from (select event_id, case event_id % 7 when 0 then 'N' when 1 then 'SW' when 2 then 'NE' when 3 then 'W' when 4 then '370' when 5 then '-45.5' else 'up' end as t from events)""")
def f05(v):
    e = F.col("event_id") % 7
    t = (F.when(e == 0, "n").when(e == 1, " SW ").when(e == 2, "NE").when(e == 3, "w").when(e == 4, "370")
         .when(e == 5, "-45.5°").otherwise("up"))
    return v.table("events").select("event_id", geo.compass_to_deg(t).alias("deg"))


@case("f06_plane", """
select event_id, round(x,6)+0.0D as x, round(y,6)+0.0D as y, round(-70D+y/k,6)+0.0D as lat, round(160D+x/(k*cos(radians(-70D))),6)+0.0D as lon
from (select event_id, (longitude-160D)*k*cos(radians(-70D)) as x, (latitude+70D)*k as y, k from
 (select *, pi()*6371.0088D/180D as k from v_tracks))""")
def f06(v):
    d = v.tracks.withColumn("p", geo.to_plane("latitude", "longitude", F.lit(-70.0), F.lit(160.0)))
    d = d.withColumn("q", geo.from_plane("p.x", "p.y", F.lit(-70.0), F.lit(160.0)))
    return _r(d, ["event_id"], x="p.x", y="p.y", lat="q.lat", lon="q.lon")


@case("f07_vectors", """
select obs_time, latitude, longitude, round(sqrt(pow(coalesce(uo,0),2)+pow(coalesce(vo,0),2)),6)+0.0D as mag,
  round((degrees(atan2(uo,vo))+360D) % 360D,4)+0.0D as dir from v_grid""")
def f07(v):
    return v.grid.select("obs_time", "latitude", "longitude", rnd(geo.vec_mag("uo", "vo"), 6).alias("mag"),
                         rnd(geo.vec_dir_to("uo", "vo"), 4).alias("dir"))


@case("f08_sin_cos_doy", """
select event_id, round((sin(2*pi()*(dayofyear(obs_time)-1)/366D)+1)/2,6)+0.0D as sin_doy,
  round((cos(2*pi()*(dayofyear(obs_time)-1)/366D)+1)/2,6)+0.0D as cos_doy from v_tracks""")
def f08(v):
    d = v.tracks.withColumn("s", geo.sin_cos_doy("obs_time"))
    return _r(d, ["event_id"], sin_doy="s.sin_doy", cos_doy="s.cos_doy")


@case("f09_season", """
select event_id, case when month(d) in (12,1,2) then 'summer' when month(d) in (3,4,5) then 'autumn'
  when month(d) in (6,7,8) then 'winter' else 'spring' end as season
from (select event_id, cast(ts as date) + cast(event_id % 365 as int) as d from events)""")
def f09(v):
    d = v.table("events").withColumn("d", F.date_add(F.to_date("ts"), (F.col("event_id") % 365).cast("int")))
    return d.select("event_id", geo.season("d").alias("season"))


ICE = ("least(1D,greatest(0D,case when coalesce({c},0)<=0.15D then 0D when {c}<=0.4D then 0.2D*({c}-0.15D)/0.25D "
       "when {c}<=0.6D then 0.2D+0.4D*({c}-0.4D)/0.2D when {c}<=0.8D then 0.6D+0.3D*({c}-0.6D)/0.2D "
       "else 0.9D+0.1D*({c}-0.8D)/0.2D end))")
BERG = "coalesce(case when {d}<20D then 1D when {d}<30D then 1D-0.5D*({d}-20D)/10D when {d}<150D then 0.5D*(1D-({d}-30D)/120D) else 0D end,0D)"


@case("f10_sea_ice_risk", f"select obs_time, latitude, longitude, round({ICE.format(c='sic')},9)+0.0D as risk from v_grid")
def f10(v):
    return v.grid.select("obs_time", "latitude", "longitude", rnd(risk.sea_ice_risk("sic"), 9).alias("risk"))


@case("f11_iceberg_risk", f"""
select event_id, round({BERG.format(d='d')},6)+0.0D as risk, round(coalesce(case when d<20D then 1D when d<150D
  then 0.5D*greatest(0D,1D-(d-20D)/130D) else 0D end,0D),6)+0.0D as legacy
from (select event_id, value as d from events)""")
def f11(v):
    return _r(v.table("events"), ["event_id"], risk=risk.iceberg_risk("value"), legacy=risk.iceberg_risk_legacy("value"))


@case("f13_weather_severity", """
select event_id, round(least(1D,greatest(0D,value/30D)),6)+0.0D as wind_only,
  round(greatest(least(1D,greatest(0D,value/50D)),least(1D,greatest(0D,(event_id % 10)/8D))),6)+0.0D as wind_wave from events""")
def f13(v):
    return _r(v.table("events"), ["event_id"], wind_only=risk.weather_severity(wind_ms="value"),
              wind_wave=risk.weather_severity(wind_knots="value", wave_m=(F.col("event_id") % 10).cast("double")))


@case("f14_total_risk", f"""
select event_id, round(t,9)+0.0D as total, case when t>=0.8D then 'extreme' when t>=0.6D then 'high' when t>=0.3D then 'moderate' else 'low' end as level
from (select event_id, case when event_id % 17 = 0 then 1D else least(1D,greatest(0D,0.4D*{ICE.format(c='(event_id % 100)/100D')}
  +0.35D*{BERG.format(d='value')}+0.25D*least(1D,greatest(0D,value/30D)))) end as t from events)""")
def f14(v):
    d = v.table("events").withColumn("t", risk.total_risk(
        risk.sea_ice_risk((F.col("event_id") % 100) / 100.0), risk.iceberg_risk("value"),
        risk.weather_severity(wind_ms="value"), F.col("event_id") % 17 == 0))
    return d.select("event_id", rnd("t", 9).alias("total"), risk.risk_level("t").alias("level"))


@case("f14_legacy_risk", f"""
select event_id, round(t,9)+0.0D as total, case when t>=0.8D then 'extreme' when t>=0.6D then 'high' when t>=0.3D then 'moderate' else 'low' end as level
from (select event_id, case when event_id % 17 = 0 then 1D else least(1D,greatest(0D,0.35D*{ICE.format(c='(event_id % 100)/100D')}
  +0.3D*{BERG.format(d='value')}+0.2D*least(1D,greatest(0D,value/30D)))) end as t from events)""")
def f14_legacy(v):
    d = v.table("events").withColumn("t", risk.total_risk(
        risk.sea_ice_risk((F.col("event_id") % 100) / 100.0), risk.iceberg_risk("value"),
        risk.weather_severity(wind_ms="value"), F.col("event_id") % 17 == 0, LEGACY))
    return d.select("event_id", rnd("t", 9).alias("total"), risk.risk_level("t").alias("level"))


@case("f15_blocked", """
select event_id, (coalesce(c > l, false) or coalesce(c > 0.85D, false) or coalesce(value < 20D, false)) as blocked
from (select event_id, value, (event_id % 100)/100D as c, case user_id % 3 when 0 then 0.6D when 1 then 1.0D else 0.2D end as l from events)""")
def f15(v):
    u = F.col("user_id") % 3
    lim = F.when(u == 0, 0.6).when(u == 1, 1.0).otherwise(0.2)
    return v.table("events").select("event_id", risk.blocked((F.col("event_id") % 100) / 100.0, "value", lim, DEPLOYED).alias("blocked"))


@case("f16_level_rank", """
select level, count(*) as n, max(rank)::bigint as rank from (select case when r>=0.8D then 'extreme' when r>=0.6D then 'high' when r>=0.3D then 'moderate' else 'low' end as level,
 case when r>=0.8D then 4 when r>=0.6D then 3 when r>=0.3D then 2 else 1 end as rank from (select (event_id % 1000)/1000D as r from events)) group by 1""")
def f16(v):
    d = v.table("events").withColumn("level", risk.risk_level((F.col("event_id") % 1000) / 1000.0))
    return d.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max(risk.level_rank("level")).cast("long").alias("rank"))


@case("f17_waypoint_warnings", """
select event_id, len(list_filter([case when r>=0.6D then 1 end, case when b<18.52D then 1 end, case when c>0.6D then 1 end,
  case when c>=0.6D then 1 end, case when b<60D then 1 end], lambda x: x is not null)) as n,
  case when r>=0.8D then printf('Extreme risk (score %.2f) at (%.2f, %.2f).', r, la, lo)
       when r>=0.6D then printf('High risk (score %.2f) at (%.2f, %.2f).', r, la, lo) else '' end as first_risk
from (select event_id, -74.5D+user_id % 20 as la, (user_id % 180)*1D as lo, (event_id % 100)/100D as r, (event_id % 90)*1D as b, (event_id % 97)/100D as c from events)""")
def f17(v):
    e, u = F.col("event_id"), F.col("user_id")
    w = risk.waypoint_warnings(u % 20 - F.lit(74.5), (u % 180).cast("double"), (e % 100) / 100.0, (e % 90).cast("double"),
                               (e % 97) / 100.0, F.lit(18.52), F.lit(0.6), DEPLOYED)
    d = v.table("events").withColumn("w", w)
    first = F.coalesce(F.try_element_at(F.filter("w", lambda x: x.contains("risk (score")), F.lit(1)), F.lit(""))
    return d.select("event_id", F.size("w").cast("long").alias("n"), first.alias("first_risk"))


@case("f18_alert_severity", """
select event_id, case when value<5D then 'critical' when value<=15D then 'high' when value<=30D then 'medium' else 'low' end as berg,
  case when c>=0.8D then 'critical' when c>=0.6D then 'high' when c>=0.3D then 'medium' else 'low' end as ice,
  'iceberg-' || event_id || '-main-' || printf('%.4f', -70.5D - user_id % 7) || '-unavailable' as alert_id
from (select *, (event_id % 100)/100D as c from events)""")
def f18(v):
    d = v.table("events")
    return d.select("event_id", risk.alert_severity("iceberg", "value").alias("berg"),
                    risk.alert_severity("sea-ice", (F.col("event_id") % 100) / 100.0).alias("ice"),
                    risk.alert_id("iceberg", "event_id", F.lit("main"), F.lit(-70.5) - F.col("user_id") % 7,
                                  F.lit(None).cast("double")).alias("alert_id"))


@case("f19_distance_score", """
select event_id, round(least(100D,greatest(0D,(40D-value)/20D*100D)),4)+0.0D as score from events""")
def f19(v):
    return v.table("events").select("event_id", rnd(risk.distance_score("value", 20.0), 4).alias("score"))


@case("f20_fuel", """
select vessel_id, case when vessel_id % 3 = 0 then (case when abs(10D-s)<=abs(14D-s) then t else t*2D end)
    when vessel_id % 3 = 1 then (case when s>=16D then t*2D when s>=12D then t else t*0.5D end) else 1000D*24D*0.85D/1000D end as rate,
  round(100D/1.852D/s,6)+0.0D as hours
from (select vessel_id, cruise_speed_knots as s, tons_per_day as t from v_vessels)""")
def f20(v):
    d = v.vessels
    k, t = F.col("vessel_id") % 3, F.col("tons_per_day")
    m = (F.when(k == 0, F.create_map(F.lit("10"), t, F.lit("14"), t * 2.0))
         .when(k == 1, F.create_map(F.lit("slow_speed"), t * 0.5, F.lit("cruise_speed"), t, F.lit("max_speed"), t * 2.0)))
    r = risk.fuel_rate(m, "cruise_speed_knots", F.lit(12.0), F.lit(16.0), F.lit(1000.0))
    return d.select("vessel_id", r.alias("rate"), rnd(risk.travel_hours(F.lit(100.0), "cruise_speed_knots"), 6).alias("hours"))


@case("f22_cell_index", """
select event_id, cast(least(39,greatest(0,ceil((latitude+74.5D)/0.5D-0.5D))) as int) as i from v_tracks""")
def f22(v):
    return v.tracks.select("event_id", geo.cell_index("latitude", -74.5, 0.5, 40).alias("i"))


@case("f23_json", """
select event_id, json_extract_string(props,'$.k') is null as no_key, length(cast(event_id as varchar)) as n,
  '{"id":' || event_id || ',"type":"' || event_type || '"}' as packed from events""")
def f23(v):
    d = v.table("events")
    p = val.pack(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    back = val.unpack(p, "id long, type string")
    return d.select("event_id", F.get_json_object("props", "$.k").isNull().alias("no_key"),
                    F.length(back["id"].cast("string")).cast("long").alias("n"), p.alias("packed"))


@case("f25_preference_weights", """
select route_id, case p when 'recommended' then 0.6D when 'shortest' then 0D when 'safest' then 1D when 'fuel_efficient' then 0.3D else 0.85D end as safety,
 case p when 'recommended' then 0.4D when 'shortest' then 1D when 'safest' then 0D when 'fuel_efficient' then 0.7D else 0.15D end as distance
from (select route_id, ['recommended','shortest','safest','fuel_efficient','alternative'][1 + route_id % 5] as p from v_routes)""")
def f25(v):
    names = F.array(*[F.lit(x) for x in ("recommended", "shortest", "safest", "fuel_efficient", "alternative")])
    d = v.routes.withColumn("w", risk.preference_weights(F.element_at(names, (F.col("route_id") % 5 + 1).cast("int"))))
    return d.select("route_id", "w.safety", "w.distance")


@case("p04_iso_time", "select event_id, strftime(obs_time, '%Y-%m-%dT%H:%M:%SZ') as iso from v_tracks")
def p04(v):
    return v.tracks.select("event_id", val.iso_utc("obs_time").alias("iso"))


@case("p12_units", "select event_id, round(value/1.852D,9) as nm, round(value*1.852D,9) as km, round(value*0.539957D,9) as nm_import from events")
def p12(v):
    return v.table("events").select("event_id", rnd(val.km_to_nm("value"), 9).alias("nm"), rnd(val.nm_to_km("value"), 9).alias("km"),
                                    rnd(val.km_to_nm("value", True), 9).alias("nm_import"))


@case("p20_null_safe", """
select event_id, case when event_id % 11 in (0,1,2) then null else round(value/(event_id % 7 + 1)::double,6)+0.0D end as x from events""")
def p20(v):
    e = F.col("event_id") % 11
    x = (F.when(e == 0, F.lit(float("nan"))).when(e == 1, F.lit(float("inf"))).when(e == 2, F.lit(float("-inf")))
         .otherwise(F.col("value") / (F.col("event_id") % 7 + 1).cast("double")))
    return v.table("events").select("event_id", val.null_safe(x).alias("x"))


@case("p29_extract_ids", r"""
select doc_id, list_slice(list_filter(list_distinct_ordered, lambda x: x not in ('DEMO','LSTM','RF')), 1, 2) as ids from (
 select doc_id, list_filter(u, lambda x, i: list_position(u, x) = i) as list_distinct_ordered from (
 select doc_id, list_transform(regexp_extract_all(text, '(?i)([A-Z]{2,5}-?[A-Z]?[0-9]{3,4})', 0), lambda x: upper(x)) as u from documents))""")
def p29(v):
    return v.table("documents").select("doc_id", val.extract_ids("text").alias("ids"))


@case("p29_extract_ids_chat", r"""
select conv_id, turn, list_slice(list_filter(o, lambda x: x not in ('DEMO','LSTM','RF')), 1, 2) as ids from (
 select conv_id, turn, list_filter(u, lambda x, i: list_position(u, x) = i) as o from (
 select conv_id, turn, list_transform(regexp_extract_all(text, '(?i)([A-Z]{2,5}-?[A-Z]?[0-9]{3,4})', 0), lambda x: upper(x)) as u from conversations))""")
def p29b(v):
    return v.table("conversations").select("conv_id", "turn", val.extract_ids("text").alias("ids"))


@case("p31_clamp_wrap", """
select event_id, least(greatest(latitude*1.5D,-89D),-50D) as lat, round((((longitude*3D+180D) % 360D)+360D) % 360D-180D,6)+0.0D as lon from v_tracks""")
def p31(v):
    return v.tracks.select("event_id", geo.clamp_lat(F.col("latitude") * 1.5).alias("lat"),
                           rnd(geo.wrap_lon(F.col("longitude") * 3.0), 6).alias("lon"))


@case("x04_sql_functions", f"""
select event_id, round({hav('latitude', 'longitude', *P0)},6)+0.0D as km, round({brg('latitude', 'longitude', *P0)},6)+0.0D as deg,
  round((((longitude*3D+180D) % 360D)+360D) % 360D-180D,6)+0.0D as lon from v_tracks""")
def x04(v):
    geo.register_sql_functions(v.spark)
    return v.sql("""select event_id, round(geo_haversine_km(latitude, longitude, -66.5D, 140D), 6) + 0D as km,
        round(geo_bearing(latitude, longitude, -66.5D, 140D), 6) + 0D as deg, round(geo_wrap_lon(longitude * 3D), 6) + 0D as lon
        from v_tracks t""")
