"""Cleaning and data-quality queries."""
from pyspark.sql import functions as F

from floetrack.functions import geo
from floetrack.functions import values as val
from floetrack.functions.values import rnd
from floetrack.operators import clean as cl
from floetrack.operators import quality as q
from floetrack.operators.stats import attach
from floetrack.plans.registry import case, shared_cte
from floetrack.sources.readers import normalize_tracks

shared_cte("o_raw", """
select *, try_cast(time as {TS}) as t, try_cast(lat as double) as la, try_cast(lon as double) as lo from v_tracks_raw""")


def _typed(v):
    r = v.tracks_raw
    return r.withColumn("t", val.parse_time("time")).withColumn("la", val.to_number("lat")).withColumn("lo", val.to_number("lon"))


@case("s01_tracks_csv_normalize", """
select id as iceberg_id, t as timestamp, la as latitude, lo as longitude,
  round(length_km::double*0.539957D,6)+0.0D as length_nm, round(width_km::double*0.539957D,6)+0.0D as width_nm from o_raw where t is not null""")
def s01(v):
    return normalize_tracks(v.tracks_raw).withColumn("length_nm", rnd("length_nm", 6)).withColumn("width_nm", rnd("width_nm", 6))


@case("p02_drop_blank_ids", "select id, count(*) as n from v_tracks_raw where trim(id) <> '' group by 1")
def p02(v):
    return cl.drop_blank_ids(v.tracks_raw, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@case("p03_parse_time", "select t, count(*) as n from o_raw where t is not null group by 1")
def p03(v):
    return _typed(v).filter("t is not null").groupBy("t").agg(F.count(F.lit(1)).alias("n"))


@case("p05_to_number", "select la, count(*) as n from o_raw group by 1")
def p05(v):
    return _typed(v).groupBy("la").agg(F.count(F.lit(1)).alias("n"))


@case("p06_valid_coords", "select la, lo, count(*) as n from o_raw where la between -90 and 90 and lo between -180 and 180 group by 1,2")
def p06(v):
    return cl.valid_coords(_typed(v), "la", "lo").groupBy("la", "lo").agg(F.count(F.lit(1)).alias("n"))


@case("p07_clip_region", "select cell_ll_lat, count(*) as n from v_presence where cell_ll_lat between -75 and -55 or not (select bool_or(cell_ll_lat between -75 and -55) from v_presence) group by 1")
def p07(v):
    return cl.clip_region(v.presence, -75.0, -55.0, "cell_ll_lat").groupBy("cell_ll_lat").agg(F.count(F.lit(1)).alias("n"))


@case("p07_clip_never_empty", "select count(*) as n from v_presence")
def p07b(v):
    return cl.clip_region(v.presence, 80.0, 85.0, "cell_ll_lat").agg(F.count(F.lit(1)).alias("n"))


@case("p08_dedupe_rows", "select distinct obs_time, cell_ll_lat, flag from v_presence")
def p08(v):
    return cl.dedupe_rows(v.presence.select("obs_time", "cell_ll_lat", "flag"))


@case("p08_duplicate_count", "select (select count(*) from v_tracks_raw) - (select count(*) from (select distinct * from v_tracks_raw)) as n_duplicates")
def p08b(v):
    return cl.duplicate_count(v.tracks_raw)


@case("p09_dedupe_keys", """
select id, t, min_by(lat, (lat, lon, length_km, width_km)) as lat from o_raw where t is not null group by 1,2""")
def p09(v):
    d = _typed(v).filter("t is not null").select("id", "t", "lat", "lon", "length_km", "width_km")
    return cl.dedupe_keys(d, ["id", "t"], ["lat", "lon", "length_km", "width_km"]).select("id", "t", "lat")


def _rules():
    return {"invalid_time": F.col("t").isNull(),
            "invalid_coords": ~F.coalesce(F.col("la").between(-90, 90) & F.col("lo").between(-180, 180), F.lit(False)),
            "duplicates": F.lit(False), "region": ~F.col("la").between(-75, -55)}


shared_cte("o_rej", """
select *, case when t is null then 'invalid_time' when not coalesce(la between -90 and 90 and lo between -180 and 180, false)
  then 'invalid_coords' end as r from o_raw""")
shared_cte("o_rej2", "select *, row_number() over (partition by id,time,lat,lon,length_km,width_km) as k from o_rej where r is null")


@case("p10_clean_counts", """
select 'invalid_time' as reason, count(*) filter (where r='invalid_time') as n from o_rej
union all select 'invalid_coords', count(*) filter (where r='invalid_coords') from o_rej
union all select 'duplicates', count(*) filter (where k>1) from o_rej2
union all select 'region', count(*) filter (where k=1 and not la between -75 and -55) from o_rej2
union all select 'rows_before', count(*) from o_rej
union all select 'rows_after', count(*) filter (where k=1 and la between -75 and -55) from o_rej2""")
def p10(v):
    return cl.clean_tracks(_typed(v), _rules())[1]


@case("p10_clean_rows", "select id, t, la, lo from o_rej2 where k=1 and la between -75 and -55")
def p10b(v):
    return cl.clean_tracks(_typed(v), _rules())[0].select("id", "t", "la", "lo")


@case("p11_normalize_units", """
select l_orderkey, l_linenumber, round(case l_returnflag when 'A' then l_quantity*0.514444D when 'N' then l_quantity*0.277778D
  else l_quantity end,9)+0.0D as wind, (l_returnflag in ('A','N')) as unit_known from lineitem""")
def p11(v):
    m = F.col("l_returnflag")
    d = v.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("wind"),
                                   F.when(m == "A", "knots").when(m == "N", "km/h").otherwise("?").alias("unit"))
    out = cl.normalize_units_by_row(d, "wind", "unit", "wind")
    return out.select("l_orderkey", "l_linenumber", rnd("wind", 9).alias("wind"), "unit_known")


@case("p21_thin_dates", """
select event_id from v_tracks where cast(obs_time as date) in (select d from (select d, row_number() over (order by d)-1 as i, count(*) over () as n
  from (select distinct cast(obs_time as date) as d from v_tracks)) where i % greatest(1, n//5) = 0)""")
def p21(v):
    return cl.thin_dates(v.tracks, k=5).select("event_id")


@case("p25_search", """
select c_custkey from customer where contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'build') and c_nationkey = 5""")
def p25(v):
    return cl.search(v.table("customer"), " Build ", ["c_name", "c_mktsegment"], c_nationkey=5).select("c_custkey")


@case("p26_synthetic", """
select count(*) filter (where starts_with(id,'DEMO-')) as demo_ids, bool_or(starts_with(id,'DEMO-')) as synthetic
from (select case when user_id = 3 then 'DEMO-B3' else concat('B', user_id) end as id from events)""")
def p26(v):
    d = v.table("events").select(F.when(F.col("user_id") == 3, "DEMO-B3").otherwise(F.concat(F.lit("B"), "user_id")).alias("id"))
    n = d.agg(F.count_if(val.is_synthetic_row("id")).alias("demo_ids"))
    return attach(n, cl.is_synthetic(d, iceberg_id="id"))


@case("p27_first_of_day", """
select cast(obs_time as date) as date, iceberg_id, 'length_nm' as variable, round(arg_min(length_nm,(obs_time,length_nm)),6) as value from v_tracks group by 1,2
union all select cast(obs_time as date), iceberg_id, 'width_nm', round(arg_min(width_nm,(obs_time,width_nm)),6) from v_tracks group by 1,2""")
def p27(v):
    out = cl.first_of_day(v.tracks, ["iceberg_id"], ["length_nm", "width_nm"])
    return out.select("date", "iceberg_id", "variable", rnd("value", 6).alias("value"))


@case("p28_ocean_cells", "select count(sic) as kept, count(*) - count(sic) as dropped from v_grid")
def p28(v):
    kept, dropped = cl.ocean_cells_only(v.grid, "sic", "uo")
    return attach(kept.agg(F.count(F.lit(1)).alias("kept")), dropped)


@case("p32_clamp_region", """
select event_id, least(greatest(latitude,-70D),-60D) as latitude, least(greatest(longitude,-100D),100D) as longitude,
  case when latitude < -70D or latitude > -60D or longitude < -100D or longitude > 100D then true else false end as moved from v_tracks""")
def p32(v):
    return cl.clamp_to_region(v.tracks, -70.0, -60.0, -100.0, 100.0).select(
        "event_id", "latitude", "longitude", F.col("note").isNotNull().alias("moved"))


shared_cte("o_class", """
select event_id, event_type as dataset, case when event_type='click' then 'synthetic_demo' when user_id % 2 = 0 then 'pipeline_data'
  else 'synthetic_demo' end as classification from events""")


def _classes(v):
    d = v.table("events")
    c = F.when(F.col("event_type") == "click", "synthetic_demo").when(F.col("user_id") % 2 == 0, "pipeline_data").otherwise("synthetic_demo")
    return d.select("event_id", F.col("event_type").alias("dataset"), c.alias("classification"))


@case("p33_prefer_real", "select event_id, dataset from o_class where classification = 'pipeline_data'")
def p33(v):
    return cl.prefer_real(_classes(v)).select("event_id", "dataset")


@case("p33_prefer_best", "select event_id, dataset from o_class where classification = 'pipeline_data' or dataset='click'")
def p33b(v):
    return cl.prefer_real(_classes(v), real_only=False).select("event_id", "dataset")


@case("p33_status", "select dataset, case when bool_or(classification='pipeline_data') then 'available' else 'unavailable' end as status from o_class group by 1")
def p33c(v):
    return cl.dataset_status(_classes(v))


@case("a03_coverage", """
select min(obs_time) as time_start, max(obs_time) as time_end, count(distinct obs_time) as n_times, min(latitude) as lat_min,
  max(latitude) as lat_max, count(distinct latitude) as n_lat, min(longitude) as lon_min, max(longitude) as lon_max,
  count(distinct longitude) as n_lon, count(*) as n_rows from v_grid""")
def a03(v):
    return q.coverage(v.grid)


@case("a03_coverage_tracks", """
select min(obs_time) as time_start, max(obs_time) as time_end, count(*) as n_rows, count(distinct iceberg_id) as n_entities from v_tracks""")
def a03b(v):
    return q.coverage(v.tracks, entity="iceberg_id").select("time_start", "time_end", "n_rows", "n_entities")


@case("a04_missing", """
select c as "column", m as missing, n as total, round(m*100D/n,2)+0.0D as missing_pct from (select unnest(['sic','uo','t2m']) as c,
 unnest([count(*)-count(sic),count(*)-count(uo),count(*)-count(t2m)]) as m, unnest([count(*),count(*),count(*)]) as n from v_grid)""")
def a04(v):
    return q.missing_stats(v.grid, ["sic", "uo", "t2m"])


@case("a05_range_stats", """
select 'sic' as variable, count(*) as total, count(*)-count(sic) as missing, round((count(*)-count(sic))*100D/count(*),2)+0.0D as missing_pct,
  round(min(sic),4)+0.0D as min, round(max(sic),4)+0.0D as max, round(avg(sic),4)+0.0D as mean,
  count(*) filter (where sic < 0.1D or sic > 0.9D) as out_of_range from v_grid""")
def a05(v):
    return q.range_stats(v.grid, "sic", 0.1, 0.9)


@case("a06_checks", """
select 'warning' as severity, 'MISSING_VALUES' as code, count(*)-count(sic) as n from v_grid
union all select 'warning','NON_FINITE', count(*)-count(sic) from v_grid
union all select 'error','COORD_OUT_OF_RANGE', count(*) filter (where latitude < -70 or latitude > -60) from v_grid
union all select 'error','FIELD_OUT_OF_RANGE', count(*) filter (where t2m < 260 or t2m > 290) from v_grid
union all select 'info','TIME_SPAN', count(*) from v_grid
union all select 'error','TIME_AFTER_RANGE', 1""")
def a06(v):
    g = v.grid
    parts = [q.check_missing(g, "sic"), q.check_numeric_range(g, "sic", 0.0, 1.0), q.check_coordinate_range(g, "latitude", -70.0, -60.0),
             q.check_numeric_range(g, "t2m", 260.0, 290.0), q.check_time_range(g, "2024-01-01", "2024-01-10")]
    return cl.union_all(*parts).select("severity", "code", "n")


@case("a07_validate_grid", """
select 'weather_surface' as dataset, 'error' as severity, 'FIELD_OUT_OF_RANGE' as code, count(*) filter (where u10 < -5 or u10 > 5) as n from v_grid
union all select 'weather_surface','error','REGION',1 union all select 'weather_surface','error','VARIABLE_MISSING',1
union all select 'weather_surface','error','UNITS',1""")
def a07(v):
    return q.validate_grid(v.grid, "weather_surface", {"u10": (-5.0, 5.0), "t2m": (150.0, 330.0), "gust": (0.0, 99.0)},
                           lat_band=(-70.0, -50.0), units={"t2m": ("K", "degC")}).select("dataset", "severity", "code", "n")


@case("a07_validate_sea_ice", """
select 'sea_ice' as dataset, 'warning' as severity, 'DEMO_DATA' as code, 1 as n union all select 'sea_ice','error','UNITS',1
union all select * from (select 'sea_ice','warning','NON_FINITE', count(*)-count(sic) as n from v_grid) where n > 0
union all select * from (select 'sea_ice','warning','MISSING_VALUES', count(*)-count(sic) as n from v_grid) where n > (select count(*)*0.01D from v_grid)""")
def a07c(v):
    d = v.grid.withColumnRenamed("sic", "sea_ice_concentration")
    return q.validate(d, "sea_ice", {"sea_ice_concentration": "percent"}, classification="synthetic_demo").select("dataset", "severity", "code", "n")


@case("a07_validate_ocean", """
select * from (select 'ocean_surface' as dataset, 'error' as severity, 'FIELD_OUT_OF_RANGE' as code, count(*) filter (where x<-5 or x>5) as n from (select uo*200 as x from v_grid)) where n > 0
union all select 'ocean_surface','error','VARIABLE_MISSING',1 union all select 'ocean_surface','error','VARIABLE_MISSING',1""")
def a07d(v):
    return q.validate(v.grid.withColumn("uo", F.col("uo") * 200), "ocean_surface").select("dataset", "severity", "code", "n")


@case("a08_dataset_status", """
select 'sea_ice' as dataset, 'valid' as status from v_grid group by 1 union all select 'ocean_surface', 'invalid' from v_grid group by 1""")
def a08b(v):
    d = v.grid.withColumnRenamed("sic", "sea_ice_concentration")
    issues = q.validate(d, "sea_ice").unionByName(q.validate(d, "ocean_surface"))
    return q.status_of(issues)


shared_cte("o_traw", "select id as iceberg_id, t as obs_time, la as latitude, lo as longitude, length_km::double as length_nm, width_km::double as width_nm from o_raw")


@case("a07_validate_tracks", """
select 'icebergs' as dataset, 'error' as severity, 'LAT_OUT_OF_RANGE' as code, count(*) filter (where latitude not between -90 and 90) as n from o_traw
union all select 'icebergs','warning','TIME_NA', count(*) filter (where obs_time is null) from o_traw""")
def a07b(v):
    d = _typed(v).select(F.col("id").alias("iceberg_id"), F.col("t").alias("obs_time"), F.col("la").alias("latitude"),
                         F.col("lo").alias("longitude"), val.to_number("length_km").alias("length_nm"), val.to_number("width_km").alias("width_nm"))
    return q.validate_tracks(d).select("dataset", "severity", "code", "n")


@case("a08_overall_status", """
select case max(case when e>200 then 3 when e>100 then 2 else 0 end) when 3 then 'invalid' when 2 then 'missing' when 1 then 'incomplete' else 'valid' end as overall_status
from (select event_type, count(*) % 300 as e from events group by 1)""")
def a08(v):
    c = v.table("events").groupBy("event_type").agg((F.count(F.lit(1)) % 300).alias("e"))
    s = c.withColumn("status", F.when(F.col("e") > 200, "invalid").when(F.col("e") > 100, "missing").otherwise("valid"))
    return q.overall_status(s)


@case("a09_qc_summary", """
select n_rows, n_duplicate_rows, unnest(['obs_time','sic','uo']) as "column", unnest([0, m, 0])::bigint as missing from (
 select count(*) as n_rows, count(*) - (select count(*) from (select distinct obs_time, sic, uo from v_grid)) as n_duplicate_rows, count(*)-count(sic) as m from v_grid)""")
def a09(v):
    return q.qc_summary(v.grid.select("obs_time", "sic", "uo")).drop("dtype")


@case("a10_feature_summary", """
select st as stale_rows, c as "column", m as missing, round(m*100D/n,2)+0.0D as missing_pct, round(mn,4)+0.0D as min, round(mx,4)+0.0D as max,
  round(av,4)+0.0D as mean, round(sd,4)+0.0D as std from (select count(*) filter (where sic is null) as st, count(*) as n, unnest(['sic','v10']) as c,
  unnest([count(*)-count(sic),count(*)-count(v10)]) as m, unnest([min(sic),min(v10)]) as mn, unnest([max(sic),max(v10)]) as mx,
  unnest([avg(sic),avg(v10)]) as av, unnest([stddev_samp(sic),stddev_samp(v10)]) as sd from v_grid)""")
def a10(v):
    g = v.grid.withColumn("s", F.col("sic").isNull().cast("int"))
    return q.feature_summary(g, ["sic", "v10"], ["s"])


@case("a11_cadence", """
select median(d)::double as cadence_hours from (select h - lag(h) over (order by h) as d from (select distinct floor(epoch_us(obs_time)/3.6e9D) as h from v_grid)) where d > 0""")
def a11(v):
    return q.cadence(v.grid)


@case("a11_cadence_tracks", """
select median(d)::double as cadence_hours from (select h - lag(h) over (order by h) as d from (select distinct floor(epoch_us(obs_time)/3.6e9D) as h from v_tracks)) where d > 0""")
def a11b(v):
    return q.cadence(v.tracks)


@case("a12_freshness", """
select 'sea_ice' as dataset, max(obs_time) as last_time, round((epoch_us(timestamp '2024-02-15')-epoch_us(max(obs_time)))/3.6e9D,4)+0.0D as age_hours,
  24D as cadence_hours, true as slow from v_grid""")
def a12(v):
    return q.freshness(v.grid, "2024-02-15", "sea_ice").withColumn("slow", F.col("note").startswith("Data cadence is 24.0")).drop("note")


@case("a34_verify", """
select 'vessel' as dataset, count(*) as rows, min(cell_ll_lat) as latitude_min, max(cell_ll_lat) as latitude_max,
  count(distinct flag) as n_flag, count(distinct geartype) as n_geartype,
  count(*) - (select count(*) from (select distinct cell_ll_lat, cell_ll_lon from v_presence)) as duplicate_cells, 'WARNING' as status from v_presence""")
def a34(v):
    d = v.presence.withColumnsRenamed({"cell_ll_lat": "latitude", "cell_ll_lon": "longitude"})
    return q.verify_dataset(d, "vessel", ["timestamp", "latitude", "longitude"]).select(
        "dataset", "rows", "latitude_min", "latitude_max", "n_flag", "n_geartype", "duplicate_cells", "status")


@case("a40_readiness", """
select 'events' as resource, count(*) > 0 as ready, 'degraded' as overall from events union all select 'lineitem', count(*) > 0, 'degraded' from lineitem
union all select 'empty', count(*) > 0, 'degraded' from events where event_id < 0""")
def a40(v):
    return q.readiness({"events": v.table("events"), "lineitem": v.table("lineitem"), "empty": v.table("events").filter("event_id < 0")})


@case("a41_check_tabular", """
select 'LAT_INVALID' as code, count(*) filter (where la is not null and not la between -90 and 90) as n from o_raw
union all select 'OUT_OF_BAND', count(*) filter (where la between -90 and 90 and not la between -75 and -55) from o_raw
union all select 'LAT_MISSING', count(*) filter (where la is null) from o_raw
union all select 'DUPLICATE', (select count(*) from o_raw where la between -90 and 90) - (select count(*) from (select distinct lat, lon from o_raw where la between -90 and 90))
union all select 'ON_LAND_MISSING', 1""")
def a41(v):
    d = v.tracks_raw.withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    return q.check_tabular(d, "iceberg", ["latitude", "longitude"], (-75.0, -55.0)).select("code", "n")


@case("u01_union_all", """
select obs_time, flag, hours, null as iceberg_id from v_presence union all select obs_time, null, null, iceberg_id from v_tracks""")
def u01(v):
    return cl.union_all(v.presence.select(F.col("obs_time").cast("timestamp_ntz").alias("obs_time"), "flag", "hours"),
                        v.tracks.select("obs_time", "iceberg_id"))


@case("u02_union_distinct", "select distinct iceberg_id from v_tracks")
def u02(v):
    t = v.tracks.select("iceberg_id")
    return cl.union_distinct(t, t, ["iceberg_id"])


@case("u03_unseen", "select event_id from events where event_id not in (select event_id from events where event_type = 'click')")
def u03(v):
    e = v.table("events")
    return cl.unseen(e.select("event_id"), e.filter("event_type = 'click'"), "event_id")


@case("u04_keep_dates", "select event_id from events where cast(ts as date) in (select cast(o_orderdate as date) from orders) or cast(ts as date) in (select cast(ts as date) from events where event_type = 'signup')")
def u04(v):
    e = v.table("events")
    return cl.keep_dates(e, e.filter("event_type = 'signup'").select(F.to_date("ts").alias("date")).unionByName(
        v.table("orders").select(F.to_date("o_orderdate").alias("date"))), "ts").select("event_id")


@case("j26_select_ids", "select s_suppkey from supplier where s_suppkey in (select o_custkey from orders)")
def j26(v):
    ids = v.table("orders").select(F.col("o_custkey").alias("s_suppkey"))
    return cl.select_ids(v.table("supplier").select("s_suppkey"), ids, "s_suppkey")[0]


@case("j26_not_found", "select distinct o_custkey as s_suppkey from orders where o_custkey not in (select s_suppkey from supplier)")
def j26b(v):
    ids = v.table("orders").select(F.col("o_custkey").alias("s_suppkey"))
    return cl.select_ids(v.table("supplier").select("s_suppkey"), ids, "s_suppkey")[1]


@case("p19_project_schema", "select iceberg_id, round(length_nm,6) as length_nm, null as draft_m from v_tracks")
def p19(v):
    return cl.project_schema(v.tracks, {"iceberg_id": "string", "length_nm": "double", "draft_m": "double"}).withColumn(
        "length_nm", rnd("length_nm", 6))


@case("p01_standardize", "select count(distinct latitude) as n_lat, count(distinct longitude) as n_lon, min(obs_time) as first_time from v_grid")
def p01(v):
    d = v.grid.withColumnsRenamed({"latitude": "lat", "longitude": "x", "obs_time": "valid_time"})
    return cl.standardize_columns(d).agg(F.count_distinct("latitude").alias("n_lat"), F.count_distinct("longitude").alias("n_lon"),
                                         F.min("time").alias("first_time"))


@case("p30_distinct_order", "select user_id, len(list(distinct event_type)) as n from events group by 1")
def p30(v):
    d = v.table("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    # doubled list per user: each kind twice; at most the number of event kinds
    d = d.groupBy("user_id").agg(F.collect_list("event_type").alias("k"))
    return d.select("user_id", F.size(val.distinct_keep_order(F.concat("k", "k"))).cast("long").alias("n"))
