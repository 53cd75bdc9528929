"""Source and sink queries: tables are written in the forms users bring and read back."""
from pyspark.sql import functions as F

from floetrack.functions.values import file_date, rnd
from floetrack.operators.stats import attach
from floetrack.plans.registry import case
from floetrack.plans.scratch import scratch
from floetrack.sources import readers as rd
from floetrack.sources import writers as wr


@case("s01_read_tracks_csv", """
select nullif(id,'') as iceberg_id, t as timestamp, la as latitude, lo as longitude, round(length_km::double*0.539957D,6)+0.0D as length_nm from o_raw where t is not null""")
def s01(v):
    out = scratch(v.spark) + "/tracks.csv"
    v.tracks_raw.write.option("header", True).csv(out)
    return rd.read_tracks(v.spark, out).select("iceberg_id", "timestamp", "latitude", "longitude", rnd("length_nm", 6).alias("length_nm"))


@case("s02_read_geojson", """
select concat('B', user_id) as iceberg_id, ts as timestamp, -60.5D as latitude, (user_id % 180)*1D as longitude, round((event_id % 40)*0.539957D,6)+0.0D as length_nm from events where event_id % 13 <> 0""")
def s02(v):
    out = scratch(v.spark) + "/tracks.geojson"
    e = v.table("events")
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(F.concat(F.lit("B"), "user_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"),
                             (F.col("event_id") % 40).cast("string").alias("length_km")).alias("properties"),
                    F.struct(F.when(F.col("event_id") % 13 != 0, F.array((F.col("user_id") % 180).cast("double"), F.lit(-60.5))).alias("coordinates")).alias("geometry"))
    doc = e.withColumn("part", F.floor(F.col("event_id") / 500)).groupBy("part").agg(F.collect_list(feat).alias("features"))     # 500 per document
    doc.select(F.lit("FeatureCollection").alias("type"), "features").repartition(4).write.option("ignoreNullFields", True).json(out + "/lines")
    return rd.read_tracks_geojson(v.spark, out + "/lines", split_bytes=1 << 20).select("iceberg_id", "timestamp", "latitude", "longitude", rnd("length_nm", 6).alias("length_nm"))


@case("s03_read_json", "select iceberg_id, obs_time as timestamp, round(latitude,6)+0.0D as latitude from v_tracks")
def s03(v):
    out = scratch(v.spark) + "/tracks.json"
    (v.tracks.select(F.col("iceberg_id").alias("id"), F.date_format("obs_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), F.col("latitude").alias("lat"),
                     F.col("longitude").alias("lon"), "length_nm", "width_nm").write.json(out))
    return rd.read_tracks_json(v.spark, out, multiline=False).select("iceberg_id", "timestamp", rnd("latitude", 6).alias("latitude"))


@case("s04_read_parquet", "select iceberg_id, obs_time as timestamp, round(longitude,6)+0.0D as longitude from v_tracks")
def s04(v):
    out = scratch(v.spark) + "/tracks.parquet"
    v.tracks.withColumnRenamed("obs_time", "timestamp").write.parquet(out)
    return rd.read_tracks(v.spark, out).select("iceberg_id", "timestamp", rnd("longitude", 6).alias("longitude"))


@case("s05_read_grid_latest", "select latitude, longitude, sic from o_last")
def s05(v):
    out = scratch(v.spark) + "/grid"
    wr.write_partitioned(v.grid, out, {"yyyymm": wr.month_key()})
    return rd.read_grid(v.spark, out, ["latitude", "longitude", "sic"], latest=True, partition="yyyymm")


@case("s06_read_weather", "select obs_time as timestamp, latitude, longitude, u10 as wind_u, v10 as wind_v, t2m as air_temperature, msl as pressure from v_grid")
def s06(v):
    out = scratch(v.spark) + "/weather"
    g = v.grid.select(F.col("obs_time").alias("timestamp"), "latitude", "longitude", F.col("u10").alias("wind_u"), F.col("v10").alias("wind_v"),
                      F.hypot("u10", "v10").alias("wind_speed"), F.lit(0.0).alias("wind_direction"), F.col("t2m").alias("air_temperature"),
                      F.col("msl").alias("pressure"), F.lit("f").alias("source_file"), F.lit("csv").alias("source_format"))
    g.write.option("header", True).csv(out)
    return rd.read_weather(v.spark, out).select("timestamp", "latitude", "longitude", "wind_u", "wind_v", "air_temperature", "pressure")


@case("s07_fleet_presence", """
select distinct o_orderdate::date::timestamp as timestamp, cell_ll_lat as latitude, cell_ll_lon as longitude, flag from (select obs_time as o_orderdate, cell_ll_lat, cell_ll_lon, flag from v_presence) where cell_ll_lat between -90 and -50""")
def s07(v):
    base = scratch(v.spark)
    p = v.presence.select(F.col("obs_time").cast("date").alias("date"), "cell_ll_lat", "cell_ll_lon", "flag")
    p.filter(F.month("date") <= 6).write.option("header", True).csv(base + "/a.csv")
    p.filter(F.month("date") > 6).write.option("header", True).csv(base + "/b.csv")
    p.select("flag").distinct().write.option("header", True).csv(base + "/notes.csv")
    return rd.read_fleet_presence(v.spark, [base + "/a.csv", base + "/b.csv", base + "/notes.csv"])


@case("s09_file_date", "select event_id, cast(ts as date)::timestamp as d from events")
def s09(v):
    name = F.concat(F.lit("mosaic_"), F.date_format("ts", "yyyyMMdd"), F.lit("_v5.nc"))
    return v.table("events").select("event_id", file_date(name).alias("d"))


@case("s10_file_inventory")
def s10(v):
    return rd.file_inventory(v.spark, v.dir).select("dataset", "relative_path", "size_bytes", "extension", "format")


@case("s11_schema_profile")
def s11(v):
    out = scratch(v.spark) + "/orders.csv"
    v.table("orders").write.option("header", True).csv(out)
    return rd.schema_profile(v.spark, out).select("position", "column", "dtype")


@case("s12_write_partitioned", """
select cast(strftime(obs_time,'%Y%m') as int) as yyyymm, count(*) as n, round(sum(uo),5)+0.0D as total from v_grid group by 1""")
def s12(v):
    out = scratch(v.spark) + "/grid"
    wr.write_partitioned(v.grid, out, {"yyyymm": wr.month_key()}, max_rows=5000)
    return v.spark.read.parquet(out).groupBy("yyyymm").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("uo"), 5).alias("total"))


@case("s12_lat_band", "select cast(floor(latitude/10D) + 95 as int) as band, count(*) as n from v_cells group by 1")
def s12b(v):
    out = scratch(v.spark) + "/cells"
    wr.write_partitioned(v.cells, out, {"band": wr.lat_band_key()})
    return v.spark.read.parquet(out).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@case("s13_latest_snapshot", """
select event_type as source, event_id from events e where ts = (select max(ts) from events x where x.event_type = e.event_type)""")
def s13(v):
    out = scratch(v.spark) + "/latest"
    d = v.table("events").withColumnsRenamed({"event_type": "source", "ts": "obs_time"})
    wr.write_latest_snapshot(d, out)
    return v.spark.read.parquet(out).select("source", "event_id")


@case("s14_manifest", "select 'events' as dataset, 'events.parquet' as file, count(*) as rows from events")
def s14(v):
    return wr.manifest(v.table("events"), "events")


@case("s15_write_report", "select count(*) as n_rows, count(distinct iceberg_id) as n_entities from v_tracks")
def s15(v):
    from floetrack.operators.quality import coverage
    out = scratch(v.spark) + "/report"
    wr.write_report(coverage(v.tracks, entity="iceberg_id"), out)
    return v.spark.read.json(out).select("n_rows", "n_entities")


@case("s16_write_splits", """
select case when r <= round_even(n*0.70D,0) then 'train' when r <= round_even(n*0.70D,0)+round_even(n*0.15D,0) then 'val' else 'test' end as split, count(*) as n
from (select row_number() over (order by obs_time, iceberg_id, event_id) as r, count(*) over () as n from v_tracks) group by 1""")
def s16(v):
    from floetrack.operators.tracks import chrono_split
    out = scratch(v.spark) + "/splits"
    wr.write_splits(chrono_split(v.tracks), out)
    return v.spark.read.parquet(out).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@case("s19_ocean_cells", "select latitude, longitude, is_land from v_cells")
def s19(v):
    out = scratch(v.spark) + "/mask"
    ocean = v.cells.filter("not is_land")
    # the mask document holds one grid's ocean cells in two arrays
    ocean.agg(F.collect_list("latitude").alias("latitude"), F.collect_list("longitude").alias("longitude")).write.json(out)
    return rd.read_ocean_cells(v.spark, out, v.cells)


@case("s20_read_dims", "select place_id, name, kind from v_places")
def s20(v):
    out = scratch(v.spark) + "/dims"
    p = v.places.select("place_id", "name", "kind")
    p.agg(F.collect_list(F.struct("place_id", "name", "kind")).alias("places")).write.json(out)      # 25 configured places
    return rd.read_dims(v.spark, out, "places").select("place_id", "name", "kind")
