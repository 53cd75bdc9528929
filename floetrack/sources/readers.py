"""Sources: tracks, grids, fleet presence, bathymetry, dimensions, inventories."""
import os
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from floetrack.config import KM_TO_NM_IMPORT, REGION_LAT, TRACK_ALIASES, TRACK_COLUMNS
from floetrack.functions.values import file_date, parse_time, to_number
from floetrack.operators.clean import present_columns
from floetrack.operators.grids import CELL
from floetrack.sources.documents import SPLIT_BYTES, read_records

FORMATS = {".csv": "csv", ".geojson": "geojson", ".json": "json", ".parquet": "parquet"}

OCEAN_SCHEMA = ("timestamp timestamp_ntz, latitude double, longitude double, depth double, thetao double, so double, uo double, "
                "vo double, siconc double, source_file string, source_format string")
WEATHER_SCHEMA = ("timestamp timestamp_ntz, latitude double, longitude double, wind_u double, wind_v double, wind_speed double, "
                  "wind_direction double, air_temperature double, pressure double, source_file string, source_format string")


def _text(spark, path, sep=","):
    """CSV with every column read as text under its own header name.

    Files of a folder are grouped by their own header line and each group is read under it; groups are united by name, so
    files may order their columns differently or lack some.
    """
    first = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                           F.monotonically_increasing_id().alias("row"))
    heads = (first.filter("at = 0 and trim(value) <> ''").groupBy("file")
             .agg(F.min_by("value", "row").alias("head"))
             .groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("head").collect())     # one row per distinct header
    if not heads:
        return spark.read.option("header", True).option("sep", sep).csv(path)
    parts = []
    for h in heads:
        names = spark.read.option("header", True).option("sep", sep).csv(h["files"][0]).columns
        parts.append(spark.read.option("header", True).option("sep", sep).schema(
            T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(h["files"]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def normalize_tracks(raw):
    """Text columns to the track schema: km sizes to nautical miles first, then aliases, types; rows without a time are dropped."""
    df = raw.withColumnsRenamed({c: c.strip().lower() for c in raw.columns if c != c.strip().lower()})
    for c in ("length", "width"):
        if f"{c}_km" in df.columns and f"{c}_nm" not in df.columns:
            df = df.withColumn(f"{c}_nm", to_number(f"{c}_km") * KM_TO_NM_IMPORT)
    have = set(df.columns)
    ren, taken = {}, set(have)
    for a, t in TRACK_ALIASES.items():
        if a in have and t not in taken:
            ren[a] = t
            taken.add(t)
    df = df.withColumnsRenamed(ren)
    _, lack = present_columns(df, TRACK_COLUMNS)
    if lack:
        raise ValueError(f"missing required columns: {lack}")
    return df.select(
        F.col("iceberg_id").cast("string").alias("iceberg_id"), parse_time("timestamp").alias("timestamp"),
        *[to_number(c).alias(c) for c in TRACK_COLUMNS[2:]]).filter("timestamp is not null")


def read_tracks_csv(spark, path):
    return normalize_tracks(_text(spark, path))


FEATURE = "struct<properties:map<string,string>,geometry:struct<coordinates:array<double>>>"
GEOJSON = f"features array<{FEATURE}>"


def tracks_from_features(docs):
    """Rows of FeatureCollection documents (``features`` arrays), see ``feature_tracks``."""
    return feature_tracks(docs.select(F.explode("features").alias("f")))


def feature_tracks(features):
    """Rows of features (``f``): property fallbacks for id, time and size; features without coordinates or readable time are
    left out."""
    f = features.select("f.properties", "f.geometry.coordinates")
    p = lambda *names: F.coalesce(*[F.try_element_at("properties", F.lit(n)) for n in names])
    size = lambda s: F.coalesce(to_number(p(f"{s}_nm")), to_number(p(f"{s}_km")) * KM_TO_NM_IMPORT)
    return f.filter(F.size("coordinates") >= 2).select(
        F.coalesce(p("iceberg_id", "id"), F.lit("unknown")).alias("iceberg_id"),
        parse_time(p("timestamp", "time", "observation_time")).alias("timestamp"),
        F.col("coordinates")[1].alias("latitude"), F.col("coordinates")[0].alias("longitude"),
        size("length").alias("length_nm"), size("width").alias("width_nm")).filter("timestamp is not null")


def read_tracks_geojson(spark, path, split_bytes=SPLIT_BYTES):
    """GeoJSON points; a document larger than ``split_bytes`` is read by many tasks (None: Spark's reader, a task per document)."""
    if split_bytes is None:
        return tracks_from_features(spark.read.schema(GEOJSON).option("multiLine", True).json(path))
    return feature_tracks(read_records(spark, path, "features", split_bytes).select(F.from_json("value", FEATURE).alias("f")))


def _json_text(spark, path, multiline=True):
    return spark.read.option("multiLine", multiline).option("primitivesAsString", True).json(path)


def read_tracks_json(spark, path, multiline=True):
    """JSON array of records per file, or one record per line (splittable) with ``multiline=False``."""
    return normalize_tracks(_json_text(spark, path, multiline))


def read_tracks_parquet(spark, path):
    raw = spark.read.parquet(path)
    return normalize_tracks(raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns]))


def read_tracks(spark, path, fmt=None):
    """Read tracks by suffix; FeatureCollections under a ``.json`` path are read as GeoJSON, record arrays beside them as records."""
    fmt = fmt or FORMATS.get(os.path.splitext(path)[1].lower())
    if fmt is None:
        raise ValueError(f"unknown track format: {path}")
    if fmt == "json":
        docs = spark.read.schema("features string").option("multiLine", True).json(path)
        kinds = docs.agg(F.max(F.col("features").isNotNull()).alias("geo"), F.max(F.col("features").isNull()).alias("records")).first()
        if kinds["geo"] and kinds["records"]:      # each reader passes over the documents of the other kind: they hold no time there
            raw = _json_text(spark, path)
            if not {c.strip().lower() for c in raw.columns} & {*TRACK_COLUMNS, *TRACK_ALIASES}:      # the others hold no field of a record
                return read_tracks_geojson(spark, path)
            return normalize_tracks(raw).unionByName(read_tracks_geojson(spark, path), allowMissingColumns=True)
        fmt = "geojson" if kinds["geo"] else "json"
    return {"csv": read_tracks_csv, "geojson": read_tracks_geojson, "json": read_tracks_json,
            "parquet": read_tracks_parquet}[fmt](spark, path)


def read_grid(spark, path, columns=None, latest=False, time_col="obs_time", partition=None):
    """Partitioned grid table; ``latest`` keeps the newest partition (pruned at planning time), then its newest time."""
    from floetrack.operators.grids import latest_snapshot
    df = spark.read.parquet(path)
    if latest and partition:
        newest = df.agg(F.max(partition).alias("m")).first()["m"]
        df = df.filter(F.col(partition) == newest)
    if latest:
        df = latest_snapshot(df, time_col)
    return df.select(*columns) if columns else df


def _long_table(spark, path, schema):
    if os.path.splitext(path.rstrip("/"))[1] == ".parquet":
        return spark.read.parquet(path)
    return spark.read.option("header", True).schema(schema).csv(path)


def read_ocean(spark, path):
    return _long_table(spark, path, OCEAN_SCHEMA)


def read_weather(spark, path):
    return _long_table(spark, path, WEATHER_SCHEMA)


def fleet_presence(raw, lat_min=REGION_LAT[0], lat_max=REGION_LAT[1], distinct=True):
    """Presence rows from text columns: renamed cells, region clip, exact duplicates removed; None without the cell columns."""
    if not {"cell_ll_lat", "cell_ll_lon"} <= set(raw.columns):
        return None
    df = raw.withColumnsRenamed({"date": "timestamp", "cell_ll_lat": "latitude", "cell_ll_lon": "longitude"})
    df = df.withColumn("latitude", to_number("latitude")).withColumn("longitude", to_number("longitude"))
    if "timestamp" in df.columns:
        df = df.withColumn("timestamp", parse_time("timestamp"))
    for c in ("hours", "fishing_hours"):
        if c in df.columns:
            df = df.withColumn(c, to_number(c))
    out = df.filter(F.col("latitude").between(lat_min, lat_max))
    return out.dropDuplicates() if distinct else out


def read_fleet_presence(spark, paths):
    """Union of monthly files without repeated rows; files without the cell columns are skipped. Sort when writing, if at all."""
    parts = [p for p in (fleet_presence(_text(spark, x), distinct=False) for x in paths) if p is not None]
    if not parts:
        raise ValueError("no fleet presence file has the cell columns")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).dropDuplicates()


def file_inventory(spark, root):
    """Dataset (first folder), relative path, size, extension and format of every file; contents are not read."""
    base = root.rstrip("/")
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
         .select("path", "length", "modificationTime"))
    rel = F.regexp_replace("path", "^.*?" + base.replace(".", "\\.") + "/", "")
    ext = F.lower(F.regexp_extract(rel, r"(\.[A-Za-z0-9]+)$", 1))
    labels = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return f.select(F.when(rel.contains("/"), F.substring_index(rel, "/", 1)).otherwise(F.lit("")).alias("dataset"),
                    rel.alias("relative_path"), F.col("length").alias("size_bytes"), ext.alias("extension"),
                    F.coalesce(F.try_element_at(labels, ext), F.lit("other")).alias("format"))


def schema_profile(spark, path, nrows=50):
    """Column names, inferred types and a few sample values of a delimited file."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)        # types from all rows
    head = df.limit(nrows)
    cols = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("dtype"),
                     F.slice(F.col(f"_s{i}"), 1, 5).alias("sample")) for i, (c, t) in enumerate(df.dtypes)]
    one = head.agg(*[F.collect_list(F.col(c).cast("string")).alias(f"_s{i}") for i, c in enumerate(df.columns)])  # nrows values
    return one.select(F.explode(F.array(*cols)).alias("s")).select("s.*")


def dated_files(df):
    """Add the date in the name of the file each row came from."""
    return df.withColumn("file_date", file_date(F.col("_metadata.file_name")))


def read_ocean_cells(spark, path, grid=None):
    """Mask from parallel arrays of ocean cells: cells of ``grid`` (or of the arrays' own axes) not listed are land."""
    m = spark.read.schema("latitude array<double>, longitude array<double>").option("multiLine", True).json(path)
    ocean = (m.select(F.explode(F.arrays_zip("latitude", "longitude")).alias("c")).select("c.*").distinct()
             .filter("latitude is not null and longitude is not null"))
    if grid is None:
        # product of the two axes: every latitude row is paired with the longitude axis held as one array
        lons = ocean.agg(F.sort_array(F.collect_set("longitude")).alias("_lons"))     # one axis
        from floetrack.operators.stats import attach
        grid = attach(ocean.select("latitude").distinct(), lons).select("latitude", F.explode("_lons").alias("longitude"))
    return (grid.select(*CELL).join(ocean.withColumn("_o", F.lit(True)), CELL, "left")
            .select(*CELL, F.col("_o").isNull().alias("is_land")))


def read_dims(spark, path, key):
    """Dimension rows: the array under ``key`` of a JSON document."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.explode(key).alias("d")).select("d.*")


def read_navigation(spark, path, key="navigation"):
    """Navigation thresholds document as one row of nested columns."""
    return spark.read.option("multiLine", True).json(path).select(f"{key}.*")
