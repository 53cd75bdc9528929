"""Inputs that once gave wrong or partial results."""
import pytest
from pyspark.sql import functions as F

from floetrack.operators import grids as g
from floetrack.operators import joins as jn
from floetrack.operators import ml
from floetrack.operators.axes import grid_axes
from floetrack.operators.clean import prefer_real
from floetrack.operators.metrics import regression_metrics
from floetrack.operators.stats import exact_median
from floetrack.sources import readers as rd
from floetrack.sources import writers as wr
from floetrack.streaming import jobs


def test_csv_files_with_other_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("iceberg_id,timestamp,latitude,longitude,length_nm,width_nm\nA,2024-01-01T00:00:00Z,-60,10,1,1\n")
    (tmp_path / "b.csv").write_text("iceberg_id,longitude,latitude,timestamp,width_nm,length_nm\nB,20,-61,2024-01-02T00:00:00Z,1,1\n")
    got = {r.iceberg_id: (r.latitude, r.longitude) for r in rd.read_tracks_csv(spark, str(tmp_path)).collect()}
    assert got == {"A": (-60.0, 10.0), "B": (-61.0, 20.0)}


def test_types_come_from_all_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x,y\n" + "".join(f"{i},1\n" for i in range(500)) + "late,1\n")
    assert {r["column"]: r["dtype"] for r in rd.schema_profile(spark, str(tmp_path)).collect()} == {"x": "string", "y": "int"}


def test_json_format_is_found_in_any_document(spark, tmp_path):
    p = tmp_path / "t.json"
    p.mkdir()
    for i in range(30):
        (p / f"{i:02d}.json").write_text("{}")
    (p / "99.json").write_text('{"type":"FeatureCollection","features":[{"properties":{"id":"A","time":"2024-01-01T00:00:00Z"},"geometry":{"coordinates":[1,-60]}}]}')
    assert rd.read_tracks(spark, str(p)).count() == 1


def test_long_regular_axis_needs_no_list(spark):
    t = spark.range(200_100).select(F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("obs_time"))
    ax = grid_axes(t, ["obs_time"])["obs_time"]
    assert ax.regular and ax.n == 200_100 and ax.step == 3.6e9
    p = spark.createDataFrame([(7_300,)], "s long").select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("at"))
    assert ax.index_of(p, "at", "i").first()["i"] == 2


def test_axis_with_a_far_outlier(spark):
    values = [i * 0.5 + (0.01 if i == 3 else 0) for i in range(200)] + [1e5]
    ax = grid_axes(spark.createDataFrame([(float(v),) for v in values], "latitude double"), ["latitude"])["latitude"]
    assert not ax.regular
    bins = {}
    for r in ax.ranges(spark).collect():
        bins[r["bin"]] = bins.get(r["bin"], 0) + 1
    assert sum(bins.values()) <= 8 * len(values)
    q = spark.createDataFrame([(x,) for x in (-5.0, 0.2, 1.51, 60.1, 99.4, 3e4, 9e4, 2e5)], "x double")
    got = {r["x"]: r["i"] for r in ax.index_of(q, "x", "i").collect()}
    assert got == {x: min(range(len(values)), key=lambda i: (abs(values[i] - x), i)) for x in got}


def test_sparse_grid_sends_unknown_cells_to_the_search(spark):
    cells = [(-60.0 + i, 10.0 + j, False) for i in range(4) for j in range(4) if (i, j) != (1, 1)]
    grid = spark.createDataFrame(cells, "latitude double, longitude double, is_land boolean")
    p = spark.createDataFrame([(1, -59.0, 11.0), (2, -60.0, 10.0)], "id int, latitude double, longitude double")
    got = {r["id"]: r for r in jn.nearest_navigable(p, "id", grid).collect()}
    assert got[1]["nav_lat"] is not None and got[1]["nav_km"] > 0 and got[2]["nav_km"] == 0


def test_groups_without_a_name_stay(spark):
    d = spark.createDataFrame([(None, 1, 150.0), (None, 2, 50.0), ("a", 1, 0.5)], "source string, obs_time int, v double")
    assert {(r.source, r.obs_time) for r in wr.last_rows(d).collect()} == {(None, 2), ("a", 1)}
    assert g.autoscale_fraction(d, "v", "source").count() == 3
    assert {r["source"]: r["median"] for r in exact_median(d, "v", ["source"]).collect()} == {None: 100.0, "a": 0.5}
    r = spark.createDataFrame([(None, "real"), (None, "demo"), ("a", "demo")], "dataset string, classification string")
    assert prefer_real(r, "dataset", real_only=False).count() == 2


def test_small_units_keep_their_scores(spark):
    d = spark.createDataFrame([(i * 1e-9, i * 1e-9 + (i % 2) * 1e-11) for i in range(50)], "pred double, actual double")
    r = regression_metrics(d).first()
    assert r["r2"] > 0.99 and r["correlation"] > 0.99
    c = regression_metrics(d.withColumn("actual", F.lit(0.3))).first()
    assert c["r2"] is None and c["correlation"] is None


def test_forest_predicts_rows_with_missing_features(spark):
    cols = ml.TRACK_FEATURES + ["target_lat_delta", "target_lon_delta", "target_latitude", "target_longitude"]
    d = spark.range(60).select(*[(F.col("id") % (i + 3)).cast("double").alias(c) for i, c in enumerate(cols)], (F.col("id") % 3 == 0).alias("hole"))
    d = d.withColumn("prev_speed_kmh", F.when(~F.col("hole"), F.col("prev_speed_kmh")))
    out = ml.predict_track_forest(ml.fit_track_forest(d, trees=3, depth=2), d)
    assert out.count() == 60 and out.filter("pred_lat is null").count() == 0


def test_stream_keeps_an_existing_table(spark, tmp_path):
    schema = "iceberg_id string, obs_time timestamp_ntz, event_id long"
    src = str(tmp_path / "in")
    rows = lambda *r: spark.createDataFrame([(a, t, i) for a, t, i in r], "iceberg_id string, t string, event_id long").selectExpr("iceberg_id", "cast(t as timestamp_ntz) obs_time", "event_id")
    table = str(tmp_path / "t")

    def start(name, *r):
        rows(*r).write.parquet(f"{src}/{name}")
        jobs.stream_latest(spark.readStream.schema(schema).parquet(f"{src}/{name}"), table, str(tmp_path / f"cp-{name}")).awaitTermination()
    start("one", ("A", "2024-01-01", 1), ("B", "2024-01-05", 2))
    start("two", ("B", "2024-01-02", 3), ("C", "2024-01-03", 4))
    start("three", ("A", "2024-01-09", 5))
    got = {r.iceberg_id: r.event_id for r in jobs.read_latest(spark, table).collect()}
    assert got == {"A": 5, "B": 2, "C": 4} and len(jobs.versions(spark, table)) == 2


def test_replace_table_keeps_one_whole_copy(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(5).write.parquet(p)
    wr.replace_table(spark, spark.read.parquet(p).filter("id < 3"), p, str(tmp_path / "new"))
    assert spark.read.parquet(p).count() == 3 and not (tmp_path / "t.old").exists() and not (tmp_path / "new").exists()


def test_snapshot_time_reaches_the_scan(spark, tmp_path):
    p = str(tmp_path / "g")
    spark.range(100).selectExpr("timestamp_ntz '2024-01-01' + make_dt_interval(id % 5) as obs_time", "id as v").write.parquet(p)
    d = g.latest_snapshot(spark.read.parquet(p))
    assert d.count() == 20
    d.collect()
    assert "EqualTo(obs_time" in d._jdf.queryExecution().executedPlan().toString() or "obs_time#" in d._jdf.queryExecution().executedPlan().toString()


def test_unit_report_and_check(spark):
    """Fixed tables, so unit tests rather than queries."""
    from floetrack.operators import clean as cl
    from floetrack.operators import quality as q
    r = {x.variable: (x.dataset, x.units, x.valid_low, x.valid_high) for x in q.unit_report(spark).collect()}
    assert r["uo"] == ("ocean_surface", "m s-1", -5.0, 5.0) and r["t2m"] == ("weather_surface", "K", 150.0, 330.0) and len(r) == 9
    actual = spark.createDataFrame([("uo", "m s-1"), ("u10", "knots"), ("t2m", None)], "variable string, actual string")
    spec = q.unit_report(spark).select("variable", "units").join(actual.select("variable"), "variable", "left_semi")
    assert {x.variable: x.code for x in cl.check_units(spec, actual).collect()} == {"uo": "ok", "u10": "UNITS_MISMATCH", "t2m": "UNITS_MISSING"}


def test_stream_kinematics_orders_a_batch_and_marks_late_rows(spark, tmp_path):
    from floetrack.operators import tracks as tr
    d = spark.range(40).selectExpr("'A' as iceberg_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, cast(id * 7 % 40 as int)) as obs_time", "id as event_id",
                                   "-60 - (id * 7 % 40) / 10d as latitude", "id * 7 % 40 * 1d as longitude")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    d.filter("obs_time >= timestamp_ntz '2024-01-01 05:00:00'").coalesce(1).write.parquet(f"{src}/1")
    d.filter("obs_time < timestamp_ntz '2024-01-01 05:00:00'").coalesce(1).write.parquet(f"{src}/2")
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", *jobs.STATE_CONF)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    for k, v in jobs.STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        for n in (1, 2):
            st = spark.readStream.schema(d.schema).parquet(f"{src}/{n}") if n == 1 else spark.readStream.schema(d.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)
            q = jobs.stream_kinematics(st)
            (q.writeStream.format("parquet").option("path", f"{out}{n}").option("checkpointLocation", str(tmp_path / f"cp{n}")).trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    cols = ["event_id", "time_diff_hours", "displacement_nm", "speed_knots", "bearing_deg"]
    want = {r.event_id: tuple(r) for r in tr.kinematics(d.filter("obs_time >= timestamp_ntz '2024-01-01 05:00:00'").withColumn("length_nm", F.lit(0.0))).select(cols).collect()}
    got = {r.event_id: tuple(r) for r in spark.read.parquet(f"{out}1").select(cols).collect()}
    close = lambda a, b: all((x is None) == (y is None) and (x is None or abs(x - y) < 2e-4) for x, y in zip(a, b))
    assert len(got) == 35 and all(close(got[i], want[i]) for i in want)
    late = spark.read.parquet(f"{out}2").groupBy("late").count().collect()
    assert {r["late"]: r["count"] for r in late} in ({False: 35, True: 5}, {False: 40})
