"""Hand-made cases of cleaning, quality, metrics, grids and status operators."""
import pytest
from pyspark.sql import functions as F

from floetrack.operators import clean as cl
from floetrack.operators import grids as g
from floetrack.operators import joins as j
from floetrack.operators import metrics as m
from floetrack.operators import quality as q
from floetrack.operators import status as st
from floetrack.operators import tracks as tr
from floetrack.operators.stats import exact_median
from floetrack.sources import readers as rd


def test_import_converts_km(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("id,time,lat,lon,length_km,width_km\nB1,2024-01-01T00:00:00Z,-70,10,10,5\nB2,bad,-71,11,4,2\n")
    r = rd.read_tracks(spark, str(f)).collect()
    assert len(r) == 1 and r[0].length_nm == pytest.approx(5.39957)


def test_import_needs_columns(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("id,lat\nB1,-70\n")
    with pytest.raises(ValueError, match="missing required columns"):
        rd.read_tracks_csv(spark, str(f))


def test_geojson_file(spark, tmp_path):
    f = tmp_path / "t.geojson"
    f.write_text('{"type":"FeatureCollection","features":['
                 '{"properties":{"iceberg_id":"A1","time":"2024-01-01","length_nm":2},"geometry":{"coordinates":[10,-70]}},'
                 '{"properties":{"time":"2024-01-01"},"geometry":{"coordinates":[11,-71]}},'
                 '{"properties":{"id":"A3"},"geometry":{"coordinates":[12,-72]}},{"properties":{"id":"A4","time":"2024-01-01"},"geometry":{}}]}')
    r = {x.iceberg_id: x for x in rd.read_tracks(spark, str(f)).collect()}
    assert set(r) == {"A1", "unknown"} and r["A1"].latitude == -70 and r["A1"].length_nm == 2 and r["A1"].width_nm is None


def test_json_array(spark, tmp_path):
    f = tmp_path / "t.json"
    f.write_text('[{"id":"A","time":"2024-01-01","lat":-70,"lon":1,"length":1,"width":1}]')
    assert rd.read_tracks(spark, str(f)).first().longitude == 1.0


def test_ocean_cells_default_grid(spark, tmp_path):
    f = tmp_path / "m.json"
    f.write_text('{"latitude":[-70,-70,-71],"longitude":[1,2,1]}')
    r = {(x.latitude, x.longitude): x.is_land for x in rd.read_ocean_cells(spark, str(f)).collect()}
    assert r == {(-70.0, 1.0): False, (-70.0, 2.0): False, (-71.0, 1.0): False, (-71.0, 2.0): True}


def test_nested_dims(spark, tmp_path):
    f = tmp_path / "v.json"
    f.write_text('{"vessels":[{"vessel_id":"a","ice_class":"PC3","fuel_consumption_tons_per_day":{"cruise_speed":28}}]}')
    assert rd.read_dims(spark, str(f), "vessels").first().ice_class == "PC3"


def test_masked_metrics(spark):
    d = spark.createDataFrame([(.6, .5, True), (.7, 1.0, True), (.8, .7, True), (float("nan"), .4, False)], "pred double, actual double, mask boolean")
    r = m.masked_error(d).first()
    assert r.mae == pytest.approx(.1666667) and r.rmse == pytest.approx(.1914854)


def test_constant_field_has_no_correlation(spark):
    d = spark.createDataFrame([(1, .5, .2), (1, .5, .4), (2, .1, .3)], "s int, pred double, actual double")
    assert m.spatial_correlation(d, "s").first().spatial_correlation is None


def test_scaler(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),)], "x double")
    r = m.fit_scaler(d, ["x"]).first()
    assert r["mean"] == 2.0 and r["std"] == pytest.approx((2 / 3) ** 0.5)


@pytest.mark.parametrize("vals,score,status", [
    ((89.81, 83.58, 100, 50, 73.85), 85.2, "Valid"), ((89.81, 83.58, 100, None, 73.85), 89.11, "Provisional"),
    ((0, 83.58, 100, 50, 73.85), 53.77, "Valid"), ((None,) * 5, None, "N/A"), ((-0.01, 100.01, float("nan"), float("inf"), 50), 50.0, "Provisional")])
def test_weighted_score(spark, vals, score, status):
    names = ("sea_ice", "iceberg", "route", "recalc", "land_mask")
    d = spark.createDataFrame([(n, None if v is None else float(v)) for n, v in zip(names, vals)], "component string, value double")
    r = m.weighted_score(d).first()
    assert r.status == status and (r.score is None if score is None else r.score == pytest.approx(score, abs=0.006))


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        m.check_weights({"sea_ice": .5, "iceberg": .5, "route": .5, "recalc": 0, "land_mask": 0})


def test_two_hour_eval(spark):
    rows = [("A", "2024-01-01 00:00:00", -75.0, 1.0), ("A", "2024-01-01 02:00:00", -75.0, 1.1), ("B", None, -70.0, 1.0),
            ("B", "2024-01-01 00:00:00", -70.0, 1.0), ("B", "2024-01-01 00:00:00", -70.0, 1.0), ("B", "2024-01-01 07:00:00", -70.0, 1.0)]
    d = spark.createDataFrame(rows, "iceberg_id string, t string, latitude double, longitude double").selectExpr(
        "iceberg_id", "cast(t as timestamp_ntz) obs_time", "latitude", "longitude")
    r = m.two_hour_eval(d).first()
    assert (r.pairs, r.duplicate_records, r.missing_or_invalid, r.status) == (1, 1, 2, "VERIFIED") and r.accuracy_percent == 100.0
    far = m.two_hour_eval(d, lambda la, lo, gap: (la + 5.0, lo)).first()
    assert far.accuracy_percent == 0.0 and far.mean_error_km > 20
    none = m.two_hour_eval(d.filter("iceberg_id = 'B'")).first()
    assert none.status == "INSUFFICIENT_DATA" and none.mean_error_km is None


def test_exact_median_even_odd_nulls_and_ties(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 9.0), ("a", None), ("b", 2.0), ("b", 3.0), ("c", 7.0), ("c", 7.0), ("c", 7.0), ("c", 1e9)], "k string, v double")
    r = {x.k: x.m for x in exact_median(d, "v", ["k"], "m").collect()}
    assert r == {"a": 5.0, "b": 2.5, "c": 7.0}
    assert exact_median(d, "v", name="m").first().m == d.agg(F.median("v")).first()[0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_median_random(spark, seed):
    d = spark.range(3001).select((F.col("id") % 4).alias("k"), (F.exp(F.rand(seed) * 20) - 3).alias("v")).persist()
    a = {x.k: x.m for x in exact_median(d, "v", ["k"], "m").collect()}
    b = {x.k: x.m for x in d.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert a == b


def test_chrono_split_partition(spark):
    d = spark.range(101).select(F.col("id").alias("event_id"), F.lit("A").alias("iceberg_id"),
                                F.timestamp_seconds(F.col("id") * 17 % 10).cast("timestamp_ntz").alias("obs_time"))
    s = tr.chrono_split(d)
    n = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"train": 71, "val": 15, "test": 15}
    edge = {r.split: (r.lo, r.hi) for r in s.groupBy("split").agg(F.min("obs_time").alias("lo"), F.max("obs_time").alias("hi")).collect()}
    assert edge["train"][1] <= edge["val"][0] <= edge["val"][1] <= edge["test"][0]
    with pytest.raises(ValueError):
        tr.chrono_split(d, (0.5, 0.1, 0.1))


def test_span_split_falls_back_to_rows(spark):
    d = spark.range(10).select(F.col("id").alias("event_id"), F.lit("A").alias("iceberg_id"), F.timestamp_seconds(
        F.when(F.col("id") == 9, 1_000_000).otherwise(F.col("id"))).cast("timestamp_ntz").alias("obs_time"))
    n = {r.split: r["count"] for r in tr.span_split(d).groupBy("split").count().collect()}
    assert n == {"train": 7, "val": 1, "test": 2}


def test_land_mask_points(spark):
    c = [(float(la), float(lo), (la, lo) == (-75, 1)) for la in (-76, -75, -74) for lo in (0, 1, 2)]
    grid = spark.createDataFrame(c, "latitude double, longitude double, is_land boolean")
    p = spark.createDataFrame([(1, -74.0, 0.0), (2, -75.0, 1.0), (3, -75.03, 1.0), (4, 10.0, 0.0)], "pid int, latitude double, longitude double")
    out, total = j.score_land_mask(p, "pid", grid)
    assert {r.pid: r.result for r in out.collect()} == {1: "ocean", 2: "land", 3: "land", 4: "invalid"}
    assert total.first().accuracy_percent == 25.0


def test_fill_gaps_respects_max_gap(spark):
    v = [1.0, None, 3.0, None, None, 6.0, None]
    d = spark.createDataFrame([(f"2024-01-{i + 1:02d}", x) for i, x in enumerate(v)], "t string, sic double").selectExpr(
        "cast(t as timestamp_ntz) obs_time", "0D latitude", "0D longitude", "sic")
    one = [r.sic for r in g.fill_gaps(d, "sic", 1).orderBy("obs_time").collect()]
    two = [r.sic for r in g.fill_gaps(d, "sic", 2).orderBy("obs_time").collect()]
    assert one == [1.0, 2.0, 3.0, None, None, 6.0, None] and two == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None]


def test_grid_bounds(spark):
    assert g.make_grid(spark, -80, -60, -50, 50, 2).count() == 11 * 51
    assert g.make_grid(spark, -75, -55, -180, 180, 0.25, wrap_end=False).count() == 81 * 1440
    for bad in ((-60, -80, 0, 1, 1), (-80, -60, 1, 1, 1), (-80, -60, 0, 1, 0)):
        with pytest.raises(ValueError):
            g.make_grid(spark, *bad)


def test_upsert_null_keys_match(spark):
    t = spark.createDataFrame([("a", None, 1, "x")], "m string, s string, v int, seen string")
    s = spark.createDataFrame([("a", None, 2, None), ("b", "t", 3, "y")], "m string, s string, v int, seen string")
    r = sorted((x.m, x.s, x.v, x.seen) for x in st.upsert(t, s, ["m", "s"], ("seen",)).collect())
    assert r == [("a", None, 2, "x"), ("b", "t", 3, "y")]


def test_overall_status(spark):
    mk = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    assert q.overall_status(mk("valid", "missing", "incomplete")).first()[0] == "missing"
    assert q.overall_status(mk("valid").limit(0)).first()[0] == "empty"


def test_validate_missing_schema(spark):
    r = q.validate_tracks(spark.createDataFrame([("a",)], "iceberg_id string")).first()
    assert r.code == "SCHEMA_MISSING" and r.severity == "error"


def test_model_status_priorities(spark):
    reg = spark.createDataFrame([("p1", "m", True, False), ("p2", "m", True, None), ("p3", "m", True, True), ("p4", "m", True, True), ("p5", "m", False, None)],
                                "pipeline string, name string, available boolean, trained_on_demo boolean")
    met = spark.createDataFrame([("p1", False), ("p3", False), ("p4", True)], "pipeline string, demo boolean")
    r = {x.pipeline: x.status for x in st.model_status(reg, met).collect()}
    assert r == {"p1": "trained_on_real_data", "p2": "model_available_source_unknown", "p3": "evaluated_on_real_data", "p4": "demo_only", "p5": "not_available"}


def test_standardize_units_and_notes(spark):
    d = spark.createDataFrame([(10.0, 0.0, 1000.0, 5.0)], "u10 double, t2m double, msl double, v10 double")
    out, notes = cl.normalize_units(d, {"u10": "knots", "t2m": "degC", "msl": "hPa", "v10": "furlongs"})
    r = out.first()
    assert (r.u10, r.t2m, r.msl, r.v10) == (pytest.approx(5.14444), 273.15, 100000.0, 5.0)
    assert any("unknown units" in x.note for x in notes.collect())


def test_tight_tolerance_makes_all_stale(spark):
    g0 = spark.createDataFrame([(float(la), float(lo), 0.5) for la in (-70, -69) for lo in (0, 1)], "latitude double, longitude double, sic double").selectExpr(
        "timestamp_ntz'2024-01-01 00:00:00' obs_time", "*")
    t = spark.sql("select timestamp_ntz'2024-01-01 05:00:00' obs_time, -69.4D latitude, 0.2D longitude")
    r = j.env_join(t, g0, ["sic"], "sea_ice", 1.0).first()
    assert r.sic is None and r.sea_ice_stale == 1 and r.sea_ice_gap_hours == 5.0
    r = j.env_join(t, g0, ["sic"], "sea_ice").first()
    assert r.sic == 0.5 and r.sea_ice_stale == 0


def test_partitioned_write_spreads_a_hot_key(spark, tmp_path):
    from floetrack.sources import writers as wr
    d = spark.range(5000).select(F.lit("2024-01-15").cast("timestamp_ntz").alias("obs_time"), (F.col("id") % 50).cast("double").alias("latitude"), "id")
    wr.write_partitioned(d, str(tmp_path / "o"), {"yyyymm": wr.month_key()}, max_rows=300)
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.count() == 5000 and back.select("yyyymm").distinct().first()[0] == 202401
    sizes = back.groupBy(F.input_file_name()).count()
    assert sizes.agg(F.max("count")).first()[0] <= 300 and sizes.count() >= 5000 / 300
