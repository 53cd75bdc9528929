"""Chunked windows give exactly what plain windows give, also when one key holds most rows."""
import pytest
from pyspark.sql import functions as F

from floetrack.operators import ordered as od
from floetrack.operators import routes as rt
from floetrack.operators import tracks as tr
from floetrack.operators.forecast import window_tails


@pytest.fixture(scope="module")
def skewed(spark):
    """One track with a third of the rows, many short ones, bursts and long silences."""
    d = spark.range(900).withColumn("event_id", F.col("id"))
    key = F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("T"), (F.col("id") % 40).cast("string")))
    sec = (F.col("id") * 7919 % 5000) * 311 + F.when(F.col("id") % 50 == 0, 40_000_000).otherwise(0)
    return d.select(
        key.alias("iceberg_id"), F.timestamp_seconds(F.lit(1_700_000_000) + sec).cast("timestamp_ntz").alias("obs_time"), "event_id",
        (-70 + (F.col("id") * 37 % 100) / 10.0).alias("latitude"), ((F.col("id") * 53 % 3600) / 10.0 - 180).alias("longitude"),
        ((F.col("id") % 17) / 3.0).alias("length_nm"), ((F.col("id") % 13) / 3.0).alias("width_nm"),
        (F.col("id") % 7).cast("double").alias("uo"))


def same(a, b):
    ra, rb = (sorted(map(repr, d.select(*sorted(d.columns)).collect())) for d in (a, b))
    assert len(ra) == len(rb) and ra == rb


def rounded(d):
    return d.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


OPS = [
    lambda d, c: tr.kinematics(d, chunk=c), lambda d, c: tr.with_lags(d, ["latitude", "obs_time"], chunk=c),
    lambda d, c: tr.drift_features(d, chunk=c), lambda d, c: tr.trailing_mean(d, ["uo"], 5, chunk=c),
    lambda d, c: tr.per_track_split(d, chunk=c), lambda d, c: tr.sample_history(d, chunk=c),
    lambda d, c: tr.tail_trials(d, 3, 4, chunk=c), lambda d, c: tr.drop_speed_outliers(d, chunk=c),
    lambda d, c: tr.track_windows(tr.project_tracks(d, chunk=c), ["x_km", "uo"], 4, 3, chunk=c),
    lambda d, c: tr.interval_pairs(d, 2.0, 1.0, chunk=c)]
NAMES = ["kinematics", "lags", "drift", "trailing", "split", "history", "trials", "outliers", "windows", "pairs"]


@pytest.mark.parametrize("days", [0.05, 37.0])
@pytest.mark.parametrize("op", OPS, ids=NAMES)
def test_chunked_equals_plain(skewed, op, days):
    same(rounded(op(skewed, None)), rounded(op(skewed, days)))


@pytest.fixture(scope="module")
def hard(skewed):
    """Besides a long hot key: a dense one, one with equal times only, rows without a key and rows without a time."""
    i = F.col("event_id")
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s).cast("timestamp_ntz")
    dense = skewed.filter("event_id < 300").withColumn("event_id", i + 10_000).withColumn("iceberg_id", F.lit("DENSE")).withColumn("obs_time", at(i % 5))
    equal = skewed.filter("event_id < 250").withColumn("event_id", i + 20_000).withColumn("iceberg_id", F.lit("EQUAL")).withColumn("obs_time", at(F.lit(0)))
    lost = skewed.filter("event_id < 200").withColumn("event_id", i + 30_000).withColumn("iceberg_id", F.lit(None).cast("string"))
    none = skewed.filter("event_id % 9 = 0").withColumn("event_id", i + 40_000).withColumn("obs_time", F.lit(None).cast("timestamp_ntz"))
    return skewed.unionByName(dense).unionByName(equal).unionByName(lost).unionByName(none)


@pytest.mark.parametrize("op", OPS, ids=NAMES)
def test_results_do_not_depend_on_the_task_limit(hard, op, monkeypatch):
    plain = rounded(op(hard, None))
    monkeypatch.setattr(od, "TASK_ROWS", 40)
    same(plain, rounded(op(hard, od.AUTO)))


def test_large_keys_are_cut_small_ones_are_not(hard, monkeypatch):
    assert od.chunk_width(hard, ["iceberg_id"], ["obs_time", "event_id"]) is None
    monkeypatch.setattr(od, "TASK_ROWS", 50)
    w = od.chunk_width(hard, ["iceberg_id"], ["obs_time", "event_id"])
    n = od.with_chunk(hard, ["obs_time", "event_id"], w).groupBy("iceberg_id", od.CHUNK).count().collect()
    by = {}
    for r in n:
        by.setdefault(r["iceberg_id"], []).append(r["count"])
    assert all(max(by[k]) <= 60 and len(by[k]) > 4 for k in ("DENSE", "EQUAL", "HOT", None))
    assert all(len(v) == 1 for k, v in by.items() if k and k.startswith("T"))


def test_route_windows_chunked(spark):
    wp = spark.range(500).select((F.col("id") % 3).alias("route_id"), (F.col("id") / 3).cast("int").alias("wp_index"),
                                 (-70 + F.col("id") % 11).cast("double").alias("latitude"), (F.col("id") % 29).cast("double").alias("longitude"))
    same(rounded(rt.route_segments(wp, chunk=None)), rounded(rt.route_segments(wp, chunk=20)))
    at = spark.range(3).select(F.col("id").alias("route_id"), F.lit(0.37).alias("fraction"))
    same(rounded(rt.position_along(wp, at, chunk=None)), rounded(rt.position_along(wp, at, chunk=7)))


def test_window_tails_hold_only_tails(skewed):
    p = tr.project_tracks(skewed.withColumn("vo", F.lit(0.0)).withColumn("u10", F.lit(0.0)).withColumn("v10", F.lit(0.0)))
    t = window_tails(p, 5)
    assert t.agg(F.max(F.size("tail"))).first()[0] == 5
    assert t.filter("iceberg_id = 'HOT'").first()["n_obs"] == 300
