"""A keyed store rewrites the buckets of a batch only, commits whole batches, and passes over replays."""
import os

from pyspark.sql import functions as F

from floetrack.sources import store
from floetrack.streaming import jobs

SCHEMA = "k string, n long, v double"


def newest(old, new):
    return old.unionByName(new).groupBy("k").agg(F.max_by(F.struct("n", "v"), "n").alias("b")).select("k", "b.*")


def rows(st):
    return sorted(((r.k, r.n, r.v) for r in st.read().collect()), key=str)


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "t"), ["k"], 8)
    first = spark.createDataFrame([(f"K{i}", 0, float(i)) for i in range(100)] + [(None, 0, -1.0)], SCHEMA)
    assert st.merge(first, newest) == list(range(8)) or len(st.live) > 4
    before = dict(st.live)
    one = spark.createDataFrame([("K7", 1, 70.0)], SCHEMA)
    at = st.merge(one, newest)
    assert len(at) == 1 and {b for b in before if st.live[b] != before[b]} == set(at)
    assert ("K7", 1, 70.0) in rows(st) and len(rows(st)) == 101
    st.merge(spark.createDataFrame([(None, 2, 5.0)], SCHEMA), newest)
    assert (None, 2, 5.0) in rows(st) and len(rows(st)) == 101
    assert rows(store.Store(spark, str(tmp_path / "t"))) == rows(st)          # keys and buckets come from the manifest
    assert len(store.versions(spark, str(tmp_path / "t"))) == 2


def test_replays_and_broken_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    st = store.Store(spark, path, ["k"], 4)
    b0, b1 = (spark.createDataFrame([(f"K{i}", n, float(n)) for i in range(20)], SCHEMA) for n in (0, 1))
    st.merge(b0, newest, "a", 0)
    st.merge(b1, newest, "a", 1)
    have = rows(st)
    assert st.merge(b0, newest, "a", 0) == [] and st.merge(b1, newest, "a", 1) == [] and rows(st) == have
    # a writer that died before its commit leaves data that no manifest names, and a manifest without an end mark is none
    b1.withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{path}/data/000000000002-b-0")
    os.makedirs(f"{path}/m000000000002-b-0")
    assert rows(store.Store(spark, path)) == have and len(store.versions(spark, path)) == 2
    late = spark.createDataFrame([("K3", 9, 9.0)], SCHEMA)
    store.Store(spark, path).merge(late, newest, "c", 0)
    assert ("K3", 9, 9.0) in rows(store.Store(spark, path)) and len(rows(store.Store(spark, path))) == 20


def test_upsert_into_equals_upsert(spark, tmp_path):
    from floetrack.operators.status import upsert
    a = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0), (None, 1, 3.0)], SCHEMA)
    b = spark.createDataFrame([("B", 2, None), ("C", 2, 4.0), (None, 2, 5.0)], SCHEMA)
    for keep, only in (((), False), (("v",), False), ((), True)):
        st = store.Store(spark, str(tmp_path / f"{len(keep)}{only}"), ["k"], 4)
        store.upsert_into(st, a)
        store.upsert_into(st, b, keep, only)
        want = upsert(a, b, ["k"], keep, only).collect()
        assert rows(st) == sorted(((r.k, r.n, r.v) for r in want), key=str)


def test_stream_latest_over_two_starts(spark, tmp_path):
    src, path, cp = str(tmp_path / "src"), str(tmp_path / "t"), str(tmp_path / "cp")
    schema = "iceberg_id string, obs_time timestamp_ntz, event_id long"
    at = lambda part: spark.createDataFrame(part, "iceberg_id string, t string, event_id long").selectExpr("iceberg_id", "cast(t as timestamp_ntz) as obs_time", "event_id")
    go = lambda: jobs.stream_latest(spark.readStream.schema(schema).parquet(src), path, cp, buckets=8).awaitTermination()
    at([("A", "2024-01-02", 1), ("B", "2024-01-01", 2)]).write.parquet(src)
    go()
    before = store.Store(spark, path).live
    at([("A", "2024-01-01", 3), ("A", "2024-01-05", 4)]).write.mode("append").parquet(src)
    go()
    go()
    after = store.Store(spark, path).live
    assert {r.iceberg_id: r.event_id for r in jobs.read_latest(spark, path).collect()} == {"A": 4, "B": 2}
    assert sum(before.get(b) != f for b, f in after.items()) == 1
