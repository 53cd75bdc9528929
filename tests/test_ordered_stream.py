"""Fixes that arrive in any order over several micro-batches get the motion of the batch operator; late ones are marked."""
import pytest
from pyspark.sql import functions as F

from floetrack.operators import tracks as tr
from floetrack.streaming import jobs

SCHEMA = "iceberg_id string, obs_time timestamp_ntz, event_id long, latitude double, longitude double"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, jobs.STATE_CONF[key])
    yield
    spark.conf.unset(key)


def test_shuffled_batches_equal_the_batch_result(spark, tmp_path, rocks):
    i = F.col("id")
    fixes = spark.range(240).select(
        F.concat(F.lit("T"), i % 4).alias("iceberg_id"), F.timestamp_seconds(F.lit(1_700_000_000) + i * 977).cast("timestamp_ntz").alias("obs_time"),
        i.alias("event_id"), (-70 + i % 13 / 10.0).alias("latitude"), (i % 7 / 3.0).alias("longitude"))
    end = fixes.filter("event_id = 0").withColumn("obs_time", F.timestamp_seconds(F.lit(1_800_000_000)).cast("timestamp_ntz")).withColumn("event_id", F.lit(9999).cast("long"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    # three batches, dealt out by a hash: each holds old and new fixes; then one that moves the watermark, then a late fix
    parts = [fixes.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k) for k in range(3)] + [end]
    late = fixes.filter("event_id = 5").withColumn("event_id", F.lit(7777).cast("long"))

    def run():
        q = (jobs.stream_kinematics_ordered(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), "10 days")
             .writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        q.awaitTermination()
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(src)
        run()                                           # a restart from the checkpoint for every batch
    late.coalesce(1).write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(out)
    assert [r.event_id for r in got.filter("late").collect()] == [7777]
    want = {r.event_id: r for r in tr.kinematics(fixes).collect()}
    seen = {r.event_id: r for r in got.filter("not late").collect()}
    assert set(seen) == set(want)
    for k, r in want.items():
        for c in ("time_diff_hours", "displacement_nm", "speed_knots", "bearing_deg"):
            assert (r[c] is None and (seen[k][c] is None or seen[k][c] != seen[k][c])) or abs(r[c] - seen[k][c]) < 2e-4, (k, c, r[c], seen[k][c])
