"""Structured Streaming jobs on arriving observations."""
import hashlib

from pyspark.sql import functions as F

from floetrack.config import R_NM
from floetrack.operators import tracks as tr
from floetrack.sources import store

STATE_CONF = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def latest_batch_merge(target, batch, key="iceberg_id", time_col="obs_time", tie="event_id"):
    """Target and batch merged to the newest row per key: a late row loses because event time decides."""
    return tr.latest_state(target.unionByName(batch), False, [key], time_col, tie)


def versions(spark, path):
    """Complete versions of a table kept by ``stream_latest``, oldest first: (number, run, batch)."""
    return store.versions(spark, path)


def read_latest(spark, path):
    """The newest complete version of a table kept by ``stream_latest``."""
    return store.Store(spark, path).read()


def stream_latest(stream, path, checkpoint, key="iceberg_id", time_col="obs_time", tie="event_id", trigger=None, buckets=store.BUCKETS):
    """Keep the latest position per key in a keyed store; ``read_latest`` reads its newest version.

    Every micro-batch is reduced to one row per key and merged into the buckets of its keys; the others are not touched. The
    store knows the last batch of each run (a checkpoint), so a replayed batch changes nothing.
    """
    run = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def apply(batch, batch_id):
        newest = tr.latest_state(batch, False, [key], time_col, tie)
        at = store.Store(batch.sparkSession, path, [key], buckets)
        at.merge(newest, lambda old, new: latest_batch_merge(old, new, key, time_col, tie), run, batch_id)
    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


KIN_SCHEMA = ("iceberg_id string, obs_time timestamp_ntz, event_id long, latitude double, longitude double, "
              "time_diff_hours double, displacement_nm double, speed_knots double, bearing_deg double, late boolean")


def _motion(la0, lo0, t0, la1, lo1, t1, min_hours):
    """Hours, nautical miles, knots and bearing of steps given as arrays (degrees, microseconds)."""
    import numpy as np
    a0, a1, dl = np.radians(la0), np.radians(la1), np.radians(lo1 - lo0)
    s = np.sin((a1 - a0) / 2) ** 2 + np.cos(a0) * np.cos(a1) * np.sin(dl / 2) ** 2
    nm = 2 * R_NM * np.arcsin(np.sqrt(np.minimum(1.0, s)))
    brg = np.degrees(np.arctan2(np.sin(dl) * np.cos(a1), np.cos(a0) * np.sin(a1) - np.sin(a0) * np.cos(a1) * np.cos(dl))) % 360.0
    h = np.maximum((t1 - t0) / 3.6e9, min_hours)
    return np.round(h, 4), np.round(nm, 4), np.round(nm / h, 4), np.round(brg, 2)


def kinematics_processor(min_hours=0.05, ttl_hours=None):
    """Stateful processor: the newest fix of each track is the only state kept, for ``ttl_hours`` if given."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Kinematics(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            keep = {} if ttl_hours is None else {"ttlDurationMs": int(ttl_hours * 3_600_000)}
            self.prev = handle.getValueState("prev", "us double, la double, lo double", **keep)

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np
            import pandas as pd
            # a track's rows of one micro-batch arrive in several pieces: they are put in order together
            pdf = pd.concat(list(rows)).sort_values(["obs_time", "event_id"]).reset_index(drop=True)
            us = pdf["obs_time"].astype("datetime64[us]").astype("int64").to_numpy(float)
            last = self.prev.get() if self.prev.exists() else None
            late = us < last[0] if last else np.zeros(len(us), bool)
            on = np.flatnonzero(~late)
            la, lo = pdf["latitude"].to_numpy(float), pdf["longitude"].to_numpy(float)
            out = np.full((4, len(us)), np.nan)
            if len(on):
                first = [x[on[:1]] for x in (la, lo, us)] if not last else [np.array([last[i]]) for i in (1, 2, 0)]
                before = [np.concatenate([f, x[on[:-1]]]) for f, x in zip(first, (la, lo, us))]
                out[:, on] = _motion(*before, la[on], lo[on], us[on], min_hours)
                if not last:
                    out[:, on[0]] = np.nan
                self.prev.update((us[on[-1]], la[on[-1]], lo[on[-1]]))
            for c, v in zip(("time_diff_hours", "displacement_nm", "speed_knots", "bearing_deg"), out):
                pdf[c] = v
            yield pdf.assign(iceberg_id=key[0], late=late)[["iceberg_id", "obs_time", "event_id", "latitude", "longitude", "time_diff_hours",
                                                           "displacement_nm", "speed_knots", "bearing_deg", "late"]]

        def close(self) -> None:
            pass
    return Kinematics()


def stream_kinematics(stream, min_hours=0.05, ttl_hours=None):
    """Motion since the previous fix per track, continuously. Needs the RocksDB state provider.

    Fixes of one micro-batch are put in time order whatever their order of arrival. A fix older than the newest one of an
    earlier micro-batch cannot be placed any more: it is passed on without motion and marked ``late``, so late rows can be
    counted or sent elsewhere. ``ttl_hours`` forgets tracks that stay silent so long (processing time).
    """
    return (stream.select("iceberg_id", "obs_time", "event_id", "latitude", "longitude").groupBy("iceberg_id")
            .transformWithStateInPandas(kinematics_processor(min_hours, ttl_hours), KIN_SCHEMA, "append", "processingTime" if ttl_hours else "none"))


def ordered_processor(min_hours=0.05):
    """Stateful processor in event time: fixes wait in a list until the watermark has passed them and leave in order."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Ordered(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.prev = handle.getValueState("prev", "us long, la double, lo double")
            self.waiting = handle.getListState("waiting", "us long, id long, la double, lo double")

        def frame(self, key, rows, motion, late):
            import numpy as np
            import pandas as pd
            us, ids, la, lo = (np.array([r[i] for r in rows]) for i in range(4))
            return pd.DataFrame({"iceberg_id": key[0], "obs_time": us.astype("datetime64[us]"), "event_id": ids, "latitude": la, "longitude": lo,
                                 "time_diff_hours": motion[0], "displacement_nm": motion[1], "speed_knots": motion[2], "bearing_deg": motion[3], "late": late})

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np
            passed = timerValues.getCurrentWatermarkInMs()
            late, first = [], None
            for pdf in rows:
                us = pdf["obs_time"].astype("datetime64[us]").astype("int64")
                new = list(zip(us.tolist(), pdf["event_id"].tolist(), pdf["latitude"].tolist(), pdf["longitude"].tolist()))
                late += [r for r in new if r[0] // 1000 <= passed]
                new = [r for r in new if r[0] // 1000 > passed]
                if new:
                    self.waiting.appendList(new)
                    first = min([r[0] for r in new] + ([first] if first is not None else []))
            if first is not None:
                self.handle.registerTimer(first // 1000)
            if late:
                yield self.frame(key, late, np.full((4, len(late)), np.nan), True)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import numpy as np
            passed = timerValues.getCurrentWatermarkInMs()
            rows = list(self.waiting.get()) if self.waiting.exists() else []
            out = sorted((tuple(r) for r in rows if r[0] // 1000 <= passed), key=lambda r: (r[0], r[1]))
            rest = [tuple(r) for r in rows if r[0] // 1000 > passed]
            if not out:
                return
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(r[0] for r in rest) // 1000)
            else:
                self.waiting.clear()
            us, _, la, lo = (np.array([r[i] for r in out], float) for i in range(4))
            last = self.prev.get() if self.prev.exists() else None
            head = [np.array([last[i]], float) for i in (1, 2, 0)] if last else [x[:1] for x in (la, lo, us)]
            motion = np.array(_motion(*[np.concatenate([h, x[:-1]]) for h, x in zip(head, (la, lo, us))], la, lo, us, min_hours))
            if not last:
                motion[:, 0] = np.nan
            self.prev.update((out[-1][0], out[-1][2], out[-1][3]))
            yield self.frame(key, out, motion, False)

        def close(self) -> None:
            pass
    return Ordered()


def stream_kinematics_ordered(stream, delay="1 day", min_hours=0.05, time_col="obs_time"):
    """Motion since the previous fix per track in event time, whatever the order of arrival. Needs the RocksDB state provider.

    A fix waits until the watermark (the greatest time seen less ``delay``) has passed it; then it leaves in order of time and
    event id, with the motion a batch over all fixes would give. A fix that arrives behind the watermark is passed on at once,
    without motion and marked ``late``, so late rows can be counted or sent elsewhere. Fixes without a time are left out.
    """
    cols = ["iceberg_id", "obs_time", "event_id", "latitude", "longitude"]
    # the watermark column is not handed on, or Spark would drop late rows before they can be marked
    d = _event_time(stream.filter(F.col(time_col).isNotNull()).withColumn("obs_time", F.col(time_col)), time_col).withWatermark("_et", delay).select(*cols)
    return d.groupBy("iceberg_id").transformWithStateInPandas(ordered_processor(min_hours), KIN_SCHEMA, "append", "EventTime")


def _event_time(df, time_col):
    """Watermarks and windows run on a zoned timestamp (session zone UTC)."""
    return df.withColumn("_et", F.col(time_col).cast("timestamp"))


def stream_monitor(stream, size="2 hours", slide=None, delay="1 day", time_col="obs_time", value=None):
    """Observation counts (and mean of a value) per tumbling or sliding window."""
    d = _event_time(stream, time_col)
    d = d.withWatermark("_et", delay) if d.isStreaming else d
    w = F.window("_et", size, slide) if slide else F.window("_et", size)
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.avg(value).alias(f"mean_{value}"))
    return d.groupBy(w.alias("w")).agg(*aggs).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        *[c for c in (["n"] + ([f"mean_{value}"] if value else []))])


def stream_gaps(stream, gap="24 hours", delay="1 day", key="iceberg_id", time_col="obs_time"):
    """Stretches of fixes per key with no pause longer than ``gap``; a session's end is where the key went quiet."""
    d = _event_time(stream, time_col)
    d = d.withWatermark("_et", delay) if d.isStreaming else d
    return (d.groupBy(F.session_window("_et", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max("_et").alias("_last"))
            .select(key, F.col("w.start").cast("timestamp_ntz").alias("first_fix"), F.col("_last").cast("timestamp_ntz").alias("last_fix"),
                    F.col("w.end").cast("timestamp_ntz").alias("quiet_at"), "n"))


def stream_unique_alerts(stream, delay="1 hour", key="alert_id", time_col="timestamp"):
    """Alerts reported once per id within the watermark."""
    d = _event_time(stream, time_col)
    if not d.isStreaming:
        return d.drop("_et").dropDuplicates([key])
    return d.withWatermark("_et", delay).dropDuplicatesWithinWatermark([key]).drop("_et")


def stream_hazard(stream, risk_grid, axes, columns=("concentration", "iceberg_km", "total_risk")):
    """Vessel positions scored against a static risk grid by cell index."""
    from floetrack.functions.risk import risk_level
    from floetrack.operators.joins import sample_grid
    return sample_grid(stream, risk_grid, list(columns), axes).withColumn("risk_level", risk_level("total_risk"))
