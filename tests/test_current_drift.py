"""Steps of the current drift: a column, a number, a missing column."""
import pytest
from pyspark.sql import functions as F

from floetrack.operators import forecast as fc


def test_step_hours(spark):
    rows = [("A", "2024-01-01 00:00:00", 1, 3.0), ("B", "2024-01-01 00:00:00", 2, None), ("C", "2024-01-01 00:00:00", 3, -1.0)]
    d = (spark.createDataFrame(rows, "iceberg_id string, obs_time string, event_id long, median_dt_hours double").withColumn("obs_time", F.to_timestamp("obs_time"))
         .selectExpr("*", "0D as x_km", "0D as y_km", "-65D as origin_lat", "10D as origin_lon", "0.5D as uo", "0D as vo"))
    hours = lambda **k: {(r["iceberg_id"], r["k"]): r["hours_ahead"] for r in fc.current_drift(d, 2, **k).collect()}
    assert hours() == {("A", 1): 3.0, ("A", 2): 6.0, ("B", 1): 6.0, ("B", 2): 12.0, ("C", 1): 6.0, ("C", 2): 12.0}
    assert set(hours(dt_hours=2).values()) == {2.0, 4.0}
    with pytest.raises(ValueError, match="median_step_hours"):
        fc.current_drift(d.drop("median_dt_hours"), 2)
