"""Long irregular axes: the as-of lookup against a binary search, over range boundaries, ties, ends and NULLs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from floetrack.operators import axes as ax


def nearest(values, x):
    i = int(np.searchsorted(values, x))
    if i == 0 or i == len(values):
        return min(i, len(values) - 1)
    return i - 1 if x - values[i - 1] <= values[i] - x else i


@pytest.mark.parametrize("per_range", [3, 40, 10_000])
def test_lookup_equals_binary_search(spark, monkeypatch, per_range):
    monkeypatch.setattr(ax, "RANGE_VALUES", per_range)
    rng = np.random.default_rng(1)
    values = np.unique(np.round(np.concatenate([rng.uniform(0, 10, 150), rng.uniform(1e6, 1e6 + 5, 40), [-1e9, 7e12]]), 2))
    axis = ax.grid_axes(spark.createDataFrame([(float(v),) for v in values], "latitude double"), ["latitude"], listed=0)["latitude"]
    assert isinstance(axis, ax.LongAxis) and axis.n == len(values)
    q = [*rng.uniform(-5, 15, 200), *rng.uniform(1e6 - 9, 1e6 + 9, 100), *values[::5], *((values[:-1] + values[1:]) / 2)[::7], -1e12, 1e15]
    d = spark.createDataFrame([(float(x),) for x in q] + [(None,)] * 3 + [(float(q[0]),)] * 50, "x double")
    got = axis.index_of(d, "x", "i").collect()
    assert len(got) == d.count()
    for r in got:
        assert r.i == (None if r.x is None else nearest(values, r.x)), r
    own = axis.index_of(spark.createDataFrame([(float(v),) for v in values], "latitude double"), "latitude", "i", True)
    back = axis.value_at(own, "i", "v").collect()
    assert [r.v for r in sorted(back, key=lambda r: r.i)] == list(values) and all(r.v == r.latitude for r in back)


def test_300_000_irregular_times(spark):
    grid = spark.range(300_000).select(F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1_000_000 + F.col("id") * F.col("id") % 7919).cast("timestamp_ntz").alias("obs_time"))
    axis = ax.grid_axes(grid, ["obs_time"])["obs_time"]
    assert isinstance(axis, ax.LongAxis) and axis.n == 300_000 and len(axis.cuts) > 2
    d = spark.range(1000).select("id", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 299_000_000 + 400_000).cast("timestamp_ntz").alias("at"))
    assert all(r.i == r.id * 299 for r in axis.index_of(d, "at", "i").collect())
