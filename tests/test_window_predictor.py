"""Batched recursive forecaster against a plain loop over one track at a time."""
import datetime as dt
import math

import numpy as np
import pytest

from floetrack.operators.forecast import recursive_forecast

COLS = ("iceberg_id string, obs_time timestamp_ntz, event_id long, latitude double, longitude double, length_km double, width_km double, "
        "origin_lat double, origin_lon double, x_km double, y_km double, uo double, vo double, u10 double, v10 double")
LENGTHS = {"LONE": 1, "PAIR": 2, "FIVE": 5, "SIX": 6, "LONG": 19, None: 4}


def fixes():
    rows = []
    for i, (k, n) in enumerate(sorted(LENGTHS.items(), key=str)):
        for j in range(n):
            t = dt.datetime(2023, 12, 30, 22) + dt.timedelta(hours=6 * j + i)
            rows.append((k, t, 100 * i + j, -70.0, 10.0, 2.0, 1.0, -70.0, 179.9, 3.0 * j + i * j * j, -2.0 * j + 0.1 * i, 0.1 * j, 0.2, float(j), None))
    return rows


def plain(track, steps, seq_len=5):
    """One track, one window at a time."""
    t, x, y = [r[1] for r in track], [r[9] for r in track], [r[10] for r in track]
    mean = lambda c: float(np.mean([r[c] for r in track[-seq_len:]])) if track[0][c] is not None else math.nan
    out = []
    for _ in range(steps):
        rows = []
        for i in range(max(0, len(x) - seq_len), len(x)):
            h = (t[i] - t[i - 1]).total_seconds() / 3600 if i else 1.0
            v = ((x[i] - x[i - 1]) / h, (y[i] - y[i - 1]) / h) if i else (0.0, 0.0)
            a = 2 * math.pi * (t[i].timetuple().tm_yday - 1) / 366
            rows.append([x[i], y[i], *v, mean(11), mean(12), mean(13), mean(14), 2.0, 1.0, (math.sin(a) + 1) / 2, (math.cos(a) + 1) / 2])
        p = predict(np.array([rows]))[0]
        x.append(p[0]); y.append(p[1]); t.append(t[-1] + dt.timedelta(hours=6))
        out.append((round(p[0], 6), round(p[1], 6), t[-1]))
    return out


def predict(w):
    assert w.ndim == 3 and w.shape[2] == 12 and w.shape[1] <= 5
    return np.nansum(w * (np.arange(12) + 1.0) / 40, axis=(1, 2))[:, None] * [0.01, -0.02] + w[:, 0, 2:4] + w[:, -1, :2]


def test_batches_equal_a_loop_over_tracks(spark):
    rows = fixes()
    df = spark.createDataFrame(rows, COLS)
    got = {}
    for r in recursive_forecast(df, predict, 7).collect():
        got.setdefault(r["iceberg_id"], {})[r["step"]] = (round(r["x_km"], 6), round(r["y_km"], 6), r["forecast_time"])
        assert -180 <= r["longitude"] < 180 and r["step_km"] >= 0 and r["hours_ahead"] == 6.0 * r["step"]
    assert set(got) == set(LENGTHS)
    for k in LENGTHS:
        want = plain([r for r in rows if r[0] == k], 7)
        assert [got[k][i] for i in range(1, 8)] == want, k


def test_standardised_windows_and_a_wrong_shape(spark):
    df = spark.createDataFrame([r for r in fixes() if r[0] == "SIX"], COLS)
    mean, std = np.arange(12.0), np.full(12, 2.0)
    keep = lambda w: w[:, -1, :2] * 2.0 + [0.0, 1.0]  # noqa: E731  undoes the scaling: x and y stay
    r = recursive_forecast(df, keep, 1, scale=(mean, std)).first()
    assert (r["x_km"], r["y_km"], round(r["step_km"], 9)) == (rows_last(df, "x_km"), rows_last(df, "y_km"), 0.0)
    with pytest.raises(Exception, match="is asked for"):
        recursive_forecast(df, lambda w: w[:, -1, :3], 1).collect()


def rows_last(df, c):
    return df.orderBy("obs_time").collect()[-1][c]


def test_no_tracks(spark):
    assert recursive_forecast(spark.createDataFrame([], COLS), predict, 3).count() == 0
