"""Polar raster lookup of positions anywhere on the globe."""
from floetrack.config import POLAR_GRIDS
from floetrack.operators import grids as g


def test_positions_far_from_the_raster_have_no_cell(spark):
    gd = POLAR_GRIDS["3125m"]
    rows = [(1, -75.0, 40.0), (2, 90.0, 40.0), (3, 225.0, 10.0), (4, None, 10.0), (5, float("nan"), 10.0)]
    t = spark.createDataFrame(rows, "event_id long, latitude double, longitude double")
    near = g.polar_regrid(t.filter("event_id = 1"), spark.createDataFrame([], "iy long, ix long, value double"), gd).first()
    src = spark.createDataFrame([(near["iy"], near["ix"], 7.0), (0, 0, 1.0)], "iy long, ix long, value double")
    got = {r["event_id"]: (r["ix"], r["iy"], r["value"]) for r in g.polar_regrid(t, src, gd).collect()}
    assert got == {1: (near["ix"], near["iy"], 7.0)} | {i: (None, None, None) for i in (2, 3, 4, 5)}
