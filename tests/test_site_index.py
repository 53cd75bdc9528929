"""Stored site index: written once, opened later, same answers as a join that builds its own."""
import os

import pytest
from pyspark.sql import functions as F

from floetrack.operators import joins as j
from floetrack.operators.nearest import build_index, nearest_join, open_index


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def world(spark):
    sites = spark.range(700).selectExpr("id as sid", "-80D + (id * 37 % 1601) / 10D as lat", "-180D + (id * 911 % 3600) / 10D as lon", "cast(id % 9 as double) as load")
    sites = sites.unionByName(sites.selectExpr("sid + 1000 as sid", "lat", "lon", "load"))      # equal positions
    q = spark.range(300).selectExpr("id as qid", "-89D + (id * 53 % 1780) / 10D as la", "-180D + (id * 1237 % 3600) / 10D as lo")
    return sites, q


@pytest.mark.parametrize("metric", ["sphere", "plane"])
def test_opened_index_answers_as_a_join(spark, world, tmp_path, metric):
    sites, q = world
    folder = str(tmp_path / metric)
    build_index(sites, "lat", "lon", ["sid"], ["load"], metric, folder=folder)
    index = open_index(spark, folder)
    got = rows(index.nearest(q, "qid", "la", "lo"))
    assert len(got) == 300 and got == rows(nearest_join(q, "qid", "la", "lo", sites, "lat", "lon", ["sid"], ["load"], metric))
    if metric == "plane":
        brute = q.join(sites, F.abs(F.col("lat") - F.col("la")) < 400).groupBy("qid").agg(
            F.min_by("sid", F.struct(F.round(F.sqrt((F.col("lat") - F.col("la")) ** 2 + (F.col("lon") - F.col("lo")) ** 2), 6), "sid")).alias("sid"))
        assert {r["qid"]: r["sid"] for r in index.nearest(q, "qid", "la", "lo").collect()} == {r["qid"]: r["sid"] for r in brute.collect()}


def test_boxes_hold_every_ancestor(spark, world):
    sites, _ = world
    index = build_index(sites, "lat", "lon", ["sid"], levels=4)
    b = index.boxes.collect()
    nodes = {k: {r["_node"] for r in b if r["_level"] == k} for k in range(1, 5)}
    assert all(r["_at"] in (nodes[r["_level"] - 1] if r["_level"] > 1 else {0}) for r in b)
    assert index.positions.count() == 700 and all(r["_lox"] <= r["_hix"] for r in b)


def test_index_without_its_description_does_not_exist(spark, world, tmp_path):
    sites, q = world
    folder = str(tmp_path / "cut")
    build_index(sites, "lat", "lon", ["sid"], folder=folder)
    os.rename(f"{folder}/about", f"{folder}/elsewhere")      # as if the writer had been lost before its last step
    with pytest.raises(Exception, match="about"):
        open_index(spark, folder)


def test_empty_sites_and_null_positions(spark, world):
    sites, q = world
    assert build_index(sites.filter("sid < 0"), "lat", "lon", ["sid"]).nearest(q, "qid", "la", "lo").count() == 0
    holes = sites.selectExpr("sid", "if(sid % 2 = 0, lat, null) as lat", "lon")
    got = build_index(holes, "lat", "lon", ["sid"]).nearest(q.selectExpr("qid", "if(qid < 10, null, la) as la", "lo"), "qid", "la", "lo")
    assert got.count() == 290 and got.filter("sid % 2 = 1").count() == 0


def test_groups_of_windows_do_not_mix(spark, world):
    sites, q = world
    w = q.selectExpr("qid", "la", "lo", "explode(array(0, 1)) as g").selectExpr(
        "struct(qid, g) as id", "qid", "la", "lo", "g", "if(g = 0, lo - 40, -lo - 40) as a", "if(g = 0, lo + 40, -lo + 40) as z")
    index = build_index(sites, "lat", "lon", ["sid"])
    got = index.nearest(w, "id", "la", "lo", window=("a", "z"), group="g").selectExpr("id.qid", "id.g", "sid")
    apart = None
    for g in (0, 1):
        one = index.nearest(w.filter(f"g = {g}"), "qid", "la", "lo", window=("a", "z")).selectExpr("qid", f"{g} as g", "sid")
        apart = one if apart is None else apart.unionByName(one)
    assert rows(got) == rows(apart)


def test_navigable_with_a_stored_index(spark, tmp_path):
    grid = spark.range(0, 40 * 60).selectExpr("-80D + cast(id / 60 as int) as latitude", "-30D + id % 60 as longitude",
                                              "(id * 7919 % 11) < 8 or id % 60 between 10 and 30 as is_land")
    pts = spark.range(80).selectExpr("id as pid", "-85D + id % 50 as latitude", "-40D + id * 1.1D as longitude")
    folder = str(tmp_path / "sea")
    j.sea_index(grid, folder=folder)
    own = j.nearest_navigable(pts, "pid", grid)
    assert rows(j.nearest_navigable(pts, "pid", grid, index=open_index(spark, folder))) == rows(own)
    assert own.count() == 80
