"""Exact nearest-neighbour join without comparing every pair.

Sites are summarised in a pyramid of cells, each four times finer per axis than the one above, with the bounding
box of its sites. Queries are grouped into small cells as well, and only these cells walk down the pyramid: a level
is joined by cell id, and a query cell keeps the site cells that can still hold the nearest site of one of its
queries (lower bound of the box distance not above the best upper bound). The walk ends with a short list of sites
per query cell; the queries themselves take part in one equi-join with that list and one map-side combined
aggregate. A hot query cell splits like any skewed join, and sites sharing one position collapse to one first.
"""
import math

from pyspark.sql import functions as F

from floetrack.functions.geo import haversine
from floetrack.operators.stats import attach
from floetrack.session import materialize

MAX_LEVEL = 10
LEAF_TARGET = 512
EPS = 1e-9
RANKED_SITES = 250_000
RANK_SPAN = 2 ** 28
SHORT_LISTS = 250_000           # rows of all query cells' site lists that every task may hold; more are shuffled


def _axes(lat, lon, metric):
    """SQL text of the three coordinates of a position: on the unit sphere, or scaled degrees."""
    if metric == "plane":
        return f"{lat}/180D", f"{lon}/180D", "0D"
    return (f"cos(radians({lat}))*cos(radians({lon}))", f"cos(radians({lat}))*sin(radians({lon}))", f"sin(radians({lat}))")


def _cell(x, level):
    k = 4 ** level
    return f"cast(least(greatest(floor(({x}+1D)*{k / 2!r}D), 0), {k - 1}) as bigint)"


def _node(cx, cy, cz, level):
    k = 4 ** level
    return f"(({cx})*{k}L+({cy}))*{k}L+({cz})"


def depth_of(sites, lat, lon, metric="sphere"):
    """Pyramid depth for a site table, to share between several joins on the same sites."""
    return pyramid_depth(sites.select(F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))
                         .dropna().distinct(), metric)[0]


def pyramid_depth(positions, metric="sphere"):
    """(depth whose fullest leaf stays small, number of positions), by counting: one job in the usual case."""
    x, y, z = _axes("_lat", "_lon", metric)
    base = positions.selectExpr(f"{x} as x", f"{y} as y", f"{z} as z")

    def look(level):
        leaf = base.selectExpr(*[f"{_cell(c, level)} as {c}" for c in "xyz"]).groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n"))
        r = leaf.agg(F.sum("n").alias("n"), F.max("n").alias("m")).first()
        return r["n"] or 0, r["m"] or 0

    level = 4
    n, m = look(level)
    want = min(MAX_LEVEL, max(2, math.ceil(math.log(max(n, 1), 16))))
    if m <= LEAF_TARGET:
        return min(level, want), n
    while level < MAX_LEVEL:
        level = min(MAX_LEVEL, max(level + 2, want))
        n, m = look(level)
        if m <= LEAF_TARGET:
            break
    return level, n


def build_index(sites, slat, slon, ties, payload=(), metric="sphere", levels=None, folder=None):
    """Write the pyramid over ``sites`` once; every ``nearest`` of the returned ``SiteIndex`` reads it.

    Sites sharing a position are one row, the first by the ``ties`` columns. With ``folder`` (shared by all executors) the
    index stays there for ``open_index``; it exists once its last file, the description, is written. Otherwise it lives with
    the other tables of the session's shared folder.
    """
    ties, payload = list(ties), list(payload)
    keep = list(dict.fromkeys(ties + payload))
    put = (lambda df, name: _stored(df, f"{folder}/{name}")) if folder else (lambda df, name: materialize(df))
    s = sites.select(F.col(slat).cast("double").alias("_lat"), F.col(slon).cast("double").alias("_lon"),
                     *[F.col(c).alias(f"_p_{c}") for c in keep]).filter("_lat is not null and _lon is not null")
    pos = put(s.groupBy("_lat", "_lon").agg(
        F.min_by(F.struct(*[f"_p_{c}" for c in keep]), F.struct(*[f"_p_{c}" for c in ties])).alias("_p")), "sites")
    if levels is None:
        levels, n = pyramid_depth(pos, metric)
    else:
        n = pos.count()
    if ranked := n <= RANKED_SITES:      # counted, few: one window; with and without it ties go by the tie columns, then by position
        order = ", ".join([f"_p._p_{c}" for c in ties] + ["_lat", "_lon"])
        pos = pos.withColumn("_rank", F.expr(f"row_number() over (order by {order}) - 1L"))
        pos = put(pos, "ranked") if folder else pos
    # boxes of all levels in one pass: a leaf's box counts for each of its ancestors
    leaf = _placed(pos, metric, levels).groupBy("_cx", "_cy", "_cz").agg(*[F.expr(f"{f}(_{n[3:]}) as {n}") for n, f in LOHI])
    at = lambda k: _node(*[f"shiftright(_c{c}, {2 * (levels - k)})" for c in "xyz"], k) if k else "0L"
    kin = ", ".join(f"struct({k} as _level, {at(k - 1)} as _at, {at(k)} as _node)" for k in range(1, levels + 1))
    boxes = (leaf.selectExpr(f"explode(array({kin})) as _b", *[n for n, _ in LOHI]).selectExpr("_b.*", *[n for n, _ in LOHI])
             .groupBy("_level", "_at", "_node").agg(*[F.expr(f"{f}({n}) as {n}") for n, f in LOHI]).sortWithinPartitions("_level"))
    boxes = put(boxes, "boxes")
    if folder:
        about = [(levels, n, ranked, metric, ties, keep)]
        sites.sparkSession.createDataFrame(about, ABOUT).coalesce(1).write.parquet(f"{folder}/about")
    return SiteIndex(pos, boxes, levels, ranked, metric, ties, keep)


ABOUT = "levels int, sites long, ranked boolean, metric string, ties array<string>, columns array<string>"
LOHI = [(f"_{n}{c}", f) for c in ("x", "y", "z", "lon") for n, f in (("lo", "min"), ("hi", "max"))]


def _stored(df, path):
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _placed(pos, metric, levels):
    """Positions with their coordinates and finest cells."""
    x, y, z = _axes("_lat", "_lon", metric)
    return pos.selectExpr("*", f"{x} as _x", f"{y} as _y", f"{z} as _z").selectExpr(
        "*", *[f"{_cell(f'_{c}', levels)} as _c{c}" for c in "xyz"])


def open_index(spark, folder):
    """Index written by ``build_index(..., folder=folder)``."""
    a = spark.read.schema(ABOUT).parquet(f"{folder}/about").first()      # one row
    return SiteIndex(spark.read.parquet(f"{folder}/{'ranked' if a['ranked'] else 'sites'}"), spark.read.parquet(f"{folder}/boxes"),
                     a["levels"], a["ranked"], a["metric"], a["ties"], a["columns"])


def nearest_join(queries, qid, qlat, qlon, sites, slat, slon, ties, payload=(), metric="sphere",
                 levels=None, window=None, dist="dist_km", digits=6, radius=None, many=False):
    """Nearest site of every query over an index built for this one join; see ``SiteIndex.nearest``."""
    index = build_index(sites, slat, slon, ties, payload, metric, levels)
    return index.nearest(queries, qid, qlat, qlon, window, dist, digits, radius, many=many)


class SiteIndex:
    """Stored pyramid: one row per site position, the boxes of all levels, depth, metric, tie order and carried columns."""

    def __init__(self, positions, boxes, levels, ranked, metric, ties, columns):
        self.positions, self.boxes, self.levels, self.ranked = positions, boxes, levels, ranked
        self.metric, self.ties, self.columns = metric, list(ties), list(columns)

    def nearest(self, queries, qid, qlat, qlon, window=None, dist="dist_km", digits=6, radius=None, group=None, many=False):
        """Nearest site of every query: ``qid``, site position, the index's tie and payload columns, ``dist``.

        ``qid`` may repeat (the sample points of a route): then the nearest site over all rows of the id is found.

        Distances equal to ``digits`` decimals count as ties, resolved by the index's tie columns in ascending order.
        ``window=(lo, hi)`` names query columns bounding the site longitude; ``group`` an integer column from 0 to 3 that
        keeps queries of unlike windows in cells of their own, so that each cell's bounds stay tight. Queries without any
        admissible site return no row. Metric ``sphere`` is in kilometres, ``plane`` in degrees. ``many``: far more queries
        than query cells; the cells' site lists are written and counted first, and short ones go to the queries as a whole.
        """
        return _walk(self, queries, qid, qlat, qlon, window, dist, digits, radius, group, many)


def _walk(index, queries, qid, qlat, qlon, window, dist, digits, radius, group, many):
    metric, levels, keep, ties = index.metric, index.levels, index.columns, index.ties
    pos = _placed(index.positions, metric, levels)
    n = True if index.ranked and digits <= 6 else None
    boxes = [index.boxes.filter(F.col("_level") == k).drop("_level") for k in range(1, levels + 1)]

    # queries are grouped into small cells; the walk compares boxes of queries with boxes of sites
    fine = min(MAX_LEVEL, levels + 1)
    q = (queries.select(F.col(qid).alias("_qid"), F.col(qlat).cast("double").alias("_qlat"), F.col(qlon).cast("double").alias("_qlon"),
                        *([F.col(window[0]).alias("_wlo"), F.col(window[1]).alias("_whi")] if window else []),
                        F.col(group).cast("long").alias("_g") if group else F.lit(0).cast("long").alias("_g"))
         .filter("_qlat is not null and _qlon is not null"))
    base = [c for c in q.columns if c != "_g"]
    q = (q.selectExpr("*", *[f"{e} as _q{c}" for e, c in zip(_axes("_qlat", "_qlon", metric), "xyz")])
         .selectExpr("*", f"_g*{2 ** 60}L+" + _node(*[_cell(f"_q{c}", fine) for c in "xyz"], fine) + " as _k"))
    bounds = [f"{f}(_q{c}) as _q{n}{c}" for c in "xyz" for n, f in (("lo", "min"), ("hi", "max"))]
    if window:
        bounds += ["min(_wlo) as _wlo0", "max(_wlo) as _wlo1", "min(_whi) as _whi0", "max(_whi) as _whi1"]
    cells = q.groupBy("_k").agg(*[F.expr(b) for b in bounds])
    own = cells.columns
    cand = cells.selectExpr("*", "0L as _at")

    def prune(df, keep, lo, hi, lon_lo, lon_hi):
        """Drop pairs that cannot hold the nearest site of any query of the cell."""
        gap = "+".join(f"pow(greatest(0D,{lo}{c}-_qhi{c},_qlo{c}-{hi}{c}),2)" for c in "xyz")
        far = "+".join(f"pow(greatest(abs(_qhi{c}-{lo}{c}),abs({hi}{c}-_qlo{c})),2)" for c in "xyz")
        ub = f"sqrt({far})"
        if window:      # a pair is possible for some query, and bounds the distance only when admissible for all
            df = df.filter(f"{lon_hi}>=_wlo0 and {lon_lo}<=_whi1")
            ub = f"case when {lon_lo}>=_wlo1 and {lon_hi}<=_whi0 then {ub} else double('Infinity') end"
        return (df.selectExpr(*keep, f"sqrt({gap}) as _lb", f"min({ub}) over (partition by _k) as _best")
                .filter(f"_lb <= _best + {EPS!r}D").select(*[k.split(" as ")[-1] for k in keep]))

    for level, box in enumerate(boxes, start=1):
        if level == 1:      # at most 4**3 boxes whatever the data: one array for all cells
            top = box.drop("_at").agg(F.expr("collect_list(struct(*)) as _top"))
            pairs = attach(cand.drop("_at"), top).selectExpr(*own, "explode(_top) as _b").selectExpr(*own, "_b.*")
        else:
            pairs = cand.join(box, "_at")
        cand = prune(pairs, own + ["_node as _at"], "_lo", "_hi", "_lolon", "_hilon")
    pick = ["_k", "_lat", "_lon", "_rank" if n is not None else "_p"]
    leaf = pos.selectExpr(f"{_node('_cx', '_cy', '_cz', levels)} as _at", *pick[1:], "_x", "_y", "_z")
    near = prune(cand.join(leaf, "_at"), pick, "_", "_", "_lon", "_lon")
    # Query cells keep few sites each, so the list of a partition fits a hash table; neither side is broadcast on an
    # estimate, and partitions skewed by a hot query cell are split at run time.
    near = materialize(near) if many else near
    short = many and near.count() <= SHORT_LISTS
    hit = q.select(*base, "_k").join(F.broadcast(near) if short else near.hint("shuffle_hash"), "_k")
    if window:
        hit = hit.filter("_lon between _wlo and _whi")
    if metric == "plane":
        hit = hit.selectExpr("_qid", *pick[1:], "sqrt(pow(_lat-_qlat,2)+pow(_lon-_qlon,2)) as _d")
    else:
        hit = hit.select("_qid", *pick[1:], haversine("_qlat", "_qlon", "_lat", "_lon", *([radius] if radius else [])).alias("_d"))
    if n is not None:
        # rounded distance and site rank packed into one number: a plain hash aggregate finds the nearest
        best = (hit.selectExpr("_qid", "_d", f"cast(round(_d*1e{digits}) as bigint)*{RANK_SPAN}L + _rank as _o")
                .groupBy("_qid").agg(F.expr("min(_o) as _o"), F.expr("min_by(_d, _o) as _d"))
                .selectExpr("_qid", "_d", f"_o % {RANK_SPAN}L as _rank").join(pos.select("_rank", "_lat", "_lon", "_p"), "_rank"))
        return best.select(F.col("_qid").alias(qid), F.col("_lat").alias("site_lat"), F.col("_lon").alias("site_lon"),
                           F.col("_d").alias(dist), *[F.col(f"_p._p_{c}").alias(c) for c in keep])
    order = ", ".join([f"round(_d, {digits})"] + [f"_p._p_{c}" for c in ties] + ["_lat", "_lon"])
    best = hit.groupBy("_qid").agg(F.expr(f"min_by(struct(_d, _lat, _lon, _p), struct({order})) as _m"))
    # more sites than a rank may number: compare the tie columns themselves
    return best.select(F.col("_qid").alias(qid), F.col("_m._lat").alias("site_lat"), F.col("_m._lon").alias("site_lon"),
                       F.col("_m._d").alias(dist), *[F.col(f"_m._p._p_{c}").alias(c) for c in keep])
