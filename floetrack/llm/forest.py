"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits its leaves again and again at the mean of a random projection; vectors near the split go to both sides.
Leaves small enough stay; a leaf whose vectors are nearly one point does too, as no split separates them. Vectors are
compared within leaves by exact cosine; a pair that meets in several leaves counts in the first one. Equal vectors are one
class throughout, so copies are never compared.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from floetrack.llm.common import components, written

TILE = 2048


def directions(dim, trees, levels, seed=7):
    d = np.random.default_rng(seed).normal(size=(dim, trees * levels))
    return (d / np.linalg.norm(d, axis=0)).astype(np.float32)


def usable(v):
    """True for vectors with finite components that are not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def grow(classes, trees, max_leaf, margin):
    """Written rows (node, tree, leaf): the leaves of every class in every tree."""
    n, dim = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    levels = max(1, math.ceil(math.log2(max(2, n / max_leaf))) + 3)
    schema = pa.schema([("node", pa.int64()), ("tree", pa.int32()), ("at", pa.list_(pa.float32()))])

    def project(batches):
        d = {}
        for rb in batches:
            node, vec = rb.column(0), rb.column(1).to_pylist()
            for size in {len(v) for v in vec}:  # vectors of another length are projected, and later compared, among themselves
                i = [j for j, v in enumerate(vec) if len(v) == size]
                if size not in d:
                    d[size] = directions(size, trees, levels)
                x = np.array([vec[j] for j in i], np.float64)
                p = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ d[size]).astype(np.float32).reshape(len(i) * trees, levels)
                who = node.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who.to_numpy(zero_copy_only=False), trees)), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(i))),
                                                  pa.array(list(p), pa.list_(pa.float32()))], schema=schema)

    rows = classes.select("node", "embedding").mapInArrow(project, "node bigint, tree int, at array<float>")
    rows = written(rows.select("node", "tree", F.xxhash64("tree").alias("leaf"), "at", F.lit(True).alias("open")), "forest")
    for level in range(levels):
        p = F.col("at")[level]
        split = rows.where("open").groupBy("leaf").agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("spread"))
        split = split.where((F.col("n") > max_leaf) & (F.col("spread") > margin)).drop("n", "spread")
        j = rows.join(split, "leaf", "left")
        side = lambda s: F.xxhash64("leaf", F.lit(level), F.lit(s))
        to = F.when(F.col("mean").isNull(), F.array("leaf")).otherwise(F.array_compact(F.array(
            F.when(p <= F.col("mean") + margin, side(0)), F.when(p >= F.col("mean") - margin, side(1)))))
        rows = written(j.select("node", "tree", F.explode(to).alias("leaf"), "at", F.col("mean").isNotNull().alias("open")), "forest")
    return rows.select("node", "tree", "leaf").distinct()


def compare(table, threshold):
    """Links of one leaf (or of a pair of its tiles): per vector the class sizes newly linked, and a leader of its links here.

    Columns: node, size, embedding, leaves (all leaves of the vector, in one order for all), leaf, i, j, tile.
    """
    out = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("leader", pa.int64())])
    node, size, tile = (table.column(c).to_numpy() for c in ("node", "size", "tile"))
    leaf, i, j = (table.column(c)[0].as_py() for c in ("leaf", "i", "j"))
    vec = table.column("embedding").to_pylist()
    dim = np.array([len(v) for v in vec])
    linked = np.zeros((len(node), len(node)), bool)
    for d in np.unique(dim):
        at = np.flatnonzero(dim == d)
        x = np.array([vec[a] for a in at], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        linked[np.ix_(at, at)] = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= tile[:, None] != tile[None, :]
    has = np.flatnonzero(linked.any(1))
    if not len(has):
        return out.empty_table()
    linked, node, size = linked[np.ix_(has, has)], node[has], size[has]
    leaves = table.column("leaves").take(pa.array(has)).to_pylist()
    here = leaf["tree"], leaf["leaf"]
    before = [[x for x in ((y["tree"], y["leaf"]) for y in own) if x < here] for own in leaves]
    number = {x: k for k, x in enumerate({x for own in before for x in own})}
    m = np.zeros((len(has), len(number)), np.float32)
    for a, own in enumerate(before):
        m[a, [number[x] for x in own]] = 1
    fresh = linked & ~((m @ m.T) > 0)
    leader = np.arange(len(has))
    while True:  # smallest index reachable here
        low = np.minimum(leader, np.where(linked, leader[None, :], len(has)).min(1))
        low = low[low]
        if (low == leader).all():
            break
        leader = low
    return pa.table([pa.array(node, pa.int64()), pa.array((fresh * size[None, :]).sum(1).astype(np.int64)), pa.array(node[leader], pa.int64())], schema=out)


def near_vectors(vectors, key="vec_id", column="embedding", threshold=0.9, trees=8, max_leaf=256, margin=0.02):
    """Rows (key, n_links, component_id, kept) of all vectors.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing, nor do vectors of different
    lengths. Rows with equal vectors link with each other, repeated keys included. component_id is the smallest key
    reachable (the row's own key if it links with nothing); NULL keys keep their rows and name a component only if it has
    no other key. An empty table gives no rows.
    """
    v = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(column).cast("array<float>").alias("embedding"))
    v = v.withColumn("node", F.when(usable(F.col("embedding")), F.xxhash64("embedding")))
    v = written(v, "vectors")
    classes = written(v.where("node is not null").groupBy("node", "embedding").agg(F.count("*").alias("size")), "classes")
    if classes.isEmpty():
        return v.select(F.col("id").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    leaves = written(grow(classes, trees, max_leaf, margin), "leaves")
    own = leaves.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("tree", "leaf"))).alias("leaves"))
    tiles = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    row = leaves.join(tiles, "leaf").join(own, "node").join(classes, "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("tile")).alias("i"), F.greatest(k, F.col("tile")).alias("j")))
    row = row.select("node", "size", "embedding", "leaves", F.struct("tree", "leaf").alias("leaf"), "tile", F.explode(pair).alias("p")).select("*", "p.i", "p.j").drop("p")
    found = written(row.groupBy("leaf", "i", "j").applyInArrow(lambda t: compare(t, threshold), "node bigint, links bigint, leader bigint"), "found")
    comp = components(found.select(F.col("node").alias("u"), F.col("leader").alias("v")))
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    c = written(classes.select("node", "size").join(total, "node", "left").join(comp, "node", "left")
                .select("node", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "linked")
    placed = v.join(c, "node", "left")
    least = placed.where("node is not null").groupBy("component").agg(F.min("id").alias("least"))
    out = placed.join(least, "component", "left")
    cid = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("id") == cid, F.lit(False)).alias("kept"))
