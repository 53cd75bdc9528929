"""n-gram Jaccard join: size-banded tiles with hashed bitmap signatures, exact sorted-array intersection.

Each class of documents with one and the same shingle set is a node. A set's shingles are ordered rarest first (by the number
of classes that hold them); two sets that are similar enough share a shingle among the first n - ceil(t n) + 1 of each, so
only those that another class holds too are kept as tile keys. Within a tile (key and size band) everything is first held
against one leader, then what is still apart against other leaders; classes that this leaves apart are compared across the
key's tiles, bitmap against bitmap, and the survivors exactly. A key too large for one task is dealt out as pairs of tiles of
bounded size. Classes already in one component are never compared.
"""
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from floetrack.llm import blocks as B
from floetrack.llm import words as W
from floetrack.llm.common import components, written

SALT = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts, k):
    """Per text (UTF-8 bytes) the sorted distinct hashes of its k-word shingles; of all its words if there are fewer."""
    each = [W.hashed(W.lower_words(x)) for x in texts]
    words = np.array([len(x) for x in each], np.int64)
    w = np.concatenate(each) if each else np.zeros(0, np.uint64)
    end = np.repeat(np.cumsum(words), words)
    size = np.minimum(k, np.repeat(words, words))
    h = size.astype(np.uint64)
    for i in range(k):
        on = size > i
        h[on] = B.mix(h[on] * SALT + w[np.minimum(np.flatnonzero(on) + i, len(w) - 1)])
    whole = np.arange(len(w)) + size <= end
    n = np.maximum(words - k + 1, np.minimum(words, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    h = h[whole]
    return [np.unique(h[x:y]) for x, y in zip(at, at[1:])]


TILE_ROWS, TILE_BYTES = 2048, 4 << 20  # of one tile of a hot key
STARS = 4  # turns of leaders before the rest is compared in full


def node_of(s):
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signature(s):
    """Bitmap of four to eight bits per element: element h sets bit h mod 2**b."""
    bits = max(64, 4 << (len(s) - 1).bit_length())
    b = np.zeros(bits, np.uint8)
    b[(s >> np.uint64(40)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(b, bitorder="little")


def folded(sig, size):
    """Signatures (rows) of twice, four times ... the size brought to ``size`` bytes."""
    while sig.shape[-1] > size:
        h = sig.shape[-1] // 2
        sig = sig[..., :h] | sig[..., h:]
    return sig


def may_link(x, nx, y, ny, percent):
    """False where bit counts rule the link out: bits of one set that the other lacks are elements it lacks."""
    size = min(x.shape[-1], y.shape[-1])
    x, y = folded(x, size), folded(y, size)
    lone_x = np.bitwise_count(x & ~y).sum(-1, dtype=np.int64)
    lone_y = np.bitwise_count(y & ~x).sum(-1, dtype=np.int64)
    most = np.minimum(nx - lone_x, ny - lone_y)
    return most * (100 + percent) >= percent * (nx + ny)


def sets(docs, key, text, k, percent, block_bytes):
    """(members, candidates): member rows (key, n, node), and per class with shared prefix shingles its keys, signature and set."""
    t = B.write_blocks(docs, key, text, block_bytes=block_bytes)
    n = B.bucket_count(t)
    schema = pa.schema([("block", pa.int64()), ("pos", pa.int32()), (key, pa.int64()), ("n", pa.int64()), ("node", pa.int64())])

    def members(batches):
        for b, _ in B.each_block(batches):
            s = shingles(b.texts(), k)
            yield W.table([[b.block] * len(s), list(range(len(s))), b.ids, [len(x) for x in s], [node_of(x) for x in s]], schema)

    m = written(t.mapInArrow(members, f"block bigint, pos int, {key} bigint, n bigint, node bigint"), "members")
    # one document stands for all with its set
    stand = m.where("n > 0").groupBy("node").agg(F.min(F.struct("block", "pos")).alias("s")).groupBy("s.block").agg(F.collect_list("s.pos").alias("stand"))
    own = written(stand.select("block", F.lit(0).alias("bucket"), F.to_binary(F.array_join(F.array_sort("stand"), ","), F.lit("utf-8")).alias("reply")), "stand")
    at = B.attach(t, own, "got_stand")

    def standing(b, got):
        texts = b.texts()
        return shingles([texts[int(i)] for i in got["got_stand"].get(0, b"").decode().split(",") if i], k)

    def frequencies(b, got):
        s = standing(b, got)
        if s:
            u, c, _ = B.merged(np.concatenate(s) >> np.uint64(24))
            yield from B.send_sorted(u, [c], n, 40)

    # counted by 40 bits of the hash: a clash makes a shingle look more frequent, which changes no result
    totals = lambda p: (B.tallied(p, lambda inv, size, owner, c: np.rint(np.bincount(inv, c, size)).astype(np.int64)[inv]), [])
    df = written(B.exchange(at, frequencies, totals).drop("stats"), "shinglecounts", "uncompressed")
    schema2 = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("signature", pa.binary()), ("shingles", pa.binary())])

    def candidates(batches):
        for b, got in B.each_block(batches):
            s = standing(b, got)
            if not s:
                continue
            u = np.unique(np.concatenate(s) >> np.uint64(24))
            count = B.read_sorted(got["got"], n)
            out = [[] for _ in schema2]
            for x in s:
                c = count[np.searchsorted(u, x >> np.uint64(24))]
                first = len(x) + (-percent * len(x)) // 100 + 1
                if (c == 1).sum() < first:
                    at = np.argsort(np.minimum(c, 65535).astype(np.uint16), kind="stable")[:first]
                    keys = x[at[c[at] > 1]]
                    for col, v in zip(out, (node_of(x), len(x), keys.view(np.int64).tolist(), signature(x).tobytes(), B.pack_sorted(x))):
                        col.append(v)
            yield W.table(out, schema2)

    c = B.attach(at, df).mapInArrow(candidates, "node bigint, n bigint, keys array<bigint>, signature binary, shingles binary")
    return m, written(c, "candidates", "uncompressed")


def links(pairs, cand, percent, screened=False):
    """Of pairs (a, b) those that link: bit counts first (unless the pairs passed them), then the exact intersection of the sorted sets."""
    side = lambda x, cols: cand.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    small = pairs.join(side("a", ["n", "signature"]), "a").join(side("b", ["n", "signature"]), "b").select("a", "b", "n_a", "n_b", "signature_a", "signature_b")

    def bits(batches):
        for rb in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in rb.columns)
            ok = [bool(may_link(np.frombuffer(p, np.uint8), i, np.frombuffer(q, np.uint8), j, percent)) for i, j, p, q in zip(na, nb, x, y)]
            yield rb.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def exact(batches):
        for rb in batches:
            a, b, x, y = (c.to_pylist() for c in rb.columns)
            out, last = [[], []], (None, None)
            for i, j, p, q in zip(a, b, x, y):
                if last[0] != j:
                    last = j, B.unpack_sorted(q)
                p = B.unpack_sorted(p)
                both = len(np.intersect1d(p, last[1], assume_unique=True))
                if 100 * both >= percent * (len(p) + len(last[1]) - both):
                    out[0].append(i)
                    out[1].append(j)
            yield W.table(out, schema)

    left = pairs if screened else written(small.mapInArrow(bits, "a bigint, b bigint"), "maybe")
    full = left.join(side("a", ["shingles"]), "a").join(side("b", ["shingles"]), "b").select("a", "b", "shingles_a", "shingles_b")
    return written(full.mapInArrow(exact, "a bigint, b bigint"), "links")


def dealt(rows, percent):
    """Rows by the group they are compared in: columns part, x, i, y, j, tile beside those of ``across``.

    Small keys share groups. A key above TILE_ROWS or TILE_BYTES is cut into size bands and these into tiles by the hash of the
    node; each pair of tiles of one band or of neighbouring bands is a group of its own (sets further apart cannot link).
    """
    band = F.floor(F.log("n") / np.log(100 / percent) + 1e-9)  # a ratio of exactly 100 / percent stays within one band's step
    rows = rows.withColumn("band", band.cast("int")).withColumn("bytes", F.octet_length("signature") + 8 * F.size("keys") + 64)
    tiles = F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("bytes") / TILE_BYTES)).cast("int")
    total = rows.agg(F.count("*"), F.sum("bytes")).first()
    groups = max(1, total[0] // 5_000, (total[1] or 0) // (4 * TILE_BYTES))
    hot = written(rows.groupBy("key").agg(tiles.alias("tiles")).where("tiles > 1").select("key"), "hot")
    size = rows.join(hot, "key").groupBy("key", "band").agg(tiles.alias("tiles"))
    bands = written(size.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", "tiles"))).alias("bands")), "bands")
    rows = rows.join(bands, "key", "left").withColumn("tile", F.expr("cast(pmod(xxhash64(node), bands[band]) as int)"))
    shape = "named_struct('x', {}, 'i', {}, 'y', {}, 'j', {})".format
    none = "cast(array() as array<struct<x:int,i:int,y:int,j:int>>)"
    each = lambda b, to: f"case when try_element_at(bands, {b}) > 0 then transform(sequence(0, try_element_at(bands, {b}) - 1), k -> {to}) else {none} end"
    pairs = (f"concat({each('band', shape('band', 'least(k, tile)', 'band', 'greatest(k, tile)'))}, "
             f"{each('band + 1', shape('band', 'tile', 'band + 1', 'k'))}, {each('band - 1', shape('band - 1', 'k', 'band', 'tile'))})")
    rows = rows.withColumn("pair", F.explode(F.expr(f"case when bands is null then array(cast(null as struct<x:int,i:int,y:int,j:int>)) else {pairs} end")))
    part = F.when(F.col("bands").isNull(), F.pmod(F.xxhash64("key"), F.lit(groups))).otherwise(F.col("key"))
    # within a pair of two tiles only rows of different ones meet
    tile = F.when(F.struct("pair.x", "pair.i") != F.struct("pair.y", "pair.j"), F.xxhash64("band", "tile"))
    return rows.select("key", "node", "n", "component", "signature", "keys", part.alias("part"), "pair.*", tile.alias("tile"))


def across(rows, percent):
    """Pairs of one key's nodes in different components that sizes and bit counts let pass; each under its lowest common key only.

    rows: key, node, n, component, signature, keys (all keys of the node).
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table):
        table = table.sort_by([("key", "ascending"), ("n", "ascending")])
        key, node, n, comp = (table.column(c).to_numpy() for c in ("key", "node", "n", "component"))
        tile = table.column("tile").fill_null(0).to_numpy()
        cross = table.column("tile").null_count == 0
        sig = [np.frombuffer(x, np.uint8) for x in table.column("signature").to_pylist()]
        long = np.array([len(x) for x in sig])
        # signatures of one length as one matrix, and the row of each there
        by, row = {}, np.zeros(len(sig), np.int64)
        for size in np.unique(long):
            at = np.flatnonzero(long == size)
            by[size], row[at] = np.stack([sig[x] for x in at]), np.arange(len(at))
        keys = [np.sort(x.values.to_numpy()) for x in table.column("keys").combine_chunks()]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
        out = set()
        for s, e in zip(begin, np.append(begin[1:], len(key))):
            for i in range(s, e - 1):
                z = s + np.searchsorted(n[s:e], n[i] * 100 // percent, "right")
                j = np.arange(i + 1, z)
                j = j[(comp[j] != comp[i]) & (tile[j] != tile[i] if cross else True)]
                for size in np.unique(long[j]):
                    at = j[long[j] == size]
                    ok = may_link(sig[i][None], n[i], by[size][row[at]], n[at], percent)
                    out.update((min(node[i], node[x]), max(node[i], node[x])) for x in at[ok] if np.intersect1d(keys[i], keys[x], assume_unique=True)[0] == key[i])
        return pa.table([pa.array([int(x[0]) for x in out], pa.int64()), pa.array([int(x[1]) for x in out], pa.int64())], schema=schema)

    return dealt(rows, percent).groupBy("part", "x", "i", "y", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs, key="doc_id", text="text", k=4, percent=85, block_bytes=B.BLOCK_BYTES):
    """Rows (key, n_shingles, component_id) of all documents.

    Two documents link when 100 |A & B| >= ``percent`` |A | B| of their shingle sets; component_id is the smallest key
    reachable by links. Texts without words (empty, NULL) have no shingles and link with nothing: their component is their
    own key, NULL for a NULL key. NULL keys never name a component that has another key. Repeated rows have equal sets and
    so one component. An empty table gives no rows.
    """
    m, cand = sets(docs, key, text, k, percent, block_bytes)
    rows = written(cand.select("node", "n", F.explode("keys").alias("key")), "tiles")
    every, at = cand.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), written(rows.withColumn("component", F.col("node")), "placed")

    def place(found):
        """Components of all links so far, and the tile rows of keys that still hold several."""
        comp = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
        now = rows.join(comp, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
        several = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
        return comp, written(now.join(several, "key"), "placed")

    comp = None
    for turn in range(STARS):
        band = F.floor(F.log("n") / np.log(100 / percent) + (turn % 2) / 2)  # every other turn the bands overlap the last ones
        tiles = at.withColumn("band", band)
        order = F.struct(F.col("n") if not turn else F.xxhash64("node", F.lit(turn)), "node", "n", "component")
        lead = tiles.groupBy("key", "band").agg(F.min(order).alias("lead"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").drop("lo", "hi")
        star = tiles.join(lead, ["key", "band"]).where("component != lead.component").select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
        found = links(written(star.distinct(), "stars"), cand, percent)
        every = every.unionByName(found)
        comp, at = place(every)
        if at.isEmpty():
            break
    rest = at.join(cand.select("node", "signature", "keys"), "node")
    second = links(written(across(rest, percent).distinct(), "across"), cand, percent, screened=True)
    comp = components(every.unionByName(second).select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = written(m.join(comp, "node", "left").select(key, "n", F.coalesce("component", "node").alias("component")), "components")
    least = placed.where("n > 0").groupBy("component").agg(F.min(key).alias("least"))
    return placed.join(least, "component", "left").select(key, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col(key)).alias("component_id"))
