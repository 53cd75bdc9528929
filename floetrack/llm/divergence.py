"""Source divergence audit: joint tables of counts from one-hot level products.

Every (lang, source) group has one indicator column per count it gives to a kept term (its *levels*). The columns of all
groups, multiplied by their transpose, hold for each pair of groups how many terms have level a in one and level b in the
other: the pair's joint table, and all that a sum over terms of a function of two counts needs. The product is taken in
blocks: kept terms are dealt into blocks by hash, groups into tiles, and a task multiplies the columns of two tiles over one
block. Columns of level 0 are left out of the sparse product; their entries follow exactly from the margins. The joint
tables of the blocks add up, and so do their prices.
"""
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from floetrack.llm.common import release, written
from floetrack.llm.mixing import salted

SCALE = 10 ** 9
BLOCK_ENTRIES = 1 << 17
TILE_GROUPS = 32
CHUNK_PAIRS = 1 << 21
FLUSH = 1 << 18
SLICE = 1 << 20
#: letters and bytes of other characters stay (A-Z in lower case), everything else separates
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def slices(text):
    """Lists of terms of a text, a megabyte at a time."""
    b = text.translate(LETTERS)
    a = 0
    while a < len(b):
        z = len(b) if a + SLICE >= len(b) else b.find(b" ", a + SLICE)
        z = len(b) if z < 0 else z
        yield b[a:z].split()
        a = z


def tallies(docs, lang="lang", source="source", text="text"):
    """Partial counts (lang, source, term, n, docs) of bounded parts of the input; term NULL: the group occurs."""
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for a, c in (("lang", lang), ("source", source), ("text", text))])
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches):
        words, rows, held = defaultdict(Counter), defaultdict(Counter), 0

        def flush():
            for (g, s), n in words.items():
                seen, terms = rows[g, s], list(n)
                size = len(terms)
                yield pa.RecordBatch.from_arrays([pa.array([g] * (size + 1)), pa.array([s] * (size + 1)), pa.array([x.decode() for x in terms] + [None], pa.string()),
                                                  pa.array(list(n.values()) + [0], pa.int64()), pa.array([seen[x] for x in terms] + [0], pa.int64())], schema=schema)
            words.clear()
            rows.clear()

        for rb in batches:
            for g, s, x in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2).cast(pa.binary())):
                n, seen = words[g, s], set()
                before = len(n)
                for part in slices(x.as_py()):
                    n.update(part)
                    seen.update(part)
                rows[g, s].update(seen)
                held += len(n) - before
                if held >= FLUSH:
                    yield from flush()
                    held = 0
        yield from flush()
        release()

    return d.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")


def price(n, total):
    """p of a count: 1 + floor(SCALE * (n + 2) / total), in exact decimals."""
    return F.expr(f"1L + (cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(19,0))) div cast({total} as decimal(19,0))")


def cost(p, q):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def entries(docs, least=10, **columns):
    """(counts, groups): counts of kept terms (lang, source, term, n, lang_n, head; term NULL: the group occurs) and the groups.

    One shuffle by (lang, term) serves the counts of groups, of languages and the number of documents. ``head`` marks one row per
    kept term. A group has N + 2 V as ``total``, its language's as ``lang_total``, V as ``terms``, its tile and their numbers.
    """
    one = tallies(docs, **columns).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    one = one.withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "first": F.min("source").over(of_term)})
    one = one.where(F.col("term").isNull() | (F.col("lang_docs") >= least))
    head = (F.col("term").isNotNull() & (F.col("source") == F.col("first"))).cast("bigint")
    counts = written(one.select("lang", "source", "term", "n", "lang_n", head.alias("head")), "counts")
    groups = written(counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("head").alias("heads"), F.count("term").alias("rows")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("heads").alias("terms"), F.sum("n").alias("lang_words"), F.sum("rows").alias("lang_rows"), F.count("*").alias("sources"))
    g = groups.join(langs, "lang").withColumns({
        "total": F.col("n") + 2 * F.col("terms"), "lang_total": F.col("lang_words") + 2 * F.col("terms"),
        "blocks": F.greatest(F.lit(1), F.ceil(F.col("lang_rows") / BLOCK_ENTRIES)).cast("int"), "tiles": F.ceil(F.col("sources") / TILE_GROUPS).cast("int")})
    g = g.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    return counts, written(g.select("lang", "source", "total", "lang_total", "terms", "blocks", "tiles", "tile"), "groups")


def ranges(first, size):
    """first[i], first[i] + 1, ... (size[i] of them) for all i."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


class Product:
    """Joint tables of two tiles over one block: pairs of columns ``a``, ``b`` with the number of terms ``n`` in both.

    ``source`` and ``total`` by group, in order of tile and name; ``group`` and ``level`` by column. Every pair of groups
    (first tile, second tile; each pair once within one tile) has entries that add up to the number of terms of the block.
    """

    def __init__(self, t):
        term = t.column("term").combine_chunks().dictionary_encode()
        ids = np.asarray(term.indices.fill_null(-1).cast(pa.int64()))
        n, total, tile = (np.asarray(t.column(c).combine_chunks().fill_null(0)).astype(np.int64) for c in ("n", "total", "tile"))
        source = np.array(t.column("source").to_pylist(), object)
        there = np.flatnonzero(ids < 0)
        there = there[sorted(range(len(there)), key=lambda i: (tile[there[i]], source[there[i]].encode()))]
        self.source, self.total, tiles = source[there], total[there], tile[there]
        apart = t.column("low")[0].as_py() != t.column("high")[0].as_py()
        terms = int(np.asarray(t.column("heads").combine_chunks().fill_null(0))[there[0]]) if len(there) else 0
        number, k = {s: i for i, s in enumerate(self.source)}, len(there)
        rows = np.flatnonzero(ids >= 0)
        g = np.fromiter((number[s] for s in source[rows]), np.int64, len(rows))
        n, ids = n[rows], ids[rows]
        # columns: level 0 of every group, then the levels that occur, by group and level
        order = np.lexsort((n, g))
        new = np.ones(len(order), bool)
        new[1:] = (g[order][1:] != g[order][:-1]) | (n[order][1:] != n[order][:-1])
        col = np.empty(len(order), np.int64)
        col[order] = np.cumsum(new) - 1 + k
        self.group = np.concatenate([np.arange(k), g[order][new]])
        self.level = np.concatenate([np.zeros(k, np.int64), n[order][new]])
        width = len(self.group)
        order = np.lexsort((g, ids))
        col, ids, g = col[order], ids[order], g[order]
        after = np.searchsorted(ids, ids, "right") - np.arange(len(ids)) - 1
        codes, counts, at, ends = [], [], 0, np.cumsum(after)
        while at < len(ids):
            z = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_PAIRS, "right")))
            left = np.repeat(np.arange(at, z), after[at:z])
            right = ranges(np.arange(at, z) + 1, after[at:z])
            if apart:
                across = tiles[g[left]] != tiles[g[right]]
                left, right = left[across], right[across]
            u, c = np.unique(col[left] * width + col[right], return_counts=True)
            codes.append(u)
            counts.append(c)
            at = z
        codes, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, counts))
        u, inv = np.unique(codes, return_inverse=True)
        n = np.rint(np.bincount(inv, counts, len(u))).astype(np.int64)
        a, b = u // max(1, width), u % max(1, width)
        # level 0 from the margins: terms of a column less those that the other group has
        allowed = tiles[:, None] < tiles[None, :] if apart else np.triu(np.ones((k, k), bool), 1)
        margin = np.bincount(col, minlength=width)
        margin[:k] = 0
        left = margin[:, None] - np.bincount(a * k + self.group[b], n, width * k).astype(np.int64).reshape(width, k) if k else np.zeros((0, 0), np.int64)
        right = margin[:, None] - np.bincount(b * k + self.group[a], n, width * k).astype(np.int64).reshape(width, k) if k else np.zeros((0, 0), np.int64)
        left *= allowed[self.group]
        right *= allowed.T[self.group]
        both = np.full((k, k), terms) * allowed
        np.subtract.at(both, (self.group[a], self.group[b]), n)
        for c in range(k):
            own = self.group == c
            both[c, :] -= left[own].sum(0)
            both[:, c] -= right[own].sum(0)
        parts = [(a, b, n)]
        for x, turned in ((left, False), (right, True)):
            i, j = np.nonzero(x)
            parts.append((j, i, x[i, j]) if turned else (i, j, x[i, j]))
        i, j = np.nonzero(allowed)
        parts.append((i, j, both[i, j]))
        self.a, self.b, self.n = (np.concatenate([p[x] for p in parts]) for x in range(3))

    def p(self):
        return np.array([1 + SCALE * (int(x) + 2) // max(1, int(self.total[g])) for x, g in zip(self.level, self.group)], np.int64)

    def priced(self):
        """(first group, second group, sum over the joint table of n * floor((p - q)^2 / (p + q))), each pair once."""
        p, k = self.p(), len(self.source)
        x, y = p[self.a], p[self.b]
        pair = self.group[self.a] * k + self.group[self.b]
        u, inv = np.unique(pair, return_inverse=True)
        value = np.zeros(len(u), np.int64)
        np.add.at(value, inv, self.n * ((x - y) * (x - y) // (x + y)))
        return u // max(1, k), u % max(1, k), value


def tiled(counts, groups):
    """Entries and groups dealt to (lang, block, first tile, second tile); a group comes to every block with its number of terms."""
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    full = salted(counts.where("term is not null"), groups, ["lang", "source"], F.col("term")).withColumn("block", block)
    heads = full.groupBy("lang", "block").agg(F.sum("head").alias("heads"))
    there = groups.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).join(heads, ["lang", "block"], "left")
    cols = ["lang", "block", "source", "total", "tile", "tiles"]
    both = (full.select(*cols, "term", "n", F.lit(None).cast("bigint").alias("heads"))
            .unionByName(there.select(*cols, F.lit(None).cast("string").alias("term"), F.lit(None).cast("bigint").alias("n"), "heads")))
    both = both.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    return both.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other", "tiles")


def joint_tables(docs, least=10, **columns):
    """Rows (lang, source, other, level, other_level, terms): how many kept terms have these counts in the two sources.

    Each pair of sources of a language once; counts of 0 included, so that the terms of a pair add up to all kept terms.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("level", pa.int64()), ("other_level", pa.int64()), ("terms", pa.int64())])

    def joint(t):
        x = Product(t)
        some = x.n > 0
        a, b, n = x.a[some], x.b[some], x.n[some]
        lang = t.column("lang")[0].as_py()
        release()
        return pa.table([pa.array([lang] * len(n), pa.string()), pa.array(x.source[x.group[a]], pa.string()), pa.array(x.source[x.group[b]], pa.string()),
                         pa.array(x.level[a]), pa.array(x.level[b]), pa.array(n)], schema=schema)

    out = tiled(*entries(docs, least, **columns)).groupBy("lang", "block", "low", "high").applyInArrow(
        joint, "lang string, source string, other string, level bigint, other_level bigint, terms bigint")
    return out.groupBy("lang", "source", "other", "level", "other_level").agg(F.sum("terms").alias("terms"))


def audit(docs, least=10, top=10, **columns):
    """Rows (lang, source, part, item, value, rank): distances of sources of one language, and the terms that set a source apart.

    ``pair``: every other source of the language by the price of the joint table, dearest first. ``term``: the ``top`` kept terms of
    a source that it uses more than its language does. Ties in value go by item in UTF-8 order. NULL texts, languages and
    sources count as ''; repeated rows count again; a source alone in its language has no pair, a language without kept terms
    pairs of value 0; an empty table gives no rows. Other columns are not read.
    """
    counts, groups = entries(docs, least, **columns)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def pairs(t):
        x = Product(t)
        g, h, value = x.priced()
        lang = t.column("lang")[0].as_py()
        a, b = x.source[g], x.source[h]
        release()
        return pa.table([pa.array([lang] * (2 * len(g)), pa.string()), pa.array(np.concatenate([a, b]), pa.string()),
                         pa.array(np.concatenate([b, a]), pa.string()), pa.array(np.concatenate([value, value]))], schema=schema)

    priced = tiled(counts, groups).groupBy("lang", "block", "low", "high").applyInArrow(pairs, "lang string, source string, item string, value bigint")
    pair = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    used = salted(counts.where("term is not null and n > 0"), groups, ["lang", "source"], F.col("term"))
    used = used.withColumns({"p": price("n", "total"), "q": price("lang_n", "lang_total")}).where("p > q")
    term = used.select("lang", "source", F.col("term").alias("item"), cost("p", "q").alias("value"), F.lit("term").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
