"""Phrase collocations by best-first branch-and-bound growth.

Phrases grow word by word from their prefixes. A phrase occurs at most as often as any part of it, and a cut's two sides are
counted exactly or occur at least as often as the phrase; so the counts of its parts bound its score from above before it is
counted. For each language a threshold is taken that the 2000th surviving score should reach, best first: the score of the
2000th two-word phrase that no longer phrase can absorb. Only prefixes with a bound at or above the threshold are grown, and
beside them the longer phrases that may absorb one of their candidates. If fewer than 2000 phrases at or above the threshold
survive, it falls to the next part of the frontier, down to 0; every phrase with a score at or above it, ties included, is then
counted exactly, so that the result is that of counting everything.

Texts become blocks of word numbers once (0 ends a piece and stands for every word under the least count). Each block asks
the bucket that owns a key about its distinct words, word pairs and triples (as in ``blocks``), so counts and identity
are exact: a pair is two word numbers, a triple the number of its first pair and a word, a quadruple the numbers of two pairs.
"""
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from floetrack.llm import blocks as B
from floetrack.llm import words as W
from floetrack.llm.common import release, written

SCALE = 2_000_000
LEAST, ABSORB, TOP = 30, 80, 2000
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
END = b"\xff"  # in no UTF-8 text
TABLE = bytes(255 if b in BREAKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
BUCKET_TOKENS = 4_000_000
MANY_BUCKETS = 4096  # beyond, the number of buckets grows with the square root of the input
LIMIT = 1 << 32


def tokens(text):
    """Words of a text, ``END`` between pieces."""
    return text.translate(TABLE).replace(END, b" \xff ").split()


def ratio(a, s):
    """floor(SCALE * a / s) for a <= s < 2^53, without passing 64 bits."""
    s = np.maximum(s, 1)
    x = a * 2000
    return x // s * 1000 + x % s * 1000 // s


def write_tokens(docs, lang, text, block_bytes):
    """Blocks (block, langs, totals, data): per language its number of words, distinct words, their counts and the sequence."""
    d = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = pa.schema([("block", pa.int64()), ("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("data", pa.binary())])

    def pack(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, {}, 0

        def flush():
            langs, totals, parts = sorted(held), [], []
            for g in langs:
                number = W.Interned({END: 0})
                at = number.numbers(held[g])
                count = np.bincount(at, minlength=len(number))
                totals.append(int(count[1:].sum()))
                parts.append(B.join_parts([W.pack_words(list(number)[1:]), B.pack_ints(count[1:]), B.squeeze(at.tobytes())]))
            row = [(part << 32) + seq, langs, totals, B.join_parts(parts)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        for rb in batches:
            for g, x in zip(rb.column(0).to_pylist(), rb.column(1).cast(pa.binary())):
                b = x.as_py()
                a = held.setdefault(g, [])
                a += tokens(b)
                a.append(END)
                size += len(b)
                if size >= block_bytes:
                    yield flush()
                    size, seq = 0, seq + 1
        if held:
            yield flush()
        release()

    return written(d.mapInArrow(pack, "block bigint, langs array<string>, totals array<bigint>, data binary"), "tokens", "uncompressed")


def rows_of(batches):
    """(block, langs, data, answers by bucket) of each row."""
    for rb in batches:
        names = rb.schema.names
        for i in range(rb.num_rows):
            get = lambda c: rb.column(names.index(c))[i].as_py()  # noqa: B023, E731
            got = [{x["bucket"]: x["reply"] for x in get(c) or []} for c in names if c.startswith("got")]
            yield get("block"), get("langs"), get("data"), got
    release()


def ask(blocks, emit, answer):
    """Replies (block, bucket, reply, found): ``emit(langs, data, got)`` yields (bucket, payload), ``answer(bucket, payloads)`` gives replies and what to keep."""
    sent = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
    back = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("reply", pa.binary()), ("found", pa.binary())])

    def send(batches):
        for block, langs, data, got in rows_of(batches):
            rows = list(emit(langs, data, got))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                                              pa.array([r[1] for r in rows], pa.binary())], schema=sent)

    def reply(t):
        t = t.sort_by("block")
        replies, found = answer(t.column("bucket")[0].as_py(), t.column("payload").to_pylist())
        release()
        return pa.table([t.column("block"), t.column("bucket"), pa.array(replies, pa.binary()), pa.array([found] + [None] * (t.num_rows - 1), pa.binary())], schema=back)

    out = blocks.mapInArrow(send, "block bigint, bucket int, payload binary").groupBy("bucket").applyInArrow(reply, "block bigint, bucket int, reply binary, found binary")
    return written(out, "replies", "uncompressed")


def told(blocks, replies, column):
    return B.attach(blocks, replies.select("block", "bucket", "reply"), column)


def found(replies, names, unpack=B.unpack_ints):
    """What the buckets kept, as rows of integers ``names``."""
    schema = pa.schema([(c, pa.int64()) for c in names])

    def rows(batches):
        for rb in batches:
            for x in rb.column(0).to_pylist():
                cols = [unpack(p).astype(np.int64) for p in B.split_parts(x)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)
        release()

    return replies.where("found is not null").select("found").mapInArrow(rows, ", ".join(f"{c} bigint" for c in names))


def owners(keys, n):
    """Order of sorted distinct ``keys`` by bucket, and where each of the ``n`` buckets begins in it."""
    bucket = (B.mix(keys.astype(np.uint64)) >> np.uint64(20)) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))


def send_counts(keys, counts, n):
    order, at = owners(keys, n)
    k, c = keys[order].astype(np.uint64), counts[order]
    return [(i, B.join_parts([B.pack_sorted(k[a:z]), B.pack_ints(c[a:z])])) for i, (a, z) in enumerate(zip(at, at[1:])) if z > a]


def read_counts(keys, got, n, width):
    """``width`` integers per key, in the order of ``keys``."""
    order, at = owners(keys, n)
    out = np.zeros((width, len(keys)), np.int64)
    for i, (a, z) in enumerate(zip(at, at[1:])):
        if z > a:
            for j, p in enumerate(B.split_parts(got[i])):
                out[j, order[a:z]] = B.unpack_ints(p).astype(np.int64)
    return out


def add_up(least, n, numbered):
    """Bucket side of ``send_counts``: total of each key (0 under ``least``) and, if ``numbered``, its number in the corpus."""
    def answer(bucket, payloads):
        asked = [B.split_parts(p) for p in payloads]
        keys = [B.unpack_sorted(a[0]) for a in asked]
        u, total, inv = B.merged(np.concatenate(keys), np.concatenate([B.unpack_ints(a[1]) for a in asked]).astype(np.float64))
        often = total >= least
        number = np.where(often, (np.cumsum(often) - 1) * n + bucket + 1, 0)
        if len(number) and int(number.max()) >= LIMIT:
            raise OverflowError("more frequent phrases than numbers of 32 bits")
        cols = [np.where(often, total, 0)] + ([number] if numbered else [])
        at, replies = np.cumsum([0] + [len(k) for k in keys]), []
        for a, z in zip(at, at[1:]):
            replies.append(B.join_parts([B.pack_ints(c[inv[a:z]]) for c in cols]))
        keep = [B.pack_ints(x[often]) for x in ((u >> np.uint64(32)), (u & np.uint64(LIMIT - 1)), total)] + ([B.pack_ints(number[often])] if numbered else [])
        return replies, B.join_parts(keep)
    return answer


class Line:
    """The words of a block in order, with what is known of the words and pairs at each position."""

    def __init__(self, langs, data):
        lang, number, count, at = B.split_parts(data)
        self.lang_of = B.unpack_ints(lang).astype(np.int64)
        self.number = np.concatenate([[0], B.unpack_ints(number).astype(np.int64)])
        self.count = np.concatenate([[0], B.unpack_ints(count).astype(np.int64)])
        self.at = np.frombuffer(B.expand(at), np.uint32).astype(np.int64)
        self.langs = langs

    def pairs(self):
        """Positions of two frequent words in one piece, and their keys."""
        a, b = self.at[:-1], self.at[1:]
        where = np.flatnonzero((a > 0) & (b > 0))
        return where, (self.number[a[where]] << 32) + self.number[b[where]]


def wanted_pairs(line):
    where, keys = line.pairs()
    u, inv, c = np.unique(keys, return_inverse=True, return_counts=True)
    return where, u, inv, c


class Growth:
    """Which triples and quadruples of a block are grown at the thresholds ``level`` (by language; 0 if absent)."""

    def __init__(self, line, got, n, level, rules):
        least, absorb = rules
        m = len(line.at)
        where, u, inv, _ = wanted_pairs(line)
        count, number = read_counts(u, got[0], n, 2)
        pad = lambda x: np.concatenate([x, np.zeros(4, np.int64)])
        self.pair, self.pair_number = np.zeros(m + 4, np.int64), np.zeros(m + 4, np.int64)
        self.pair[where], self.pair_number[where] = count[inv], number[inv]
        self.f, self.word = pad(line.count[line.at]), pad(line.number[line.at])
        per_lang = np.array([level.get(g, 0) for g in line.langs] or [0], np.int64)
        t = pad(np.concatenate([[0], per_lang[line.lang_of]])[line.at])
        f, p, i = self.f, self.pair, np.flatnonzero((self.pair[:-1] > 0) & (self.pair[1:] > 0))
        # triples: by their own bound, by that of a quadruple that begins or ends with them, or as what may absorb a pair; the choice
        # depends on the words alone, never on their neighbours, so that a triple is counted everywhere or nowhere
        most = np.minimum(p[i], p[i + 1])
        grow = np.minimum(ratio(most, f[i] + p[i + 1]), ratio(most, p[i] + f[i + 2])) >= t[i]
        grow |= np.maximum(ratio(most, f[i] + most), ratio(most, most + f[i + 2])) >= t[i]
        for j in (i, i + 1):
            grow |= (ratio(p[j], f[j] + f[j + 1]) >= t[i]) & (100 * most >= absorb * p[j])
        self.asked = np.zeros(m + 4, bool)
        self.asked[i[grow]] = True
        four = i[p[i + 2] > 0]
        self.t, self.four, self.absorb, self.least = t, four, absorb, least

    def triples(self):
        i = np.flatnonzero(self.asked)
        return i, (self.pair_number[i] << 32) + self.word[i + 2]

    def quadruples(self, got, n):
        """Keys of the quadruples that are grown, given the counts of the triples."""
        i, keys = self.triples()
        u, inv = np.unique(keys, return_inverse=True)
        (count,) = read_counts(u, got[1], n, 1)
        three = np.zeros(len(self.f), np.int64)
        three[i] = count[inv]
        q, f, p, t = self.four, self.f, self.pair, self.t[self.four]
        most = lambda j: np.where(self.asked[j], three[j], np.minimum(p[j], p[j + 1]))
        a = np.minimum(most(q), most(q + 1))
        known = self.asked[q] & self.asked[q + 1]
        bound = np.minimum(ratio(a, f[q] + three[q + 1]), np.minimum(ratio(a, p[q] + p[q + 2]), ratio(a, three[q] + f[q + 3])))
        grow = known & (bound >= t)
        for j, first in ((q, True), (q + 1, False)):
            own = np.minimum(ratio(three[j], f[j] + p[j + 1]), ratio(three[j], p[j] + f[j + 2]))
            grow |= self.asked[j] & (own >= t) & (100 * a >= self.absorb * three[j])
        grow &= a >= self.least
        q = q[grow]
        return (self.pair_number[q] << 32) + self.pair_number[q + 2]


def score(a, *cuts):
    """Lowest floor(SCALE * a / (l + r)) over the cuts (k, l, r), the smallest k first among equal ones: a struct (score, k, l, r)."""
    each = [F.struct(F.expr(f"(cast({SCALE} as decimal(10,0)) * cast({a} as decimal(19,0))) div cast({le} + {r} as decimal(19,0))").alias("score"), F.lit(k).alias("k"),
                     F.col(le).alias("l"), F.col(r).alias("r")) for k, (le, r) in enumerate(cuts, 1)]
    return F.least(*each) if len(each) > 1 else each[0]


def buckets(n_tokens):
    x = n_tokens / BUCKET_TOKENS
    return max(1, math.ceil(x if x <= MANY_BUCKETS else math.sqrt(x * MANY_BUCKETS)))


def word_blocks(docs, lang, text, least, block_bytes):
    """(lines, words, totals, buckets): blocks of word numbers, frequent words (number, lang, word, f), words per language."""
    t = write_tokens(docs, lang, text, block_bytes)
    totals = written(t.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n")), "totals")
    n = buckets(totals.agg(F.sum("n")).first()[0] or 0)

    def keys_of(langs, data):
        keys, counts, lines = [], [], []
        for g, part in zip(langs, B.split_parts(data)):
            names, count, at = B.split_parts(part)
            head = g.encode() + END
            own = [head + w for w in W.unpack_words(names)]
            lines.append((len(keys), len(own), at))
            keys += own
            counts.append(B.unpack_ints(count))
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)) % np.uint64(n)
        order = np.argsort(h, kind="stable")
        return keys, np.concatenate(counts) if counts else np.zeros(0, np.uint64), lines, order, np.searchsorted(h[order], np.arange(n + 1, dtype=np.uint64))

    def emit(langs, data, got):
        keys, counts, _, order, at = keys_of(langs, data)
        return [(i, B.join_parts([W.pack_words([keys[j] for j in order[a:z]]), B.pack_ints(counts[order[a:z]])])) for i, (a, z) in enumerate(zip(at, at[1:])) if z > a]

    def answer(bucket, payloads):
        total, asked = {}, []
        for p in payloads:
            names, counts = B.split_parts(p)
            names = W.unpack_words(names)
            asked.append(names)
            for w, c in zip(names, B.unpack_ints(counts).tolist()):
                total[w] = total.get(w, 0) + c
        often = sorted(w for w, c in total.items() if c >= least)
        number = {w: k * n + bucket + 1 for k, w in enumerate(often)}
        if len(often) * n >= LIMIT:
            raise OverflowError("more frequent words than numbers of 32 bits")
        replies = []
        for names in asked:
            k = np.fromiter((number.get(w, 0) for w in names), np.int64, len(names))
            c = np.fromiter((total[w] for w in names), np.int64, len(names))
            replies.append(B.join_parts([B.pack_ints(k), B.pack_ints(np.where(k > 0, c, 0))]))
        keep = B.join_parts([W.pack_words(often), B.pack_ints([number[w] for w in often]), B.pack_ints([total[w] for w in often])])
        return replies, keep

    replies = ask(t.select("block", "langs", "data"), emit, answer)

    def names(batches):
        for rb in batches:
            for x in rb.column(0).to_pylist():
                keys, number, f = B.split_parts(x)
                cut = [k.split(END, 1) for k in W.unpack_words(keys)]
                yield pa.RecordBatch.from_arrays([pa.array(B.unpack_ints(number).astype(np.int64)), pa.array([c[0].decode() for c in cut], pa.string()),
                                                  pa.array([c[1].decode() for c in cut], pa.string()), pa.array(B.unpack_ints(f).astype(np.int64))], names=["number", "lang", "word", "f"])

    words = written(replies.where("found is not null").select("found").mapInArrow(names, "number bigint, lang string, word string, f bigint"), "words")
    out = pa.schema([("block", pa.int64()), ("langs", pa.list_(pa.string())), ("data", pa.binary())])

    def number(batches):
        for block, langs, data, got in rows_of(batches):
            keys, _, lines, order, at = keys_of(langs, data)
            k, f = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for i, (a, z) in enumerate(zip(at, at[1:])):
                if z > a:
                    k[order[a:z]], f[order[a:z]] = (B.unpack_ints(x).astype(np.int64) for x in B.split_parts(got[0][i]))
            local = np.cumsum(k > 0) * (k > 0)
            lang_of, seq = np.zeros(len(keys), np.int64), []
            for g, (first, size, at_) in enumerate(lines):
                lang_of[first:first + size] = g
                seq.append(np.concatenate([[0], local[first:first + size]])[np.frombuffer(B.expand(at_), np.uint32)])
            s = np.concatenate(seq) if seq else np.zeros(0, np.int64)
            s = s[np.append(True, (s[1:] > 0) | (s[:-1] > 0))] if len(s) else s
            kept = k > 0
            row = [block, langs, B.join_parts([B.pack_ints(lang_of[kept]), B.pack_ints(k[kept]), B.pack_ints(f[kept]), B.squeeze(s.astype(np.uint32).tobytes())])]
            yield pa.RecordBatch.from_arrays([pa.array([v], ty) for v, ty in zip(row, out.types)], schema=out)

    lines = written(told(t.select("block", "langs", "data"), replies, "got").mapInArrow(number, "block bigint, langs array<string>, data binary"), "lines", "uncompressed")
    return lines, words, totals, n


def collocations(docs, lang="lang", text="text", top=TOP, least=LEAST, absorb=ABSORB, block_bytes=B.BLOCK_BYTES):
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to four words.

    NULL languages are ``und``, NULL texts empty; repeated rows count again; ties in score go by count, then by phrase in UTF-8
    order; a language without frequent phrases has no rows, nor has an empty table. Other columns are not read. A text longer
    than a block is a block of its own. Thresholds come to the driver as one number per language.
    """
    lines, words, totals, n = word_blocks(docs, lang, text, least, block_bytes)

    def emit_pairs(langs, data, got):
        _, u, _, c = wanted_pairs(Line(langs, data))
        return send_counts(u, c, n)

    replies2 = ask(lines, emit_pairs, add_up(least, n, True))
    f = words.select(F.col("number").alias("w"), "lang", "f")
    p = found(replies2, ["w1", "w2", "a", "id"])
    p = p.join(f.withColumnsRenamed({"w": "w1", "f": "f1"}), "w1").join(f.drop("lang").withColumnsRenamed({"w": "w2", "f": "f2"}), "w2")
    pairs = written(p.withColumn("cut", score("a", ("f1", "f2"))), "pairs")

    # best first: the score of the top-th pair that nothing can absorb, else that of a later one
    left = pairs.groupBy(F.col("w2").alias("w1")).agg(F.max("a").alias("before"))
    right = pairs.groupBy(F.col("w1").alias("w2")).agg(F.max("a").alias("after"))
    open_ = f"100 * greatest(coalesce(before, 0), coalesce(after, 0)) >= {absorb} * a"
    seen = pairs.join(left, "w1", "left").join(right, "w2", "left").select("lang", F.expr(open_).alias("open"), F.col("cut.score").alias("score"))
    seen = written(seen, "seen")

    def nth(rows, k):
        r = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
        return {x["lang"]: x["score"] for x in rows.select("lang", "score", r.alias("r")).where(F.col("r") <= k).groupBy("lang").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k).collect()}

    depth = 2 * top
    level = nth(seen, depth) | nth(seen.where("not open"), top)
    while True:
        rows = written(grown(lines, pairs, replies2, level, n, least, absorb), "grown")
        alive = {x["lang"]: x["count"] for x in rows.where("alive").groupBy("lang").count().collect()}
        short = [g for g, t in level.items() if t > 0 and alive.get(g, 0) < top]
        if not short:
            break
        depth *= 4
        below = nth(seen, depth)
        level = level | {g: min(below.get(g, 0), level[g] // 2) for g in short}

    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    name = words.select("number", "word")
    rows = rows.where("alive")
    for i in range(1, 5):
        rows = rows.join(name.withColumnsRenamed({"number": f"w{i}", "word": f"x{i}"}), f"w{i}", "left")
    rows = rows.withColumn("phrase", F.concat_ws(" ", "x1", "x2", "x3", "x4")).join(totals, "lang").withColumn("rank", first).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def grown(lines, pairs, replies2, level, n, least, absorb):
    """Candidates with a score at or above their language's ``level``: (lang, w1..w4, a, cut, alive)."""
    rules = (least, absorb)
    two = told(lines, replies2, "got2")

    def emit_triples(langs, data, got):
        _, keys = Growth(Line(langs, data), got, n, level, rules).triples()
        u, c = np.unique(keys, return_counts=True)
        return send_counts(u, c, n)

    replies3 = ask(two, emit_triples, add_up(least, n, False))
    schema = pa.schema([("b1", pa.int64()), ("b3", pa.int64()), ("a", pa.int64())])

    def emit_quadruples(batches):
        for _, langs, data, got in rows_of(batches):
            u, c = np.unique(Growth(Line(langs, data), got, n, level, rules).quadruples(got, n), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u >> 32), pa.array(u & (LIMIT - 1)), pa.array(c.astype(np.int64))], schema=schema)

    four = told(two, replies3, "got3").mapInArrow(emit_quadruples, "b1 bigint, b3 bigint, a bigint").groupBy("b1", "b3").agg(F.sum("a").alias("a"))
    four = written(four.where(F.col("a") >= least), "quadruples")
    three = found(replies3, ["b1", "w3", "a"])
    one = pairs.select(F.col("id").alias("b1"), "lang", "w1", "w2", F.col("a").alias("a12"), "f1", "f2")
    next_ = pairs.select(F.col("id").alias("b2"), F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"), F.col("f2").alias("f3"))
    three = written(three.join(one, "b1").join(next_, ["w2", "w3"]).withColumn("cut", score("a", ("f1", "a23"), ("a12", "f3"))), "triples")
    last = pairs.select(F.col("id").alias("b3"), F.col("w1").alias("w3"), F.col("w2").alias("w4"), F.col("a").alias("a34"), F.col("f2").alias("f4"))
    four = four.join(one, "b1").join(last, "b3")
    t1 = three.select("w1", "w2", "w3", F.col("a").alias("a123"))
    t2 = three.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("a").alias("a234"))
    four = written(four.join(t1, ["w1", "w2", "w3"], "left").join(t2, ["w2", "w3", "w4"], "left"), "quadruples")
    over3 = four.select("w1", "w2", "w3", "a").unionByName(four.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("w4").alias("w3"), "a"))
    over3 = over3.groupBy("w1", "w2", "w3").agg(F.max("a").alias("longer"))
    over2 = three.select(F.col("b1").alias("id"), "a").unionByName(three.select(F.col("b2").alias("id"), "a")).groupBy("id").agg(F.max("a").alias("longer"))
    alive = F.expr(f"coalesce(100 * longer < {absorb} * a, true)")
    blank = lambda d, *c: d.withColumns({x: F.lit(None).cast("bigint") for x in c})
    cols = ["lang", "w1", "w2", "w3", "w4", "a", "cut", "alive"]
    a = blank(pairs.join(over2, "id", "left").withColumn("alive", alive), "w3", "w4").select(cols)
    b = blank(three.join(over3, ["w1", "w2", "w3"], "left").withColumn("alive", alive), "w4").select(cols)
    c = four.where("a123 is not null and a234 is not null").withColumn("cut", score("a", ("f1", "a234"), ("a12", "a34"), ("a123", "f4"))).withColumn("alive", F.lit(True)).select(cols)
    rows = a.unionByName(b).unionByName(c)
    # one number per language, kept as a small table
    spark = rows.sparkSession
    at = spark.createDataFrame(list(level.items()) or [("", 0)], "lang string, level bigint")
    return rows.join(F.broadcast(at), "lang", "left").where(F.col("cut.score") >= F.coalesce(F.col("level"), F.lit(0))).drop("level")
