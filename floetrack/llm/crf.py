"""Toxic spans by a linear-chain conditional random field.

Tokens of a bounded sample of labelled documents get their labels from the documents': a word (or a long word's beginning)
that occurs in toxic documents only marks its tokens. The field learns a weight for each of a token's hashed features and
the transitions; forward-backward marginals then tag every token of every whole text, give the offending offsets and add up
to a score for the document.
"""
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from floetrack.llm.common import crc_mod, release, written

TOKEN = re.compile(r"[^\W_]+")
BITS = 18  # size of the hashed feature table
PREFIX = (4, 5, 6, 7)


def beginnings(word):
    return [f"{word[:n]}*" for n in PREFIX if len(word) > n]


def features(word):
    """Hashed features of a token: the word, its beginnings, its length class."""
    names = ["w" + word] + beginnings(word) + [f"l{min(len(word), 12)}"]
    return [xxhash.xxh3_64_intdigest(x) >> (64 - BITS) for x in names]


def marginals(score, begin, trans, segment=None):
    """P(tag 1) at each token of chains laid end to end.

    ``score``: log-odds of tag 1 from a token's features; ``begin``: True where a chain begins; ``trans``: log weights
    [[00, 01], [10, 11]]. The chains are cut into equal segments whose 2 x 2 products are found together, then linked.
    """
    n = len(score)
    if not n:
        return np.zeros(0)
    length = segment or max(1, int(np.sqrt(n)))
    k = -(-n // length)
    e = np.ones((k * length, 2))
    e[:n, 1] = np.exp(np.clip(score, -30, 30))
    t = np.exp(np.asarray(trans, float))
    step = np.broadcast_to(t, (k * length, 2, 2)).copy()
    step[:n][begin] = 1.0  # a chain's first token does not see the one before it
    step[n:] = 1.0
    step = (step * e[:, None, :]).reshape(k, length, 2, 2)
    prod = np.broadcast_to(np.eye(2), (k, 2, 2)).copy()
    for i in range(length):
        prod = prod @ step[:, i]
        prod /= prod.sum((1, 2), keepdims=True)
    v, left = np.array([0.5, 0.5]), np.empty((k, 2))
    for j in range(k):
        left[j] = v
        v = v @ prod[j]
        v /= v.sum()
    v, right = np.array([1.0, 1.0]), np.empty((k, 2))
    for j in range(k - 1, -1, -1):
        right[j] = v
        v = prod[j] @ v
        v /= v.sum()
    alpha, beta = np.empty((k, length, 2)), np.empty((k, length, 2))
    for i in range(length):
        left = (left[:, None, :] @ step[:, i])[:, 0]
        left /= left.sum(1, keepdims=True)
        alpha[:, i] = left
    for i in range(length - 1, -1, -1):
        beta[:, i] = right
        right = (step[:, i] @ right[:, :, None])[:, :, 0]
        right /= right.sum(1, keepdims=True)
    both = (alpha * beta).reshape(-1, 2)[:n]
    return both[:, 1] / both.sum(1)


def chain_begins(lengths):
    b = np.zeros(int(sum(lengths)), bool)
    at = np.cumsum([0] + list(lengths))[:-1]
    b[at[np.asarray(lengths) > 0]] = True
    return b


def seed_words(rows, purity=0.9, chance=1e-7, limit=50_000):
    """Words and beginnings that occur in toxic documents and in few others, more often than by chance: at most ``limit``.

    Counted by Spark over all labelled rows of the fit, once per document. With a share s of toxic rows, a word seen in b
    toxic rows only needs s ** b below ``chance``.
    """
    share = rows.agg(F.avg("toxic")).first()[0] or 0.5
    least = max(3, int(np.ceil(np.log(chance) / np.log(min(share, 0.5)))))

    def run(batches):
        for rb in batches:
            w, y, n = [], [], []
            for text, toxic in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                own = set(TOKEN.findall(text.lower()))
                own |= {b for x in own for b in beginnings(x)}
                w += own
                y += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(y, pa.int32())], names=["w", "y"])

    c = rows.select("text", "toxic").mapInArrow(run, "w string, y int").groupBy("w").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    top = c.where((F.col("bad") >= least) & (F.col("bad") >= purity * F.col("n"))).orderBy(F.desc("bad"), "w").limit(limit)
    return [r.w for r in top.collect()]


def supported(candidates, texts, need=3, enough=2):
    """The candidates that ``need`` or more toxic texts require: texts with ``enough`` accepted words ask for no others.

    Near-copies of one toxic text share all their words; only the words that other texts share too are kept.
    """
    where, known = {}, set(candidates)
    for i, t in enumerate(texts):
        for x in set(TOKEN.findall(t.lower())):
            for w in {x, *beginnings(x)} & known:
                where.setdefault(w, set()).add((i, x))
    has, out = [set() for _ in texts], set()
    for w in candidates:
        if len({i for i, x in where.get(w, ()) if len(has[i] - {x}) < enough}) >= need:
            out.add(w)
            for i, x in where[w]:
                has[i].add(x)
    return out


def fit(docs, labels, train, key="doc_id", text="text", most=1000, rounds=30):
    """Learn from labelled rows where ``train`` holds; None if either class is missing.

    Bounds (of the fit only): the seed words are counted over at most 8 x ``most`` labelled rows, the field sees at most
    ``most`` rows of each class; both take the rows with the smallest hash of the key. NULL labels are left out; a row
    labelled more than once counts as toxic if any label says so. Rows with equal texts count once.
    """
    y = labels.where("toxic is not null").groupBy(F.col(key).cast("bigint").alias("key")).agg(F.max("toxic").alias("toxic"))
    d = docs.where(train).where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    y = y.withColumn("h", F.xxhash64("key"))
    n = {r.toxic: r.n for r in y.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def cut(cls, m):  # hash below which about m rows of a class lie
        share = min(1.0, 1.5 * m / max(1, n.get(cls, 0)))
        return F.col("h") <= int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else F.lit(True)

    bad, good = F.col("toxic") == 1, F.col("toxic") == 0
    chosen = y.where((bad & cut(1, 4 * most)) | (good & cut(0, 4 * most)))
    rows = d.join(F.broadcast(chosen), "key").select("text", "toxic", "h")  # about 12 x `most` rows at most: texts are not shuffled
    rows = written(rows.dropDuplicates(["text"]), "labelled")  # copies would count a word again and again
    seeds = seed_words(rows)  # the most frequent first
    pick = []
    for cls in (1, 0):
        pick += rows.where(F.col("toxic") == cls).orderBy("h").limit(most).collect()
    if len({r.toxic for r in pick}) < 2:
        return None
    seeds = supported(seeds, [r.text for r in pick if r.toxic == 1])
    vocab, seq, lengths, tags, doc = {}, [], [], [], []
    for r in pick:
        ws = TOKEN.findall(r.text.lower())
        seq += [vocab.setdefault(w, len(vocab)) for w in ws]
        lengths.append(len(ws))
        tags += [r.toxic] * len(ws)
        doc.append(r.toxic)
    words = list(vocab)
    seq, tags = np.array(seq, np.int32), np.array(tags, np.int8)
    seeded = np.array([w in seeds or not seeds.isdisjoint(beginnings(w)) for w in words])
    gold = (tags == 1) & seeded[seq]
    feats = [features(w) for w in words]
    owner = np.repeat(np.arange(len(words)), [len(f) for f in feats])
    flat = np.array([x for f in feats for x in f])
    begin = chain_begins(lengths)
    weight, trans = np.zeros(1 << BITS), np.zeros((2, 2))
    g2, t2 = np.full(1 << BITS, 1e-3), np.full((2, 2), 1e-3)
    emit = lambda: np.bincount(owner, weight[flat], len(words))
    pair = gold[:-1].astype(int) * 2 + gold[1:]
    inner = ~begin[1:]
    for _ in range(rounds):  # gradient of the log-likelihood, with AdaGrad steps and a small L2 term
        p = marginals(emit()[seq] - 1.0, begin, trans)
        gw = np.bincount(flat, np.bincount(seq, gold - p, len(words))[owner], 1 << BITS) / len(pick) - 1e-5 * weight
        q = (np.stack([1 - p[:-1], p[:-1]])[:, None, :] * np.stack([1 - p[1:], p[1:]])[None]).reshape(4, -1)
        # pair expectations by the neighbours' marginals: exact when they are certain, as they are once trained
        gt = (np.bincount(pair[inner], minlength=4) - q[:, inner].sum(1)).reshape(2, 2) / max(1, inner.sum()) - 1e-4 * trans
        g2 += gw * gw
        t2 += gt * gt
        weight += 0.5 * gw / np.sqrt(g2)
        trans += 0.1 * gt / np.sqrt(t2)
    model = {"weight": weight.astype(np.float32), "trans": trans}
    x = summaries(marginals(emit()[seq] - 1.0, begin, trans), lengths)
    doc, w = np.array(doc, float), np.zeros(x.shape[1])
    for _ in range(300):  # logistic regression on the documents' sums
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (s * (1 - s) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (doc - s) - 1e-2 * w)
    return model | {"doc": w}


def summaries(p, lengths):
    """Per document: 1 and the sum of the marginals of 0.5 or more, at most 3 (0 for empty texts).

    Lower marginals are left out: over a long text they add up to as much as a toxic word.
    """
    p = np.where(p >= 0.5, p, 0.0)
    at = np.cumsum([0] + list(lengths))
    has = np.asarray(lengths) > 0
    total = np.zeros(len(lengths))
    if has.any():
        total[has] = np.add.reduceat(p, at[:-1][has])
    return np.stack([np.ones(len(lengths)), np.minimum(total, 3.0)], 1)


class Emissions(dict):
    """Cache word -> log-odds from its features."""

    def __init__(self, weight, limit=1 << 18):
        super().__init__()
        self.weight, self.limit = weight, limit

    def __missing__(self, w):
        if len(self) >= self.limit:
            self.clear()
        e = self[w] = float(self.weight[features(w)].sum()) - 1.0
        return e


def tag(docs, model, key="doc_id", text="text", threshold=0.5, step_tokens=1 << 19):
    """Rows (key, score, spans) of every whole text; spans: array of (begin, end) code points of runs of toxic tokens.

    NULL and empty texts have no spans and the score of a text without toxic tokens; without a model every score is 0.
    """
    schema = pa.schema([(key, pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])

    def run(batches):
        cache = Emissions(model["weight"]) if model else None

        def flush(held):
            ids, texts, e = zip(*held)
            lengths = [len(x) for x in e]
            if not model:
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([0.0] * len(ids)), pa.array([[]] * len(ids), schema.types[2])], schema=schema)
            p = marginals(np.concatenate(e), chain_begins(lengths), model["trans"])
            s = 1 / (1 + np.exp(-np.clip(summaries(p, lengths) @ model["doc"], -30, 30)))
            at, spans = np.cumsum([0] + lengths), []
            hit = np.zeros(len(lengths), bool)
            hit[np.searchsorted(at, np.flatnonzero(p >= threshold), "right") - 1] = True
            for i, x in enumerate(texts):
                own = []
                if hit[i]:
                    last = -2
                    for j, m in enumerate(TOKEN.finditer(x)):
                        if p[at[i] + j] >= threshold:
                            if last == j - 1:
                                own[-1]["end"] = m.end()
                            else:
                                own.append({"begin": m.start(), "end": m.end()})
                            last = j
                spans.append(own)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s), pa.array(spans, schema.types[2])], schema=schema)

        for rb in batches:
            held, size = [], 0
            for i, x in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                # tokens are matched in the text itself, so that offsets are its own; each is then lower-cased
                x = x or ""
                low = x.lower()
                ws = TOKEN.findall(low) if len(low) == len(x) else [w.lower() for w in TOKEN.findall(x)]
                e = np.fromiter(map(cache.__getitem__, ws), float, len(ws)) if model else np.zeros(len(ws))
                held.append((i, x, e))
                size += len(ws)
                if size >= step_tokens:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)
        cache = None
        release()

    cols = docs.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text"))
    return cols.mapInArrow(run, f"{key} bigint, score double, spans array<struct<begin:int,end:int>>")


def score_held_out(docs, labels, key="doc_id", text="text", cutoff=0.7):
    """Learn from two of three hash classes of the key; score all rows; ``predicted`` is 1 from ``cutoff`` on."""
    held = crc_mod(key, 3) == 1
    out = tag(docs, fit(docs, labels, ~held, key, text), key, text)
    return out.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
