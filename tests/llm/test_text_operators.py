"""Text operators against brute force on small tables with NULLs, empty and long texts, ties, repeated rows and clashing columns."""
import base64
import collections
import hashlib
import math
import random
import types
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from floetrack.llm import bytebpe, exact, jaccard, katz, packing, pfp

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, block int, node string, key string, n int, digest string, `row` string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma's", "délta", "x1", "42", "ΣΑΣ", "naïve", "…", "don't", " ", "日本語", "a.b", "(c)"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(8)]
    out = []
    for i in range(60):
        x = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = rng.choice(words)
        out.append((i, rng.choice([" ", "  ", "\n", " \t"]).join(x)))
    out += [(100, None), (101, ""), (102, " \n\t "), (103, "a" * 3000), (104, "ab " * 4000), (105, base[0]), (105, base[0]), (106, base[0].replace(" ", "")),
            (None, "lone text without an id"), (107, "\x1c\x1d a b 　 c"), (108, "tail  "), (109, " lead"), (110, "I'LL we'll 've")]
    rows = [(a, b, "en", "s", 0, 1, "n", "k", 2, "d", "r") for a, b in out]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    order = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_byte_bpe(spark, docs):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    want = []
    for i, t in pairs(docs):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(bytebpe.digests(docs, path, P.PATTERN).collect(), want)
    assert bytebpe.digests(docs.limit(0), path, P.PATTERN).count() == 0


def test_packing(spark, docs):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    r = packing.pack_documents(docs, P.path("word_bpe_49k.json"), size=64).collect()
    texts = {i: t for i, t in pairs(docs)}
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    for x in r:
        own = ids[x.doc_id]
        assert x.doc_tokens == len(own) and x.ids_crc32 == zlib.crc32(own[x.start:x.start + x.length].tobytes()) and 1 <= x.length <= 64
    copies = collections.Counter(i for i, _ in pairs(docs))
    assert sum(x.length for x in r) == sum(len(ids[i]) * c for i, c in copies.items())
    by = collections.defaultdict(list)
    for x in r:
        by[x.sequence_id].append(x)
    for s in by.values():
        at = 0
        for x in sorted(s, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 64 and {x.padded_length for x in s} == {at if at & (at - 1) == 0 else 64}
    assert sorted(by) == list(range(len(by)))
    assert packing.pack_documents(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_packing_special_tokens(spark):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["one<|endoftext|>Two", "<|startoftext|> a <|endoftext|>", "<|ENDOFTEXT|> x", "<|endoftext|><|endoftext|>", "<|endoftext| >", "don<|startoftext|>'t"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = packing.pieces(d, P.path("word_bpe_49k.json")).select("doc_id", "length", "ids_crc32").collect()
    ids = [np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4") for t in texts]
    same(got, [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)])


@pytest.mark.parametrize("ranked", [50_000, 3])
def test_ranks_are_whole_for_any_group_size(spark, ranked, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", ranked)
    p = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(0).alias("start"), F.when(F.col("id") < 70, 5).otherwise(F.col("id") % 7 + 1).alias("length"))
    r, hist = packing.ranked(p)
    seen = collections.defaultdict(list)
    for x in r.collect():
        seen[x.length].append(x.rank)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in hist.items()}


def test_shortest_pack_first_places_all():
    rng = random.Random(1)
    hist = {rng.randint(1, 100): rng.randint(1, 1000) for _ in range(60)}
    packs = packing.shortest_pack_first(hist, 100)
    got = collections.Counter()
    for lengths, n in packs:
        assert sum(lengths) <= 100
        for x in lengths:
            got[x] += n
    assert got == hist


def katz_brute(rows, order):
    k = katz.K
    tok = lambda t: (t or "").encode().lower().split() + ["E"]
    c = [collections.Counter() for _ in range(order)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for i, t in rows:
        if not held(i):
            x = ["S"] * (order - 1) + tok(t)
            for j in range(order - 1, len(x)):
                for m in range(order):
                    c[m][tuple(x[j - m:j + 1])] += 1
    d = [katz.good_turing([sum(v == r for v in x.values()) for r in range(1, k + 2)]) for x in c]
    dd = lambda m, n: n * (d[m][n] if n <= k else 1)
    n, v = sum(c[0].values()), len(c[0])
    left = n - sum(dd(0, x) for x in c[0].values())
    total, unknown = n + (left <= 1e-9), left if left > 1e-9 else 1
    follow = [collections.defaultdict(dict) for _ in range(order)]
    for m in range(1, order):
        for g, x in c[m].items():
            follow[m][g[:-1]][g[-1]] = x

    def p(m, h, w):
        if m == 0:
            return dd(0, c[0][(w,)]) / total if (w,) in c[0] else unknown / total
        f = follow[m].get(h)
        if not f:
            return p(m - 1, h[1:], w)
        own, mass = sum(f.values()), sum(dd(m, x) for x in f.values())
        den = own + (own - mass <= 1e-9 * own)
        return dd(m, f[w]) / den if w in f else (den - mass) / den / (1 - sum(p(m - 1, h[1:], y) for y in f)) * p(m - 1, h[1:], w)

    for h in list(follow[order - 1])[:4]:  # exactly normalised over the known words and the unknown class
        assert abs(sum(p(order - 1, h, w) for (w,) in c[0]) + p(order - 1, h, "?") - 1) < 1e-9
    out = []
    for i, t in rows:
        x = ["S"] * (order - 1) + tok(t)
        real = range(order - 1, len(x))
        out.append((i, held(i), len(real), sum((x[j],) in c[0] for j in real), n, sum(math.log10((c[0].get((x[j],), 0) + 1) / (n + v + 1)) for j in real),
                    sum(math.log10(p(order - 1, tuple(x[j - order + 1:j]), x[j])) for j in real)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(spark, docs, order):
    d = docs.where("coalesce(doc_id, 0) != 104")
    cols = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    key = lambda x: tuple((v is None, str(v)) for v in x[:4])
    got = sorted(map(tuple, katz.score_held_out(d, order).select(*cols, "base_score", "score").collect()), key=key)
    want = sorted(katz_brute(pairs(d), order), key=key)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-8, atol=1e-9)


def test_katz_empty(spark, docs):
    assert katz.score_held_out(docs.limit(0)).count() == 0
    alone = katz.score(docs.where("doc_id = 101"), F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.score) for r in alone] == [(1, 0, 0.0)]


def cut_brute(rows, length):
    c, raw = collections.Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        c.update(b[j:j + length] for j in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        g = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if c[b[j:j + length]] > 1:
                g[j:j + length] = b"\1" * length
        out.append((i, len(b), sum(g), sum(g[k] and (k == 0 or not g[k - 1]) for k in range(len(g))), hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,every,block", [(40, 8, 8, 3000), (40, 8, 3, 100), (100, 16, 32, 1 << 20)])
def test_repeated_passages(spark, docs, length, gram, every, block):
    rng = random.Random(length)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 700))) for _ in range(10)]
    more = []
    for i in range(50):
        x = "".join(rng.choice("abé ") for _ in range(rng.randint(0, 150)))
        for _ in range(rng.randint(0, 3)):
            y = rng.choice(base)
            a = rng.randint(0, len(y))
            x += y[a:a + rng.randint(0, 300)] + "".join(rng.choice("abcde") for _ in range(rng.randint(0, 40)))
        more.append((1000 + i, x))
    more += [(1100, "z" * (length - 1)), (1101, "y" * length), (1102, "y" * (length - 1)), (1103, "ab" * 200)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string")).repartition(4)
    got = pfp.cut_repeats(d, length=length, gram=gram, every=every, block_bytes=block, keep_text=True).collect()
    same([tuple(r)[:5] for r in got], cut_brute(pairs(d), length))
    for r in got:
        assert sum(x.end - x.begin for x in r.spans) == r.n_removed and all(a.end <= b.begin for a, b in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize("block", [400, 1 << 20])
def test_triggers_at_the_edges_of_documents(spark, block):
    length, gram, every = 100, 8, 8
    rng = random.Random(block)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))

    def edged(n, at_end):
        """Noise of about n bytes with a trigger at its first byte, or one that ends at its last byte."""
        while True:
            x = noise(n + 80).encode()
            t = pfp.Parse(types.SimpleNamespace(data=x, starts=np.array([0, len(x)])), length, gram, every).t
            t = t[(t + gram >= n)] if at_end else t[t <= 80]
            if len(t):
                return x[:t[0] + gram].decode() if at_end else x[t[0]:].decode()

    texts = []
    for _ in range(30):
        x = edged(120, False)[:rng.randint(80, 99)]  # a shared head too short to be a repeat
        texts += [x + noise(150), noise(150) + x + noise(150)]
        x = edged(120, True)[-rng.randint(80, 99):]  # and a shared tail
        texts += [noise(150) + x, noise(150) + x + noise(150)]
    for _ in range(15):
        x = edged(250, False)  # repeats that others share but for the first bytes, or with other bytes before them
        texts += [x + noise(60), x + noise(50), noise(150) + x[rng.randint(0, 5):150] + noise(60)]
        x = edged(250, True)
        texts += [noise(60) + x, noise(50) + x, noise(60) + x[-150:len(x) - rng.randint(0, 5)] + noise(150)]
    rng.shuffle(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = pfp.cut_repeats(d, length=length, gram=gram, every=every, block_bytes=block).drop("spans").collect()
    same([tuple(r) for r in got], cut_brute(pairs(d), length))


def test_repeated_passages_empty(spark, docs):
    assert pfp.cut_repeats(docs.limit(0)).count() == 0
    assert [r.n_removed for r in pfp.cut_repeats(docs.where("doc_id in (100, 101)")).collect()] == [0, 0]


def jaccard_brute(rows, k, percent):
    sets, ids = [], [i for i, _ in rows]
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    p = list(range(len(rows)))

    def f(x):
        while p[x] != x:
            x = p[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p[f(a)] = f(b)
    least = {}
    for a, i in enumerate(ids):
        if i is not None:
            least[f(a)] = min(least.get(f(a), i), i)
    return [(i, len(sets[a]), least.get(f(a)) if sets[a] else i) for a, i in enumerate(ids)]


@pytest.mark.parametrize("k,percent,block", [(2, 70, 2000), (4, 85, 1 << 20), (1, 60, 500)])
def test_jaccard_join(spark, docs, k, percent, block):
    same(jaccard.near_duplicates(docs, k=k, percent=percent, block_bytes=block).collect(), jaccard_brute(pairs(docs), k, percent))


def test_hot_keys_are_dealt_in_bounded_tiles(spark, monkeypatch):
    """Texts of one template, too far apart for leaders to join, meet in many small groups and still find every link."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(60)]
    own = lambda x, m: [rng.choice(["u", "v"]) + str(rng.random()) if rng.random() < m else w for w in x]
    texts = [own(base[:rng.randint(30, 60)], 0.2) for _ in range(90)]
    texts += [own(x, 0.05) for x in texts[:40]]
    rows = list(enumerate(" ".join(x) for x in texts))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    sizes = []
    plain = jaccard.dealt

    def seen(r, percent):
        out = plain(r, percent)
        sizes.extend(x["count"] for x in out.groupBy("part", "x", "i", "y", "j").count().where("x is not null").collect())
        return out

    monkeypatch.setattr(jaccard, "TILE_ROWS", 5)
    monkeypatch.setattr(jaccard, "STARS", 1)
    monkeypatch.setattr(jaccard, "dealt", seen)
    same(jaccard.near_duplicates(d, k=1, percent=80).collect(), jaccard_brute(rows, 1, 80))
    assert len(sizes) > 20 and max(sizes) <= 30


def test_jaccard_empty(spark, docs):
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_bit_counts_never_reject_a_link():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 64, rng.integers(1, 300), dtype=np.uint64))
        keep = rng.random(len(x)) < rng.choice([0.7, 0.9, 1.0])
        y = np.unique(np.concatenate([x[keep], rng.integers(0, 1 << 64, rng.integers(0, 30), dtype=np.uint64)]))
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            assert jaccard.may_link(jaccard.signature(x), len(x), jaccard.signature(y), len(y), 85)


@pytest.mark.parametrize("batch", [1 << 30, 2000])
def test_exact_dedup(spark, docs, batch):
    d = docs.where("doc_id is null or doc_id != 105").unionByName(docs.where("doc_id = 105").limit(1))
    rows = pairs(d)
    drop = dict.fromkeys(map(ord, "\x20\x09\x0a\x0b\x0c\x0d"))
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(drop)].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for i, t in rows:
        n = (t or "").translate(drop)
        g = groups[n]
        want.append((i, min(g)[3], len(g), min(g)[3] == i, hashlib.sha256(n.encode()).hexdigest()))
    same(exact.dedup(d, max_bytes=batch).drop("locator").collect(), want)


def test_exact_dedup_repeats_and_empty(spark, docs):
    r = exact.dedup(docs).where("doc_id = 105").collect()
    assert len(r) == 2 and len({(x.keep_id, x.group_size, x.kept) for x in r}) == 1
    assert exact.dedup(docs.limit(0)).count() == 0
