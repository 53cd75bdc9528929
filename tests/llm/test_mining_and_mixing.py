"""Collocations, mixing and divergence against brute force on small hand-made tables."""
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from floetrack.llm import collocations as co
from floetrack.llm import divergence as dv
from floetrack.llm import mixing as mx

SCHEMA = "doc_id long, text string, lang string, source string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def docs(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    return d.withColumns({c: F.lit(1) for c in ("n", "a", "term", "block", "rank", "mark", "size", "bucket", "row", "part")})  # clashing names


def phrases(rows, top, least, absorb):
    counts, total = defaultdict(Counter), Counter()
    for _, t, g, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[g or "und"] += len(w)
            for k in range(1, 5):
                counts[g or "und"].update(zip(*[w[i:] for i in range(k)]))
    out = []
    for g, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= absorb * f[p[i:i + m]]}
        rows_ = []
        for p, a in cand.items():
            if p not in gone:
                s, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(g, r, p.decode(), -a, x, y, total[g], -s) for r, (s, a, p, x, y) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


def chatter(seed, n=120, words=9):
    r = random.Random(seed)
    vocab = ["The", "ice", "berg", "é", "\x00x", "drift", "Sea", "map", "of"][:words]
    fixed = ["the ice berg drift", "map of the sea", "of of of of", "é drift ice"]
    piece = lambda: r.choice(fixed) if r.random() < 0.35 else " ".join(r.choices(vocab, range(len(vocab), 0, -1), k=r.randint(0, 9)))
    rows = [(i, "".join(piece() + r.choice([". ", ",", "\n", "  \t", " ", "!?"]) for _ in range(6)), r.choice(["en", "en", "de", None]), "s") for i in range(n)]
    return rows + [(None, None, "en", None), (3, "", "fr", "s"), (3, "lone", "fr", "s"), rows[0], rows[0]]


@pytest.mark.parametrize("top,least,absorb,block", [(2000, 30, 80, 8 << 20), (5, 4, 80, 900), (12, 3, 60, 3000), (3, 2, 95, 100), (1, 5, 80, 1)])
def test_collocations_equal_counting_everything(spark, top, least, absorb, block):
    rows = chatter(top)
    got = co.collocations(docs(spark, rows).repartition(3), top=top, least=least, absorb=absorb, block_bytes=block)
    assert sorted(tuple(r) for r in got.collect()) == phrases(rows, top, least, absorb)


def test_collocations_of_little(spark):
    assert co.collocations(docs(spark, []), least=1).collect() == []
    assert co.collocations(docs(spark, [(1, None, None, None), (2, "one, two. three", "x", "")]), least=1).collect() == []


def test_ratio_does_not_pass_64_bits():
    import numpy as np
    a, s = 4 * 10 ** 15, 8 * 10 ** 15 + 12345
    assert co.ratio(np.array([a]), np.array([s]))[0] == 2000000 * a // s


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    pool, above = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in above]
        level = (pool - sum(2 * sizes[s] for s in above)) / sum(w[s] for s in free) if free else 0
        more = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in above else level * w[s] for s in names}
        above |= more


def test_mix_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mx, "FEW", 3)
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 3, 8, 40])) or None, "en", r.choice(["a", "a", "a", "B", "é", "", None])) for i in range(400)]
    rows += [(7, "x " * 3000, "en", "a"), (7, "same text", "en", "B"), (7, "same text", "en", "B"), (None, "no key\x0bhere", "en", None), (None, "", "en", "only"), (9, "\x0c one\ttwo ", "en", "tiny")]
    got = mx.mix(docs(spark, rows).repartition(4)).collect()
    again = mx.mix(docs(spark, rows[::-1]).repartition(7)).collect()
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.size, x.target, x.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(x.size for x in got) == sorted(size(t) for _, t, _, _ in rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    taken = defaultdict(int)
    for x in got:
        taken[x.source_size, x.target] += x.taken
        assert 0 <= x.taken <= 2 * x.size and x.taken == x.repeats * x.size + x.cut and 0 <= x.cut < max(1, x.size)
    assert set(taken) == {(sizes[s], want[s]) for s in sizes}
    assert all(n == int(t + 0.5) for (s, t), n in taken.items() if list(sizes.values()).count(s) == 1)
    texts = mx.repetitions(docs(spark, rows)).collect()
    assert sum(size(x.text) for x in texts) == sum(x.taken for x in got)


def test_mix_of_nothing(spark):
    assert mx.mix(docs(spark, [])).collect() == []
    assert [x.taken for x in mx.mix(docs(spark, [(1, None, "en", "a"), (2, " ", "en", None)])).collect()] == [0, 0]


def audited(rows, least, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    seen, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, g, s in rows:
        g, s = g or "", s or ""
        groups.add((g, s))
        seen[g].update(set(words(t)))
        count[g, s].update(words(t))
    out, tables = [], Counter()
    for g in {x for x, _ in groups}:
        kept, own = [t for t, n in seen[g].items() if n >= least], sorted(s for x, s in groups if x == g)
        p = {}
        for s in own:
            total = sum(count[g, s][t] for t in kept) + 2 * len(kept)
            p[s] = {t: 1 + 10 ** 9 * (count[g, s][t] + 2) // total for t in kept}
        all_ = Counter()
        for s in own:
            all_.update({t: count[g, s][t] for t in kept})
        q = {t: 1 + 10 ** 9 * (all_[t] + 2) // (sum(all_.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[g, s][t] and p[s][t] > q[t])[:top]
            out += [(g, s, part, i.decode(), -v, r) for part, x in (("pair", pair), ("term", term)) for r, (v, i) in enumerate(x, 1)]
            for o in own:
                if o != s:
                    tables.update((g, frozenset([(s, count[g, s][t]), (o, count[g, o][t])])) for t in kept)
    return sorted(out), {k: n // 2 for k, n in tables.items()}


def sources(seed):
    r = random.Random(seed)
    vocab = ["Ice", "ice", "sea", "Über", "été", "drift", "fog", "map", "x1", "berg", "floe", "ß"]
    rows = [(i, " ".join(r.choices(vocab, range(1, 13), k=r.randint(0, 25))) + "-" + r.choice(vocab), r.choice(["en", "en", "de", None]), r.choice(["a", "B", "é", None, "", "f", "g"])) for i in range(150)]
    return rows + [(1, None, "en", "empty"), (1, "rare word", "solo", "one"), (2, "", "solo", "two"), rows[3], rows[3], (None, "__ 12", "lone", "x")]


@pytest.mark.parametrize("tile,block", [(32, 1 << 17), (2, 1 << 17), (1, 20), (3, 40)])
def test_divergence_equals_plain_sums(spark, monkeypatch, tile, block):
    monkeypatch.setattr(dv, "TILE_GROUPS", tile)
    monkeypatch.setattr(dv, "BLOCK_ENTRIES", block)
    rows = sources(tile)
    want, tables = audited(rows, 10, 4)
    d = docs(spark, rows).repartition(3)
    assert sorted(tuple(r) for r in dv.audit(d, 10, 4).collect()) == want
    if block == 20:
        got = {(r.lang, frozenset([(r.source, r.level), (r.other, r.other_level)])): r.terms for r in dv.joint_tables(d, 10).collect()}
        assert got == tables


def test_divergence_of_nothing(spark):
    assert dv.audit(docs(spark, [])).collect() == []
    assert [tuple(r) for r in dv.audit(docs(spark, [(1, "a", "en", "x"), (2, None, "en", None)])).orderBy("source").collect()] == [
        ("en", "", "pair", "x", 0, 1), ("en", "x", "pair", "", 0, 1)]
