"""Archive, vectors, classifiers, components and the pipeline."""
import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from floetrack.llm import centroid, crf, forest, warc
from floetrack.llm.common import components


def test_warc(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://b\r\nWARC-Type: evil", "é" * 50), (4, "http://c", None), (5, "http://c", ""), (6, "u", "x"), (6, "u", "x"),
            (None, "u", "x"), (None, "u", "only null"), (-7, "u", "neg"), (8, "u", "WARC-Type: revisit\r\n\r\nbody" * 2000)]
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, sha256 string, kind int").repartition(3)
    path = warc.write_archive(d)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -10**9), -10**9 if i is None else i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        t = top[h or ""] if top[h or ""] > -10**9 else None
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == t else "revisit", None if i == t else t))
    order = lambda x: tuple((v is None, str(v)) for v in x)
    listed = warc.listing(spark, path)
    assert sorted(map(tuple, listed.drop("record_bytes").collect()), key=order) == sorted(want, key=order)
    got = warc.rebuild(spark, path).collect()
    assert sorted(len(r.record) for r in got) == sorted(r.record_bytes for r in listed.select("record_bytes").collect())
    line = lambda r, name: dict(x.split(": ", 1) for x in bytes(r.header).decode().split("\r\n")[1:] if x).get(name)
    named = {line(r, "WARC-Record-ID"): r for r in got if line(r, "WARC-Type") == "response"}
    for r in got:  # a revisit refers to a response of the archive with its payload
        if line(r, "WARC-Type") == "revisit":
            first = named[line(r, "WARC-Refers-To")]
            assert bytes(first.payload) == bytes(r.payload) and str(first.page_id) == line(r, "X-Refers-To-Page-ID")
    assert len(got) == len(rows)
    for r in got:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: re") and head.count(b"\r\nWARC-Type:") == 1
        assert body == (bytes(r.payload) if b"WARC-Type: response" in head.split(b"\r\n") else b"") + b"\r\n\r\n"
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.where("sha256 = sha2('x', 256)").count() <= 2 and stored.select("sha256").distinct().count() == len(top)
    small = warc.listing(spark, warc.write_archive(d, min_bytes=10)).where("payload_bytes < 10").select("record_type").distinct().collect()
    assert [r[0] for r in small] == ["response"]
    assert warc.listing(spark, warc.write_archive(d.limit(0))).count() == 0


def test_warc_damage_is_found(spark):
    d = spark.createDataFrame([(1, "u", "abc")], "page_id bigint, url string, html string")
    path = warc.write_archive(d)
    spark.createDataFrame([(hashlib.sha256(b"abc").hexdigest(), bytearray(b"abd"))], "sha256 string, payload binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="digest|disagree"):
        warc.listing(spark, path).collect()


def vectors_brute(rows, threshold):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    deg, p = [0] * len(rows), list(range(len(rows)))

    def f(x):
        while p[x] != x:
            x = p[x]
        return x
    for d in {len(rows[i][1]) for i in ok}:
        at = [i for i in ok if len(rows[i][1]) == d]
        x = np.array([rows[i][1] for i in at], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                deg[at[a]] += 1
                p[f(at[a])] = f(at[b])
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[f(i)] = min(least.get(f(i), a), a)
    return [(a, deg[i], least.get(f(i)), a is not None and a == least.get(f(i))) for i, (a, _) in enumerate(rows)]


@pytest.mark.parametrize("tile", [2048, 60])
def test_forest(spark, tile, monkeypatch):
    monkeypatch.setattr(forest, "TILE", tile)
    rng = np.random.default_rng(1)
    c = rng.normal(size=(12, 16))
    rows = [(i, (c[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.02, 0.1])).astype(np.float32).tolist()) for i in range(500)]
    rows += [(900 + i, rows[3][1]) for i in range(100)] + [(1000, None), (1001, [0.0] * 16), (1002, [1.0, None] + [0.0] * 14), (1003, [float("nan")] * 16),
                                                           (1004, [1.0, 2.0]), (1005, [2.0, 4.0]), (1006, []), (None, rows[5][1]), (1007, [float("inf")] * 16), (7, rows[7][1])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, node int")
    order = lambda x: tuple((v is None, str(v)) for v in x)
    got, want = (sorted(map(tuple, x), key=order) for x in (forest.near_vectors(d, max_leaf=64).collect(), vectors_brute(rows, 0.9)))
    assert [(x[0], x[2], x[3]) for x in got] == [(x[0], x[2], x[3]) for x in want]
    found, there = (sum(x[1] for x in y) for y in (got, want))
    assert found <= there and found >= 0.999 * there  # recall of links; none below the threshold
    assert all(a[1] <= b[1] for a, b in zip(got, want))
    assert forest.near_vectors(d.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(150)] + [(5000, 2000 + i) for i in range(100)] + [(7, 7)]
    p = {}

    def f(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x
    for a, b in edges:
        u, v = f(a), f(b)
        p[max(u, v)] = min(u, v)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: f(x) for x in p if x != 7}


def lang_docs(spark, n=60):
    rng = random.Random(3)
    stems = {"aa": ["thorn", "shall", "which"], "bb": ["était", "eaux", "quoi"], "cc": ["ungen", "schaft", "über"]}
    rows = [(i, " ".join(rng.choice(stems[g]) + rng.choice("xyz") for _ in range(rng.randint(1, 60))), g) for i, g in enumerate(rng.choices(list(stems), k=n))]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", None), (903, "thorny shall", None), (None, "which shall", "aa"), (904, "é" * 50_000, None), (905, "Q", "cc")]
    return spark.createDataFrame([(*r, "s", 0, 0.5) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double").repartition(2)


def test_language(spark):
    d = lang_docs(spark)
    got = {r.doc_id: r for r in centroid.identify(d).collect()}
    truth = {r.doc_id: r.lang for r in d.collect()}
    assert len(got) == len(truth)
    assert all(got[i].lang_pred == truth[i] for i in range(60)) and any(got[i].held_out for i in range(60))
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and got[903].lang_pred == "aa"
    nothing = centroid.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(truth)
    assert centroid.identify(d.limit(0)).count() == 0


def test_marginals_match_plain_forward_backward():
    rng = np.random.default_rng(0)
    lengths, trans = [5, 1, 0, 30, 21], rng.normal(size=(2, 2))
    score = rng.normal(size=57) * 2
    want, i, t = [], 0, np.exp(trans)
    for n in lengths:
        if n:
            e = [np.array([1, np.exp(x)]) for x in score[i:i + n]]
            a, b = [e[0]], [np.ones(2)]
            for x in e[1:]:
                a.append((a[-1] @ t) * x)
            for x in e[:0:-1]:
                b.append(t @ (x * b[-1]))
            want += [(x * y)[1] / (x * y).sum() for x, y in zip(a, b[::-1])]
        i += n
    for segment in (None, 1, 4, 57, 100):
        assert np.allclose(crf.marginals(score, crf.chain_begins(lengths), trans, segment), want)


def test_toxicity(spark):
    rng = random.Random(4)
    plain, bad = [f"word{i}" for i in range(200)], ["grumbol", "snarfle", "zotwick"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad)
        w += [rng.choice(bad)] * 2 * toxic
        rows.append((i, " ".join(w).capitalize() + "."))
        if i % 10:
            labels.append((i, 0, int(toxic)))
    rows += [(900, None), (901, ""), (902, "Grumbol, snarfle! İ zotwick grumbol"), (None, "word1 word2"), (903, "word3 " * 20_000)]
    labels += [(1, 0, None), (5, 1, 0), (5, 1, 0), (99999, 0, 1)]
    d = spark.createDataFrame([(*r, "en", 1.0) for r in rows], "doc_id bigint, text string, lang string, score double").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in crf.score_held_out(d, lab).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(400) if got[i].held_out]
    assert held and all(got[i].predicted == int(i % 4 == 0) for i in held)
    assert all(got[i].predicted == 0 and not got[i].spans for i in (900, 901, None, 903)) and got[902].predicted == 1
    assert [(s.begin, s.end) for s in got[902].spans][0][0] == 0 and all(0 <= r.score <= 1 for r in got.values())
    none = crf.score_held_out(d, lab.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)} and len(none) == len(rows)
    assert crf.score_held_out(d.limit(0), lab).count() == 0


def test_pipeline_stages(spark):
    """Each stage on hand-made rows whose outcome is known."""
    rng = random.Random(9)
    word = lambda: rng.choice(["thorn", "shall", "which", "other"]) + "".join(rng.choice("abcdefgh") for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, near = text(80), text(120)
    rows = [(i, text(60)) for i in range(30)]
    rows += [(100, rows[3][1]), (101, rows[3][1].replace(" ", "\n")), (102, near), (103, near + " extra"), (104, "prefix " + near), (105, text(20) + " " + passage + " " + text(15)),
             (106, text(25) + " " + passage + " " + text(10)), (107, "12345 !!"), (108, None), (109, ""), (None, text(50)), (5, text(55)), (110, rows[4][1]), (110, rows[4][1])]
    d = spark.createDataFrame([(a, b, "en", "s", len(b or "")) for a, b in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    s1 = corpus_pipeline.language(spark, d, None)
    gone = {107, 108, 109}
    assert s1.columns == d.columns and sorted(str(r.doc_id) for r in s1.collect()) == sorted(str(a) for a, _ in rows if a not in gone)
    s2 = corpus_pipeline.exact_copies(spark, s1, None)
    gone |= {100, 101, 110}
    assert s2.columns == d.columns and sorted(str(r.doc_id) for r in s2.collect()) == sorted(str(a) for a, _ in rows if a not in gone)
    s3 = corpus_pipeline.near_copies(spark, s2, None)
    gone |= {103, 104}
    assert s3.columns == d.columns and sorted(str(r.doc_id) for r in s3.collect()) == sorted(str(a) for a, _ in rows if a not in gone)
    s4 = corpus_pipeline.repeated_passages(spark, s3, None)
    out = {r.doc_id: r for r in s4.collect()}
    assert s4.columns == d.columns and s4.count() == s3.count()
    before = {r.doc_id: r.text for r in s3.collect() if r.doc_id not in (5,)}
    assert all(out[i].text == t for i, t in before.items() if i not in (105, 106))
    assert all(passage not in out[i].text and out[i].n_chars == len(out[i].text) < len(before[i]) for i in (105, 106))
    s5 = corpus_pipeline.packed(spark, s4, None)
    assert s5.agg(F.sum("length")).first()[0] == s5.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), None).count() == 0
