"""Language identification: nearest of several clustered centroids per language over normalised TF-IDF byte n-grams."""
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floetrack.llm.blocks import pack_ints, unpack_ints
from floetrack.llm.common import crc_mod, release

WIDTH = 1 << 12  # hashed n-gram counts per text
LETTER = regex.compile(r"\p{L}")
_plain = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def counts(text):
    """Hashed counts of the letter trigrams of a whole text; None if it has no letter."""
    raw = text.lower().encode()
    if not (raw.translate(_plain).strip() if raw.isascii() else LETTER.search(text)):
        return None
    b = np.frombuffer(b" " + raw.translate(_plain) + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    return np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=WIDTH)


def vectors(c, idf):
    """TF-IDF rows of length 1 (zero rows stay zero)."""
    v = np.log1p(c.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def clusters(v, k, rounds=8):
    """Spherical k-means from spread-out starting rows; rows that repeat give fewer centroids."""
    c = v[:1]
    while len(c) < min(k, len(v)):
        far = (v @ c.T).max(1)
        if far.min() > 1 - 1e-6:
            break
        c = np.vstack([c, v[far.argmin()]])
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        c = np.vstack([v[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs, train, lang="lang", key="doc_id", text="text", per_lang=400, k=4):
    """Model from at most ``per_lang`` rows of each language among the rows where ``train`` holds (smallest hashes of the key).

    The bound is the only sampling; it covers the fit alone. ``floor`` is the lowest cosine that the fit's own rows have
    with their language, the distance beyond which a text may be rejected. No such rows: None.
    """
    d = docs.where(train).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(key).alias("h"), F.col(text).alias("text"))
    w = Window.partitionBy("lang").orderBy("h")
    top = d.select("lang", "h").withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_lang).groupBy("lang").agg(F.max("h").alias("top"))
    d = d.join(F.broadcast(top), "lang").where("h <= top")

    def run(batches):
        for rb in batches:
            c = [counts(x.as_py()) for x in rb.column(1)]
            yield pa.RecordBatch.from_arrays([rb.column(0).cast(pa.string()), pa.array([None if x is None else pack_ints(x) for x in c], pa.binary())], names=["lang", "c"])

    got = d.select("lang", "text").mapInArrow(run, "lang string, c binary").where("c is not null").collect()
    if not got:
        return None
    by = {}
    for x in sorted(got):
        if len(by.setdefault(x.lang, [])) < 2 * per_lang:  # rows that share the last hash
            by[x.lang].append(unpack_ints(x.c))
    by = {a: np.array(b) for a, b in by.items()}
    every = np.vstack(list(by.values()))
    idf = (np.log((1 + len(every)) / (1 + (every > 0).sum(0))) + 1).astype(np.float32)
    names, cents, floor = [], [], 1.0
    for a, b in by.items():
        v = vectors(b, idf)
        c = clusters(v, k)
        names += [a] * len(c)
        cents.append(c)
        floor = min(floor, float((v @ c.T).max(1).min()))
    return {"names": names, "centroids": np.vstack(cents).astype(np.float32), "idf": idf, "floor": floor}


def predict(docs, model, key="doc_id", text="text", step=256, carry=False):
    """Rows (key, lang_pred, score, distant) for every whole text; with ``carry`` also ``row``, a struct of the row's columns.

    ``und`` with score 0 if the text is NULL or has no letter, or there is no model. ``distant``: no centroid is near
    enough (half the fit's lowest cosine), or ``und``. Ties go to the language that sorts first.
    """
    def run(batches):
        for rb in batches:
            for a in range(0, rb.num_rows, step):
                part = rb.slice(a, step)
                c = [counts(x) if x else None for x in part.column(1).to_pylist()]
                lang, score = ["und"] * len(c), np.zeros(len(c))
                has = [i for i, x in enumerate(c) if x is not None]
                if has and model:
                    sim = vectors(np.array([c[i] for i in has]), model["idf"]) @ model["centroids"].T
                    best = sim.argmax(1)
                    for i, j, s in zip(has, best, sim[np.arange(len(has)), best]):
                        lang[i], score[i] = model["names"][j], min(1.0, max(0.0, float(s)))
                limit = 0.5 * model["floor"] if model else 0.0
                cols = [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([x == "und" or s < limit for x, s in zip(lang, score)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols + ([part.column(2)] if carry else []), names=[key, "lang_pred", "score", "distant"] + ["row"] * carry)
        release()

    cols = docs.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text"), *([F.struct("*").alias("row")] if carry else []))
    out = T.StructType().add(key, "long").add("lang_pred", "string").add("score", "double").add("distant", "boolean")
    return cols.mapInArrow(run, out.add(cols.schema["row"]) if carry else out)


def identify(docs, key="doc_id", text="text", lang="lang"):
    """Fit on two thirds of the labelled rows, predict all; ``held_out`` marks the other third."""
    held = crc_mod(key, 3) == 1
    model = fit(docs, ~held, lang, key, text)
    return predict(docs, model, key, text).withColumn("held_out", held)
