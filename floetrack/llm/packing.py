"""Sequence packing: shortest-pack-first over the length histogram.

Documents are tokenised and cut into pieces of at most ``size`` ids. The histogram of piece lengths (at most ``size`` rows,
whatever the corpus) is packed on the driver: lengths longest first, each placed in the emptiest open pattern that takes
it, as counts. Patterns are then joined back to the pieces by their rank among the pieces of one length.
"""
import json
import os
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from floetrack.llm import blocks as B
from floetrack.llm import words as W
from floetrack.llm.common import written

RANKED = 50_000  # pieces of one ranking group, on average
_loaded = {}


def _encoder(path):
    if path not in _loaded:
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t, has_steps(t)
    return _loaded[path]


# Words of lower-case Latin-1 letters, with marks after them if any: where a tokenizer has these steps (NFC and lower case, which
# leave such words as they are; runs of letters and of other marks as pieces; bytes as characters), the pieces are known, and
# its model is called on them without the steps, which take most of the time.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,;:!?$]*)")
STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}], [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves as characters
AS_CHARACTERS = dict(zip([b for b in range(256) if b not in SHOWN], range(256, 512)))


def has_steps(tok):
    d = json.loads(tok.to_str())
    return tuple((d[k] or {}).get(f) for k, f in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))) == STEPS and d["model"]["type"] == "BPE"


def encode_words(path, ws):
    """Packed ids of words, each as the tokenizer encodes it alone."""
    tok, known = _encoder(path)
    out, rest = [], []
    ids = lambda s: [t.id for t in tok.model.tokenize(s)]
    for i, w in enumerate(ws):
        m = PLAIN.fullmatch(w) if known else None
        if m is None:
            rest.append(i)
            out.append(None)
            continue
        a, z = m.groups()
        a = ids(a.decode() if a.isascii() else a.decode("latin-1").translate(AS_CHARACTERS))
        out.append(array("I", a + ids(z.decode()) if z else a).tobytes())
    for k in range(0, len(rest), 10_000):
        at = rest[k:k + 10_000]
        for i, e in zip(at, tok.encode_batch_fast([ws[i].decode() for i in at], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
    return out


def special(path):
    """Packed id of each special-token string (bytes)."""
    return {a.content.encode(): np.array([i], "<u4").tobytes() for i, a in Tokenizer.from_file(path).get_added_tokens_decoder().items() if a.special}


def split(text, own):
    """Lower-cased words of a text; special tokens, found before lower-casing, are pieces of their own with a space before them."""
    if not any(x in text for x in own):
        return W.lower_words(text)
    parts = re.split(b"(" + b"|".join(map(re.escape, sorted(own, key=len, reverse=True))) + b")", text)
    return [w for i, x in enumerate(parts) for w in ([b" " + x] if i % 2 else W.lower_words(x))]


def pieces(docs, path, size=2048, end_id=1, key="doc_id", text="text", block_bytes=B.BLOCK_BYTES):
    """Rows (doc_id, start, length, ids_crc32, doc_tokens) of every document, ``end_id`` after its ids.

    The tokenizer drops white space and never joins across it, so each distinct lower-cased word of the corpus is encoded
    once, and a special token's string gets that token's id, as in a plain call on the whole text. NULL texts are empty (a single ``end_id``); repeated and NULL keys are kept.
    """
    t = B.write_blocks(docs, key, text, block_bytes=block_bytes)
    n = B.bucket_count(t)
    own = special(path)

    def emit(b, got):
        return W.send_words(dict.fromkeys(chain.from_iterable(split(x, own) for x in b.texts())), n)

    def answer(payloads):
        def encode(ws):
            out = encode_words(path, ws)
            return [own[w[1:]] if w[:1] == b" " else x for w, x in zip(ws, out)]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return W.answer_words(payloads, encode)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def finish(batches):
        for b, got in B.each_block(batches):
            number = W.Interned()
            ws = [number.numbers(split(x, own)) for x in b.texts()]
            ids = W.read_words(number, got["got"], n)
            ids = list(map(ids.__getitem__, number))
            out = [[], [], [], [], []]
            for doc, x in zip(b.ids, ws):
                raw = b"".join(map(ids.__getitem__, x.tolist())) + end
                for a in range(0, len(raw), 4 * size):
                    p = raw[a:a + 4 * size]
                    for c, v in zip(out, (doc, a // 4, len(p) // 4, zlib.crc32(p), len(raw) // 4)):
                        c.append(v)
            yield W.table(out, schema)

    r = B.exchange(t, emit, answer)
    return B.attach(t, r).mapInArrow(finish, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def shortest_pack_first(histogram, size):
    """Patterns [(lengths, count)] for a histogram {length: count}."""
    open_, done = {}, []
    for length in range(size, 0, -1):
        n = histogram.get(length, 0)
        while n:
            room = max(open_, default=0)
            if room < length:
                pattern, m, room = [], n, size
            else:
                pattern, count = open_[room].pop()
                m = min(n, count)
                if count > m:
                    open_[room].append((pattern, count - m))
                if not open_[room]:
                    del open_[room]
            new, left = (pattern + [length], m), room - length
            if left:
                open_.setdefault(left, []).append(new)
            else:
                done.append(new)
            n -= m
    return done + [p for ps in open_.values() for p in ps]


def slots(patterns):
    """Rows (length, first, last, sequence, offset): the pieces of ``length`` ranked first..last go to consecutive sequences."""
    taken, base, out = {}, 0, []
    for lengths, count in patterns:
        at = 0
        for x in lengths:
            lo = taken.get(x, 0)
            out.append((x, lo, lo + count - 1, base - lo, at))
            taken[x] = lo + count
            at += x
        base += count
    return out


def ranked(p):
    """Adds ``rank``, 0-based among the pieces of one length, and the histogram.

    A length that holds most of the pieces is split into groups by a hash of the piece; counts of the groups give their
    first ranks.
    """
    groups = max(1, p.count() // RANKED)
    p = p.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    counts = written(p.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "start")
    out = p.withColumn("own", F.row_number().over(own) - 1).join(first.select("length", "part", "before"), ["length", "part"])
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    return out.withColumn("rank", F.col("before") + F.col("own")).drop("part", "own", "before"), hist


def pack(p, size=2048):
    """Places written pieces: adds sequence_id, offset and padded_length.

    Sequences are padded to ``size``; one whose length is a power of two needs no padding. An empty table gives no rows.
    """
    spark = p.sparkSession
    r, hist = ranked(p)
    patterns = shortest_pack_first(hist, size)
    used = lambda x: sum(x) if sum(x) & (sum(x) - 1) == 0 else size
    rows = slots(patterns)
    padded = [used(x) for x, _ in patterns for _ in x]
    table = spark.createDataFrame([(*a, b) for a, b in zip(rows, padded)], "length bigint, first bigint, last bigint, base bigint, offset bigint, padded_length bigint")
    if len(rows) <= 100_000:  # patterns depend on the histogram alone; this is far above what `size` lengths give
        table = F.broadcast(table)
    j = r.join(table, "length").where(F.col("rank").between(F.col("first"), F.col("last")))
    return j.withColumn("sequence_id", F.col("base") + F.col("rank")).drop("rank", "first", "last", "base")


def pack_documents(docs, path, size=2048, end_id=1, key="doc_id", text="text"):
    """Tokenise, cut and pack all documents."""
    return pack(written(pieces(docs, path, size, end_id, key, text), "pieces"), size)
