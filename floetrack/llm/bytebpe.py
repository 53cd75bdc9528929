"""Byte-level BPE by a global shuffle of distinct pre-tokens.

Texts are cut into pre-tokens (the vocabulary's pattern); the distinct pre-tokens of each block are sent to the bucket of
their hash, where every distinct pre-token of the corpus is encoded once; the ids return to the block and are put back by
position. Decoding joins ids with the token-byte table (as long as the vocabulary: a fixed bound, so each task holds it).
"""
import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import functions as F

from floetrack.llm import blocks as B
from floetrack.llm import words as W

# white space of the pattern that bytes.split() does not know; texts with it are matched as a whole
ODD_SPACE = regex.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
CHUNK = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_loaded = {}


def ranks(path):
    """Rank file: dict token bytes -> id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _codec(path, pattern):
    if (path, pattern) not in _loaded:
        r = ranks(path)
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=r, special_tokens={})
        back = [b""] * (max(r.values()) + 1)
        for t, i in r.items():
            back[i] = t
        _loaded[path, pattern] = enc, regex.compile(pattern), back
    return _loaded[path, pattern]


def chunks(raw):
    """Pieces of a text between which no pre-token runs: white space stays in front of what follows it."""
    if not raw.isascii() and ODD_SPACE.search(raw.decode()) or raw.isascii() and any(c in raw for c in (b"\x1c", b"\x1d", b"\x1e", b"\x1f")):
        return [raw]
    return CHUNK.findall(raw)


def pre_tokens(chunk, pattern):
    """Matches of the pattern in one chunk; a word of letters after at most one space needs no matching."""
    c = chunk.decode()
    w = c[1:] if c[0] == " " else c
    if w.isalpha():
        return [chunk]
    if w[-1:] in ("." , ",") and w[:-1].isalpha():
        return [chunk[:-1], chunk[-1:]]
    return [p.encode() for p in pattern.findall(c)]


def encode(docs, path, pattern, key="doc_id", text="text", block_bytes=B.BLOCK_BYTES):
    """Rows (``key``, ids binary: little-endian uint32) of every whole text, as an encoder of the whole text gives them.

    NULL texts are empty; NULL and repeated keys are kept, one row each; other columns are not read. An empty table gives
    no rows.
    """
    t = B.write_blocks(docs, key, text, block_bytes=block_bytes)
    n = B.bucket_count(t)

    def emit(b, got):
        pat, cut = _codec(path, pattern)[1], {}
        for x in b.texts():
            cut.update(dict.fromkeys(chunks(x)))
        return W.send_words(dict.fromkeys(p for c in cut for p in pre_tokens(c, pat)), n)

    def answer(payloads):
        enc = _codec(path, pattern)[0]
        return W.answer_words(payloads, lambda ws: [np.array(enc.encode_ordinary(w.decode()), "<u4").tobytes() for w in ws])

    schema = pa.schema([(key, pa.int64()), ("ids", pa.binary())])

    def finish(batches):
        pat = _codec(path, pattern)[1]
        for b, got in B.each_block(batches):
            number = W.Interned()
            cut = [number.numbers(chunks(x)) for x in b.texts()]
            own = [pre_tokens(c, pat) for c in number]
            ids = W.read_words(dict.fromkeys(p for ps in own for p in ps), got["got"], n)
            whole = [b"".join(map(ids.__getitem__, ps)) for ps in own]
            del own, ids, number
            for a in range(0, len(cut), 512):
                yield W.table([b.ids[a:a + 512], [b"".join(map(whole.__getitem__, x.tolist())) for x in cut[a:a + 512]]], schema)

    r = B.exchange(t, emit, answer)
    return B.attach(t, r).mapInArrow(finish, f"{key} bigint, ids binary")


def decode(encoded, path, pattern, ids="ids"):
    """Adds ``decoded`` (bytes), ``n_tokens`` and ``ids_text`` digests to rows with packed ids; NULL ids give NULLs."""
    cols = encoded.columns

    def run(batches):
        back = _codec(path, pattern)[2]
        names = [str(i).encode() for i in range(len(back))]
        for rb in batches:
            n, sha, dec = [], [], []
            for x in rb.column(cols.index(ids)):
                raw = x.as_py()
                if raw is None:
                    n.append(None), sha.append(None), dec.append(None)
                    continue
                a = np.frombuffer(raw, "<u4").tolist()
                n.append(len(a))
                sha.append(hashlib.sha256(b" ".join(map(names.__getitem__, a))).hexdigest())
                dec.append(b"".join(map(back.__getitem__, a)))
            keep = [rb.column(i) for i, c in enumerate(cols) if c != ids]
            yield pa.RecordBatch.from_arrays(keep + [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(dec, pa.binary())],
                                             names=[c for c in cols if c != ids] + ["n_tokens", "ids_sha256", "decoded"])

    rest = [f.simpleString().replace(":", " ", 1) for f in encoded.schema if f.name != ids]
    return encoded.mapInArrow(run, ", ".join(rest + ["n_tokens bigint", "ids_sha256 string", "decoded binary"]))


def digests(docs, path, pattern):
    """Round trip of every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = decode(encode(docs, path, pattern), path, pattern)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
