"""Words of a text, their 64-bit hashes, and distinct words encoded once for all blocks."""
import numpy as np
import pyarrow as pa
import xxhash

from floetrack.llm.blocks import CACHES, expand, join_parts, pack_ints, split_parts, squeeze, unpack_ints


class Hashes(dict):
    """Cache word -> 64-bit hash; emptied when it holds ``limit`` words (it only saves time)."""

    def __init__(self, limit=1 << 18):
        super().__init__()
        self.limit = limit

    def __missing__(self, w):
        if len(self) >= self.limit:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


class Interned(dict):
    """Numbers distinct pieces in order of appearance."""

    def __missing__(self, w):
        n = self[w] = len(self)
        return n

    def numbers(self, pieces):
        return np.fromiter(map(self.__getitem__, pieces), np.uint32, len(pieces))


def lower_words(text):
    """Words of UTF-8 bytes: A-Z in lower case, split at ASCII white space."""
    return text.lower().split()


def hashed(words):
    """Hashes of words; those of a task's earlier blocks are remembered."""
    cache = CACHES.setdefault("hashes", Hashes())
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def pack_words(words):
    return join_parts([pack_ints(np.fromiter(map(len, words), np.int64, len(words))), squeeze(b"".join(words))])


def unpack_words(b):
    lens, raw = split_parts(b)
    raw, ends = expand(raw), np.cumsum(unpack_ints(lens).astype(np.int64)).tolist()
    return [raw[a:e] for a, e in zip([0] + ends, ends)]


def send_words(words, n):
    """(bucket, payload) of a block's distinct words; the order within a bucket is the given one."""
    parts = [[] for _ in range(n)]
    for w in words:
        parts[xxhash.xxh3_64_intdigest(w) % n].append(w)
    return [(i, pack_words(p)) for i, p in enumerate(parts) if p]


def answer_words(payloads, encode):
    """Each distinct word of a bucket is encoded once: ``encode(list of bytes) -> list of packed uint16 / uint32 ids``."""
    asked = [unpack_words(p) for p in payloads]
    distinct = list(dict.fromkeys(w for a in asked for w in a))
    ids = dict(zip(distinct, encode(distinct)))
    out = []
    for a in asked:
        got = list(map(ids.__getitem__, a))
        out.append(pack_words(got))
    return out, [len(distinct)]


def read_words(words, got, n):
    """Dict word -> packed ids from a block's replies; ``words`` in the order of ``send_words``."""
    parts = [[] for _ in range(n)]
    for w in words:
        parts[xxhash.xxh3_64_intdigest(w) % n].append(w)
    out = {}
    for i, p in enumerate(parts):
        if p:
            out.update(zip(p, unpack_words(got[i])))
    return out


def table(columns, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
