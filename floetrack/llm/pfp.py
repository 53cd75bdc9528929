"""Repeated passages by prefix-free parsing.

A rolling hash over ``gram`` bytes marks triggers; a phrase runs from one trigger to the end of the next. Where a string of
``length`` bytes occurs twice, both places hold the same triggers and the same whole phrases, so the dictionary (distinct
phrases) and the parse (which phrases follow each other) say where repeats can be, and the order of the suffixes that begin
inside a phrase follows from the phrase's suffix and the parse after it. Suffixes are brought together by fingerprints of
that pair instead of being ranked: two suffixes are neighbours with a common prefix of ``length`` bytes exactly when they
share them. Four exchanges, each with one key per block and distinct context:

1. phrases: windows that hold a phrase found only once are unique;
2. contexts (phrases from the trigger before a run of windows to the one after it, and where the run lies in them): seen
   twice, all its windows repeat;
3. inner phrases of the run: without a second run sharing them, or without one of a unique context, nothing is left to ask;
4. the windows still open, one by one, and the windows of runs with fewer than two triggers.

Fingerprints have 64 bits (40 for phrases, where a clash only asks more).
"""
import hashlib

import numpy as np
import pyarrow as pa

from floetrack.llm import blocks as B
from floetrack.llm import words as W

STEP = 1 << 16  # bytes hashed at a time
BASE = 0x9E3779B97F4A7C15 | 1
TABLE = B.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(n):
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(B.CACHES.get("powers", [[]])[0]) < n:
        up = np.full(n, BASE, np.uint64)
        down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        B.CACHES["powers"] = np.cumprod(up, dtype=np.uint64, out=up), np.cumprod(down, dtype=np.uint64, out=down)
    return B.CACHES["powers"]


class Parse:
    """Triggers, phrases and runs of windows of one block."""

    def __init__(self, b, length, gram, every):
        self.length, self.n = length, len(b.data)
        up, self.down = powers(self.n + 1)
        data = np.frombuffer(b.data, np.uint8)
        self.sums = np.zeros(self.n + 1, np.uint64)
        for a in range(0, self.n, STEP):  # piece by piece: the sums are the only array of a word per byte
            z = min(self.n, a + STEP)
            np.cumsum(TABLE[data[a:z]] * up[a:z], dtype=np.uint64, out=self.sums[a + 1:z + 1])
            self.sums[a + 1:z + 1] += self.sums[a]
        self.doc_from, self.doc_to = b.starts[:-1], b.starts[1:]
        m, found = max(0, self.n + 1 - gram), [np.zeros(0, np.int64)]
        for a in range(0, m, STEP):
            z = min(m, a + STEP)
            g = self.sums[a + gram:z + gram] - self.sums[a:z]
            g *= self.down[a:z]
            g *= np.uint64(0xD6E8FEB86659FD93)
            found.append(np.flatnonzero(g < np.uint64((1 << 64) // every)) + a)
        t = np.concatenate(found)
        # triggers inside one document
        doc = np.searchsorted(self.doc_from, t, "right") - 1
        ok = t + gram <= self.doc_to[doc]
        self.t, doc = t[ok], doc[ok]
        same = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
        self.phrase_at = np.flatnonzero(same)  # phrase i: trigger i to trigger i + 1
        self.phrase = self.hash(self.t[self.phrase_at], self.t[self.phrase_at + 1] + gram) >> np.uint64(24)
        self.gram = gram

    def hash(self, a, z):
        """Fingerprint of the bytes a..z-1, for arrays of positions."""
        return B.mix((self.sums[z] - self.sums[a]) * self.down[a] + (z - a).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def runs(self):
        """Runs of window starts with the same triggers: (first start, last start, first trigger, last trigger)."""
        last = self.doc_to - self.length  # last start of each document
        has = last >= self.doc_from
        cut = np.unique(np.concatenate([self.doc_from[has], last[has] + 1, self.t + 1, self.t + self.gram - self.length]))
        doc = np.searchsorted(self.doc_from, cut, "right") - 1
        if not len(cut) or not has.any():
            z = np.zeros(0, np.int64)
            return z, z, z, z
        # empty documents share their start with the next one: the last of them holds the bytes
        ok = (doc >= 0) & (cut <= last[doc])
        i = np.flatnonzero(ok)
        s0, s1 = cut[i], np.minimum(np.append(cut[1:], self.n)[i] - 1, last[doc[i]])
        f = np.searchsorted(self.t, s0, "left")
        z = np.searchsorted(self.t, s0 + self.length - self.gram, "right") - 1
        return s0, s1, f, z

    def windows(self, s0, s1):
        """Every start of the given runs, and the run it belongs to."""
        n = s1 - s0 + 1
        own = np.repeat(np.arange(len(n)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + s0[own], own


class Search:
    """The rounds' shared steps over one parse; every round repeats the earlier ones from their replies."""

    def __init__(self, b, got, n, length, gram, every):
        self.p = p = Parse(b, length, gram, every)
        self.n = n
        self.phrases, self.phrase_n, self.inv = B.merged(p.phrase)
        if "got1" not in got:
            return
        again = B.read_sorted(got["got1"], n)[self.inv] > 0
        lone = np.zeros(len(p.t) + 1, np.int64)
        lone[p.phrase_at] = ~again
        before = np.concatenate([[0], np.cumsum(lone)])
        s0, s1, f, z = p.runs()
        loose = z - f < 1
        self.loose = s0[loose], s1[loose]
        open_ = ~loose & (before[np.maximum(z, 0)] == before[np.minimum(f, len(p.t))])
        self.s0, self.s1, f, z = (x[open_] for x in (s0, s1, f, z))
        doc = np.searchsorted(p.doc_from, self.s0, "right") - 1
        a = np.where((f > 0) & (p.t[np.maximum(f - 1, 0)] >= p.doc_from[doc]), p.t[np.maximum(f - 1, 0)], p.doc_from[doc]) if len(f) else f
        nxt = np.minimum(z + 1, max(0, len(p.t) - 1))
        e = np.where((z + 1 < len(p.t)) & (p.t[nxt] + gram <= p.doc_to[doc]), p.t[nxt] + gram, p.doc_to[doc]) if len(f) else f
        # with a trigger at the first or last byte of a document, neighbouring runs share a or e: the place of the run in its
        # context belongs to the key, so that a context counts once a place and stands for the same windows everywhere
        place = ((p.t[f] - a) << 32 | (e - p.t[z] - gram)).astype(np.uint64) if len(f) else np.zeros(0, np.uint64)
        self.context, self.context_n, self.context_of = B.merged(B.mix(p.hash(a, e) + B.mix(place)))
        self.inner, self.inner_n, self.inner_of = B.merged(p.hash(p.t[f], p.t[z] + gram)) if len(f) else B.merged(np.zeros(0, np.uint64))
        if "got2" not in got:
            return
        both = B.read_sorted(got["got2"], n)
        self.repeats = (both >= 2)[self.context_of]
        first = np.zeros(len(self.context_of), bool)
        first[np.unique(self.context_of, return_index=True)[1]] = True
        self.stands = first & (both & 1).astype(bool)[self.context_of]  # one run of all that share a context
        if "got3" not in got:
            return
        ask = B.read_sorted(got["got3"], n)[self.inner_of] > 0
        ask &= ~self.repeats | self.stands
        w, own = p.windows(self.s0[ask], self.s1[ask])
        v, _ = p.windows(*self.loose)
        self.at = np.concatenate([w, v])
        weight = np.concatenate([np.where(self.repeats[ask][own], 2.0, 1.0), np.ones(len(v))])
        self.window, self.window_n, self.window_of = B.merged(p.hash(self.at, self.at + p.length), weight)


def repeated(inv, n, owner, times):
    return (np.bincount(inv, times, n) >= 2)[inv]


def cut_repeats(docs, key="doc_id", text="text", length=400, gram=16, every=32, block_bytes=2 << 20, keep_text=False, least_words=0):
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]) of every whole text.

    Removed is each byte of a ``length``-byte string that starts in two or more places of the table, the same document
    included, overlapping or not; strings do not cross documents. ``spans``: (begin, end) byte offsets of the removed runs;
    ``kept``: the remaining text, without characters that lost a byte. With ``least_words`` a run of fewer words stays. NULL texts are empty; repeated rows repeat each other's texts; NULL keys are kept; an
    empty table gives no rows.
    """
    t = B.write_blocks(docs, key, text, block_bytes=block_bytes)
    n = B.bucket_count(t)
    search = lambda b, got: Search(b, got, n, length, gram, every)

    def phrases(b, got):
        s = search(b, got)
        return B.send_sorted(s.phrases, [np.minimum(s.phrase_n, 2)], n, 40)

    def contexts(b, got):
        s = search(b, got)
        return B.send_sorted(s.context, [np.minimum(s.context_n, 2)], n)

    def inners(b, got):
        s = search(b, got)
        lone = np.bincount(s.inner_of, ~s.repeats, len(s.inner)) > 0
        return B.send_sorted(s.inner, [np.minimum(s.inner_n, 2), lone.astype(np.int64)], n)

    def windows(b, got):
        s = search(b, got)
        return B.send_sorted(s.window, [np.minimum(s.window_n, 2)], n)

    count = lambda p: (B.tallied(p, lambda inv, k, owner, times: repeated(inv, k, owner, times).astype(np.int64)), [])
    owned = lambda p: (B.tallied(p, lambda inv, k, owner, times: repeated(inv, k, owner, times) * 2 + owner), [])
    asked = lambda p: (B.tallied(p, lambda inv, k, owner, times, lone: (repeated(inv, k, owner, times) & (np.bincount(inv, lone, k) > 0)[inv]).astype(np.int64)), [])
    at = t
    for i, (emit, answer) in enumerate([(phrases, count), (contexts, owned), (inners, asked), (windows, count)], 1):
        at = B.attach(at, B.written(B.exchange(at, emit, answer).drop("stats"), f"round{i}", "uncompressed"), f"got{i}")

    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", span)]
                       + [("kept", pa.string())] * keep_text)

    def finish(batches):
        for b, got in B.each_block(batches):
            s = search(b, got)
            hit = s.at[B.read_sorted(got["got4"], n)[s.window_of] > 0] if len(s.at) else s.at
            size = s.p.n + 1
            begins, ends = (np.concatenate([x[s.repeats], hit + y]) for x, y in ((s.s0, 0), (s.s1 + length, length)))
            del s, hit
            cover = np.bincount(begins, minlength=size)
            cover -= np.bincount(ends, minlength=size)
            gone = np.cumsum(cover, out=cover)[:-1] > 0
            del cover, begins, ends
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            edge[b.starts] = 0
            first, last = np.append(gone, False)[b.starts], np.concatenate([[False], gone])[b.starts]
            # runs begin where the cover rises or at the start of a covered document, and end likewise
            begins = np.unique(np.concatenate([np.flatnonzero(edge == 1), b.starts[:-1][first[:-1] & (b.sizes > 0)]]))
            ends = np.unique(np.concatenate([np.flatnonzero(edge == -1), b.starts[1:][last[1:] & (b.sizes > 0)]]))
            lo, hi = np.searchsorted(begins, b.starts[:-1]), np.searchsorted(begins, b.starts[1:])
            out = [[] for _ in schema]
            for i, (d, a, z) in enumerate(zip(b.ids, b.starts[:-1].tolist(), b.starts[1:].tolist())):
                own = [{"begin": int(x - a), "end": int(y - a)} for x, y in zip(begins[lo[i]:hi[i]], ends[lo[i]:hi[i]])]
                if least_words:
                    own = [o for o in own if len(b.data[a + o["begin"]:a + o["end"]].split()) >= least_words]
                edges = [0, *[x for o in own for x in (o["begin"], o["end"])], z - a]
                kept = b"".join(b.data[a + x:a + y] for x, y in zip(edges[::2], edges[1::2]))
                row = [d, z - a, z - a - len(kept), len(own), hashlib.sha256(kept).hexdigest(), own] + [kept.decode(errors="ignore")] * keep_text
                for c, v in zip(out, row):
                    c.append(v)
            yield W.table(out, schema)

    sql = f"{key} bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<begin:bigint,end:bigint>>"
    return at.mapInArrow(finish, sql + ", kept string" * keep_text)
