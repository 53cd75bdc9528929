"""Katz back-off language model over whole texts.

n-gram counts and the sums behind the back-off weights live in tables partitioned by hash range (``counts``, ``backoff``),
written once to the shared folder; every block of texts asks them for its own n-grams and histories and evaluates the
recursion p(w | h) = d(c) c(h, w) / c(h) if the n-gram was seen, else alpha(h) p(w | shorter h), token by token.

Discounts are Good-Turing for counts up to ``K``; alpha(h) is exactly the mass left by the seen n-grams over the mass the
shorter history gives to the words not seen after h. A history all of whose continuations are frequent leaves no mass; its
total is raised by one. The open vocabulary has one class for all unknown words, which takes the mass left by the unigrams.
"""
import numpy as np
import pyarrow as pa

from floetrack.llm import blocks as B
from floetrack.llm import words as W
from floetrack.llm.common import crc_mod, written

K = 5
END, START = np.uint64(0x5EED0E4D), np.uint64(0x5EED057A)  # no word hashes are expected to equal these 33-bit values
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def joined(a, b):
    return B.mix(a * C1 + b * C2 + np.uint64(1))


class Grams:
    """n-gram and history keys at each token of a block, for orders 1 to ``order``."""

    def __init__(self, block, order):
        each = [W.hashed(W.lower_words(x)) for x in block.texts()]
        n = np.array([len(x) + 1 for x in each], np.int64)
        self.ends = np.cumsum(n)
        self.begins = self.ends - n
        tok = np.empty(self.ends[-1] if len(n) else 0, np.uint64)
        for x, a in zip(each, self.begins):
            tok[a:a + len(x)] = x
        tok[self.ends - 1] = END
        self.n, self.train = n, np.repeat(np.array(block.flags, np.float64), n)
        at = np.arange(len(tok)) - np.repeat(self.begins, n)
        self.gram, self.history, h = [tok], [None], None
        for m in range(2, order + 1):
            before = np.full(len(tok), START)
            before[m - 1:] = tok[:max(0, len(tok) - m + 1)]
            before[at < m - 1] = START
            h = before if h is None else joined(h, before)
            self.history.append(h)
            self.gram.append(joined(h, tok))


def good_turing(n):
    """Discounts d[1..K] from counts of counts n[1..K+1] (lists from 1); 1 where the estimate is not a discount."""
    d = [1.0] * (K + 1)
    if n[0] > 0:
        tail = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            if n[r - 1] and n[r] and tail < 1:
                x = ((r + 1) * n[r] / n[r - 1] / r - tail) / (1 - tail)
                d[r] = x if 0 < x < 1 else 1.0
    return np.array(d)


def discounted(c, d):
    return c * np.where(c <= K, d[np.minimum(c, K)], 1.0)


class Model:
    """Driver side: totals and discounts of each order, from the counts' statistics."""

    def __init__(self, st, order):
        w = K + 3
        self.discount, self.order = [], order
        for m in range(order):
            self.discount.append(good_turing(st[m * w + 2:(m + 1) * w]))
        self.tokens, self.types, n = st[0], st[1], np.array(st[2:2 + K])
        r = np.arange(1, K + 1)
        left = float((n * r * (1 - self.discount[0][1:])).sum())
        self.total = self.tokens + (left <= 0)
        self.unknown = (left if left > 0 else 1.0) / self.total if self.tokens else 1.0


def score(docs, train, order=2, key="doc_id", text="text", block_bytes=B.BLOCK_BYTES):
    """Rows (key, held_out, n_tokens, n_known, train_tokens, base_score, score) of all texts.

    Counts come from the rows where ``train`` holds. A NULL or empty text is one end token; repeated and NULL keys are kept;
    an empty table gives no rows; with no training rows every token has probability 1 as the one unknown class.
    """
    t = B.write_blocks(docs, key, text, train, block_bytes)
    n = B.bucket_count(t)

    def emit(b, got):
        g = Grams(b, order)
        parts = [[] for _ in range(n)]
        for keys in g.gram:
            u, c, _ = B.merged(keys, g.train)
            at = B.cuts(u, n)
            for i in range(n):
                parts[i] += [B.pack_sorted(u[at[i]:at[i + 1]]), B.pack_ints(c[at[i]:at[i + 1]])]
        return [(i, B.join_parts(p)) for i, p in enumerate(parts)]

    def answer(payloads):
        asked = [B.split_parts(p) for p in payloads]
        replies, st = [[] for _ in payloads], []
        for m in range(order):
            keys = [B.unpack_sorted(a[2 * m]) for a in asked]
            own = np.concatenate([B.unpack_ints(a[2 * m + 1]) for a in asked]).astype(np.float64)
            u, first, inv = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            c = np.rint(np.bincount(inv, own, len(u))).astype(np.int64)
            owner = np.zeros(len(inv), np.int64)
            owner[first] = 1
            both, at = c[inv] * 2 + owner, np.cumsum([0] + [len(k) for k in keys])
            for r, a, z in zip(replies, at, at[1:]):
                r.append(B.pack_ints(both[a:z]))
            st += [int(c.sum()), int((c > 0).sum())] + np.bincount(c[(c > 0) & (c <= K + 1)], minlength=K + 2)[1:].tolist()
        return [B.join_parts(r) for r in replies], st

    counts = written(B.exchange(t, emit, answer), "counts", "uncompressed")
    model = Model(B.stats(counts, order * (K + 3)), order)

    def known(g, got):
        """Per order: (corpus count of each token's n-gram, its distinct index, owner flags, first positions)."""
        parts = [B.split_parts(got[i]) for i in range(n)]
        out = []
        for m, keys in enumerate(g.gram):
            both = np.concatenate([B.unpack_ints(p[m]) for p in parts]).astype(np.int64)
            _, first, inv = np.unique(keys, return_index=True, return_inverse=True)
            out.append((both >> 1, inv, (both & 1).astype(bool), first))
        return out

    def emit_histories(b, got):
        g = Grams(b, order)
        seen = known(g, got["got"])
        parts = [[] for _ in range(n)]
        for m in range(1, order):
            c, inv, owner, first = seen[m]
            low = seen[m - 1][0][seen[m - 1][1][first]]
            u, h = np.unique(g.history[m], return_inverse=True)
            wanted = np.zeros(len(u), np.int64)
            wanted[h[c[inv] == 0]] = 1
            mine = owner & (c > 0)
            cols = [wanted]
            for x in (c[mine], low[mine]):
                at = h[first[mine]]
                cols += [np.bincount(at[x == r], minlength=len(u)) for r in range(1, K + 1)]
                cols.append(np.rint(np.bincount(at[x > K], x[x > K].astype(np.float64), len(u))).astype(np.int64))
            cut = B.cuts(u, n)
            for i in range(n):
                parts[i].append(B.join_parts([B.pack_sorted(u[cut[i]:cut[i + 1]])] + [B.pack_ints(x[cut[i]:cut[i + 1]]) for x in cols]))
        return [(i, B.join_parts(p)) for i, p in enumerate(parts)]

    def answer_histories(payloads):
        asked = [[B.split_parts(x) for x in B.split_parts(p)] for p in payloads]
        replies, r = [[] for _ in payloads], np.arange(1, K + 1)
        for m in range(1, order):
            keys = [B.unpack_sorted(a[m - 1][0]) for a in asked]
            u, inv = np.unique(np.concatenate(keys), return_inverse=True)
            cols = [np.bincount(inv, np.concatenate([B.unpack_ints(a[m - 1][j]) for a in asked]).astype(np.float64), len(u)) for j in range(2, 2 * K + 4)]
            one, big, lone, lbig = np.array(cols[:K]), cols[K], np.array(cols[K + 1:2 * K + 1]), cols[2 * K + 1]
            total = (one * r[:, None]).sum(0) + big
            mass = (one * (r * model.discount[m][1:])[:, None]).sum(0) + big
            low = (lone * (r * model.discount[m - 1][1:])[:, None]).sum(0) + lbig
            full = (total - mass <= 1e-9 * total).astype(np.int64)
            both, at = np.rint(total).astype(np.int64) * 2 + full, np.cumsum([0] + [len(k) for k in keys])
            for reply, a, z, x in zip(replies, at, at[1:], asked):
                i = inv[a:z]
                w = B.unpack_ints(x[m - 1][1]).astype(bool)
                reply.append(B.join_parts([B.pack_ints(both[i]), B.squeeze(mass[i[w]].tobytes()), B.squeeze(low[i[w]].tobytes())]))
        return [B.join_parts(x) for x in replies], []

    first = B.attach(t, counts)
    if order > 1:
        backoff = written(B.exchange(first, emit_histories, answer_histories).drop("stats"), "backoff", "uncompressed")
        first = B.attach(first, backoff, "got2")

    schema = pa.schema([(key, pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(batches):
        for b, got in B.each_block(batches):
            g = Grams(b, order)
            seen = known(g, got["got"])
            later = [B.split_parts(got["got2"][i]) for i in range(n)] if order > 1 else None
            c = seen[0][0][seen[0][1]]
            base = np.log10((c + 1) / (model.tokens + model.types + 1))
            p = np.log10(np.where(c > 0, discounted(c, model.discount[0]) / max(1, model.total), model.unknown))
            den = np.full(len(c), float(model.total))
            for m in range(1, order):
                parts = [B.split_parts(x[m - 1]) for x in later]
                both = np.concatenate([B.unpack_ints(x[0]) for x in parts]).astype(np.int64)
                _, h = np.unique(g.history[m], return_inverse=True)
                c_m = seen[m][0][seen[m][1]]
                mass, low = np.zeros(len(both)), np.zeros(len(both))
                w = np.zeros(len(both), bool)
                w[h[c_m == 0]] = True
                mass[w] = np.concatenate([np.frombuffer(B.expand(x[1])) for x in parts])
                low[w] = np.concatenate([np.frombuffer(B.expand(x[2])) for x in parts])
                own = ((both >> 1) + (both & 1)).astype(np.float64)[h]
                hist = (both >> 1)[h] > 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    direct = np.log10(discounted(c_m, model.discount[m]) / own)
                    alpha = np.log10((own - mass[h]) / own) - np.log10(np.maximum(1 - low[h] / den, 1e-300))
                p = np.where(c_m > 0, direct, np.where(hist, alpha + p, p))
                den = np.where(hist, own, den)
            add = lambda x: np.add.reduceat(x, g.begins)
            yield W.table([b.ids, [not x for x in b.flags], g.n, add((c > 0).astype(np.int64)), add(base), add(p)], schema)

    from pyspark.sql import functions as F
    return first.mapInArrow(finish, f"{key} bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double").withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))


def score_held_out(docs, order=2, key="doc_id", text="text"):
    """Learn from six of seven hash classes of the key, score all rows."""
    return score(docs, crc_mod(key, 7) != 2, order, key, text)
