"""Blocks of whole texts, and an exchange of packed keys between blocks and buckets.

A *block* is one row with a few megabytes of consecutive texts. An exchange lets every block ask about its distinct keys
(words, n-grams, phrases): each key is sent once per block to the bucket that owns its hash range, the bucket answers for
all blocks at once, and the answers return to the block. It is an aggregate followed by a join back, with keys packed in
binary columns, so a key as frequent as the block count is the hottest there can be. Spark partitions, shuffles, spills
and retries; numpy works inside the tasks.
"""
import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from floetrack.llm.common import folder, release, written

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
SCHEMA = "block bigint, ids array<bigint>, flags array<boolean>, sizes array<bigint>, data binary"


def squeeze(b):
    return zstandard.compress(b, 3)


def expand(b):
    return zstandard.decompress(b)


CACHES = {}  # what a task keeps from block to block


class Block:
    """Texts of one block: ``ids``, ``flags``, byte ``sizes``, ``data`` (all texts joined), ``starts`` of each text."""

    def __init__(self, block, ids, flags, sizes, data):
        self.block, self.ids, self.flags = block, ids, flags
        self.sizes = np.asarray(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.data = expand(data)

    def texts(self):
        d, s = self.data, self.starts.tolist()
        return [d[a:b] for a, b in zip(s, s[1:])]


def each_block(batches):
    """Block and its answers (dict bucket -> bytes, empty if there is no such column) for each row."""
    for rb in batches:
        names = rb.schema.names
        for i in range(rb.num_rows):
            b = Block(*(rb.column(names.index(c))[i].as_py() for c in ("block", "ids", "flags", "sizes", "data")))
            got = {c: {x["bucket"]: x["reply"] for x in rb.column(names.index(c))[i].as_py() or []} for c in names if c.startswith("got")}
            yield b, got
            del b, got
    CACHES.clear()
    release()


def write_blocks(docs, key="doc_id", text="text", flag=None, block_bytes=BLOCK_BYTES):
    """Written table of blocks of ``docs``. NULL texts count as empty; a text longer than a block is a block of its own.

    ``flag``: a boolean column to carry. Rows keep their order within an input partition; no shuffle. The table is bucketed
    by block, so that answers can be joined to it again and again without shuffling the texts.
    """
    d = docs.select(F.col(key).cast("bigint").alias("id"), (flag if flag is not None else F.lit(True)).alias("flag"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])

    def pack(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            ids, flags, sizes = ([x for h in held for x in h[k]] for k in range(3))
            row = [(part << 32) + seq, ids, flags, sizes, squeeze(b"".join(h[3] for h in held))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        for rb in batches:
            text = rb.column(2).cast(pa.large_string())
            if not len(text):
                continue
            off = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            ids, flags = rb.column(0).to_pylist(), rb.column(1).to_pylist()
            data, a = text.buffers()[2], 0
            while a < len(text):
                b = max(a + 1, int(np.searchsorted(off, off[a] + block_bytes - size, "right")) - 1)
                raw = data[int(off[a]):int(off[b])].to_pybytes() if data is not None else b""
                held.append((ids[a:b], flags[a:b], np.diff(off[a:b + 1]).tolist(), raw))
                size += len(raw)
                a = b
                if size >= block_bytes or a < len(text):
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()
        held = []
        release()

    spark, name = docs.sparkSession, f"blocks_{uuid.uuid4().hex}"
    (d.mapInArrow(pack, SCHEMA).write.option("path", folder(spark, "blocks")).option("compression", "uncompressed")
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only: files outside the warehouse stay, and the frame keeps reading them
    return table


def bucket_count(blocks, bucket_bytes=BUCKET_BYTES):
    """Buckets in proportion to the bytes of text, so that the work of one bucket stays bounded."""
    n = blocks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()[0] or 0
    return max(1, math.ceil(n / bucket_bytes))


REPLY = "block bigint, bucket int, reply binary, stats array<bigint>"
_reply = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("reply", pa.binary()), ("stats", pa.list_(pa.int64()))])


def exchange(asked, emit, answer):
    """Replies (block, bucket, reply, stats).

    ``emit(block, got)`` yields (bucket, payload) of a block; ``answer(payloads)`` returns one reply per payload of a bucket
    and a list of integers (the bucket's statistics, stored with its first reply; empty if none).
    """
    sent_schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])

    def send(batches):
        for b, got in each_block(batches):
            rows = list(emit(b, got))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                                                  pa.array([r[1] for r in rows], pa.binary())], schema=sent_schema)

    def reply(table):
        table = table.sort_by("block")
        replies, stats = answer(table.column("payload").to_pylist())
        release()
        n = table.num_rows
        return pa.table([table.column("block"), table.column("bucket"), pa.array(replies, pa.binary()),
                         pa.array([stats] + [[]] * (n - 1), pa.list_(pa.int64()))], schema=_reply)

    sent = asked.mapInArrow(send, "block bigint, bucket int, payload binary")
    return sent.groupBy("bucket").applyInArrow(reply, REPLY)


def attach(blocks, replies, column="got"):
    """Blocks with their replies (an array bounded by the block's size) as ``column``."""
    g = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "reply")).alias(column))
    return blocks.hint("merge").join(g, "block", "left")


def stats(replies, n):
    """Sums of the buckets' statistics."""
    r = replies.where(F.size("stats") > 0).agg(*[F.sum(F.col("stats")[i]) for i in range(n)]).first()
    return [x or 0 for x in r]


# packed arrays

def pack_ints(a):
    """Non-negative integers, by byte planes."""
    a = np.asarray(a)
    w = 1 if not len(a) else max(1, (int(a.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :w].T
    return len(a).to_bytes(8, "little") + bytes([w]) + squeeze(planes.tobytes())


def unpack_ints(b):
    n, w = int.from_bytes(b[:8], "little"), b[8]
    out = np.zeros((n, 8), np.uint8)
    out[:, :w] = np.frombuffer(expand(b[9:]), np.uint8).reshape(w, n).T
    return out.view("<u8").ravel()


def pack_sorted(a):
    return pack_ints(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b):
    return np.cumsum(unpack_ints(b), dtype=np.uint64)


def join_parts(parts):
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def split_parts(b):
    out, i = [], 0
    while i < len(b):
        n = int.from_bytes(b[i:i + 8], "little")
        out.append(b[i + 8:i + 8 + n])
        i += 8 + n
    return out


def edges_of(n, bits=64):
    """First key of each of ``n`` equal hash ranges."""
    return np.array([(i << bits) // n for i in range(n)], np.uint64)


def cuts(keys, n, bits=64):
    """Where the ranges begin in sorted ``keys``: n + 1 positions."""
    return np.append(np.searchsorted(keys, edges_of(n, bits), "left"), len(keys))


def merged(keys, weights=None):
    """Sorted distinct keys, summed weights (1 each by default) and the inverse index."""
    u, inv = np.unique(keys, return_inverse=True)
    w = np.bincount(inv, weights, len(u))
    return u, (w if weights is None else np.rint(w).astype(np.int64)), inv


def mix(x):
    """Scrambles 64-bit words (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def send_sorted(u, cols, n, bits=64):
    """(bucket, payload) for sorted distinct keys and columns of small integers beside them."""
    at = cuts(u, n, bits)
    return [(i, join_parts([pack_sorted(u[a:z])] + [pack_ints(c[a:z]) for c in cols])) for i, (a, z) in enumerate(zip(at, at[1:])) if z > a]


def tallied(payloads, fn):
    """Replies for ``send_sorted`` payloads: ``fn(key index of each asked key, number of keys, first asker, columns)`` gives one integer per asked key."""
    asked = [split_parts(p) for p in payloads]
    keys = [unpack_sorted(a[0]) for a in asked]
    u, first, inv = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    owner = np.zeros(len(inv), bool)
    owner[first] = True
    cols = [np.concatenate([unpack_ints(a[j]) for a in asked]).astype(np.int64) for j in range(1, len(asked[0]))]
    out = fn(inv, len(u), owner, *cols)
    at = np.cumsum([0] + [len(k) for k in keys])
    return [pack_ints(out[a:z]) for a, z in zip(at, at[1:])]


def read_sorted(got, n):
    """The replies' integers in the order of the sent keys."""
    parts = [unpack_ints(got[i]) for i in range(n) if i in got]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
