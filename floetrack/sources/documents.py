"""Records of large JSON documents, read by many tasks.

A document is cut into byte ranges. A range alone cannot tell whether it begins inside a string or how deep it lies, so one
pass sums every range up for both cases (brackets opened less closed, and the last bracket opened on each level); the sums of
a document's ranges, put together in order, give every range its true start. Then each task cuts out the records that begin in
its ranges and reads on to the end of the last one. A document of one range needs no first pass, and small ones share a task.
"""
import json
import re

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 32 << 20
LOOK_BACK = 4096        # a key, its colon and blanks before a bracket that opens at the start of a range
BATCH_BYTES = 4 << 20
OPENS, CLOSES = b"{[", b"}]"
MARKS = np.zeros(256, bool)
MARKS[list(b'{}[]"\\')] = True


def _open(path):
    if re.match(r"[a-z0-9]+:", path) and not path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return system.open_input_file(inner)


def _marks(buf, slashes):
    """(positions of unescaped quotes, positions of brackets, their bytes); ``slashes`` backslashes stand before ``buf``."""
    a = np.frombuffer(buf, np.uint8)
    at = np.flatnonzero(MARKS[a])
    kind = a[at]
    back = at[kind == 92]
    escaped = np.zeros(0, np.int64)
    if len(back):
        first = np.flatnonzero(np.diff(back, prepend=-2) != 1)
        last = np.append(first[1:], len(back)) - 1
        length = last - first + 1
        if back[0] == 0:
            length[0] += slashes
        escaped = back[last][length % 2 == 1] + 1
    if slashes % 2 and a[:1] != 92:
        escaped = np.append(escaped, 0)
    quotes = at[kind == 34]
    brackets = (kind != 34) & (kind != 92)
    return quotes[~np.isin(quotes, escaped)], at[brackets], kind[brackets]


def _outside(quotes, at, kind, in_string):
    """Brackets outside strings: positions, bytes, depth before each (relative to the start), depth after the last."""
    out = (np.searchsorted(quotes, at) + in_string) % 2 == 0
    at, kind = at[out], kind[out]
    step = np.where((kind == OPENS[0]) | (kind == OPENS[1]), 1, -1)
    after = np.cumsum(step)
    return at, kind, after - step, int(after[-1]) if len(after) else 0


class _Range:
    """Bytes ``start`` to ``end`` of a file with what stands before them."""

    def __init__(self, file, start, end):
        lead = min(start, LOOK_BACK)
        file.seek(start - lead)
        raw = file.read(end - start + lead)
        self.before, self.bytes = raw[:lead], raw[lead:]
        self.slashes = lead - len(self.before.rstrip(b"\\"))
        self.marks = _marks(self.bytes, self.slashes)

    def holds(self, at, kind, key):
        """Whether the bracket at ``at`` opens the array of records."""
        if kind != OPENS[1]:
            return False
        if not key:
            return True
        lead = self.bytes[max(0, at - LOOK_BACK):at]
        if len(lead) < LOOK_BACK:
            lead = self.before + lead
        return re.search(rb'(?<!\\)"' + re.escape(key.encode()) + rb'"\s*:\s*$', lead[-LOOK_BACK:]) is not None


def summary(r, key):
    """What a range does to its reader, begun outside and inside a string: [in string after, depth change, {level: holds records}]."""
    quotes, at, kind = r.marks
    out = []
    for in_string in (0, 1):
        a, k, level, net = _outside(quotes, at, kind, in_string)
        opened = np.flatnonzero((k == OPENS[0]) | (k == OPENS[1]))[::-1]
        levels, where = np.unique(level[opened], return_index=True)
        last = {int(n): r.holds(int(a[opened[w]]), k[opened[w]], key) for n, w in zip(levels, where)}
        out.append([(in_string + len(quotes)) % 2, net, last])
    return out


def starts(summaries, level):
    """Start (in string, depth, inside the array of records) of each of a document's ranges, from their summaries in order."""
    in_string, depth, inside, out = 0, 0, False, []
    for s in summaries:
        out.append([in_string, depth, inside])
        then, net, last = s[in_string]
        inside = last.get(level - depth, inside)
        in_string, depth = then, depth + net
    return out, (in_string, depth)


def cut(file, start, end, size, state, key):
    """Texts of the records that begin between two positions of a document."""
    level = 1 if key else 0
    in_string, depth, inside = state
    r = _Range(file, start, end)
    at, kind, before, net = _outside(*r.marks, in_string)
    if (start, end) == (0, size) and (net or len(r.marks[0]) % 2):
        raise ValueError("unfinished JSON document")
    before = before + depth
    arrays = np.flatnonzero((before == level) & ((kind == OPENS[0]) | (kind == OPENS[1])))
    held = np.array([inside] + [r.holds(int(at[i]), kind[i], key) for i in arrays])
    begin = np.flatnonzero((before == level + 1) & (kind == OPENS[0]))
    begin = at[begin[held[np.searchsorted(arrays, begin)]]]
    close = at[(before == level + 2) & ((kind == CLOSES[0]) | (kind == CLOSES[1]))]
    stop = np.searchsorted(close, begin)
    for b, s in zip(begin.tolist(), stop.tolist()):
        if s < len(close):
            yield r.bytes[b:close[s] + 1].decode()
        else:
            yield _finish(file, [r.bytes[b:]], start, end, size, (in_string + len(r.marks[0])) % 2, depth + net, level)


def _finish(file, parts, start, at, size, in_string, depth, level):
    """A record that runs over the end of its range."""
    while at < size:
        r = _Range(file, at, min(size, at + (1 << 20)))
        where, kind, before, net = _outside(*r.marks, in_string)
        close = where[(before + depth == level + 2) & ((kind == CLOSES[0]) | (kind == CLOSES[1]))]
        if len(close):
            return b"".join(parts + [r.bytes[:close[0] + 1]]).decode()
        parts.append(r.bytes)
        at, in_string, depth = at + len(r.bytes), (in_string + len(r.marks[0])) % 2, depth + net
    raise ValueError(f"a record that begins after byte {start} of a JSON document has no end")


class _Task(InputPartition):
    def __init__(self, ranges):
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.tasks, self.key, self.sums = json.loads(options["tasks"]), options.get("key") or None, options["mode"] == "sums"

    def partitions(self):
        return [_Task(t) for t in self.tasks]

    def read(self, partition):
        batch, held = [], 0
        for path, size, start, end, state in partition.ranges:
            with _open(path) as f:
                for x in [json.dumps(summary(_Range(f, start, end), self.key))] if self.sums else cut(f, start, end, size, state, self.key):
                    batch.append((path, start, x))
                    held += len(x)
                    if held > BATCH_BYTES:
                        yield self.batch(batch)
                        batch, held = [], 0
        if batch:
            yield self.batch(batch)

    @staticmethod
    def batch(rows):
        path, start, value = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(start, pa.int64()), pa.array(value, pa.string())], names=["path", "start", "value"])


class JsonRecords(DataSource):
    @classmethod
    def name(cls):
        return "json_records"

    def schema(self):
        return "path string, start bigint, value string"

    def reader(self, schema):
        return _Reader(self.options)


def _tasks(ranges, split_bytes):
    """Ranges dealt to tasks: consecutive ones share a task up to ``split_bytes``."""
    out, held = [], 0
    for r in ranges:
        n = r[3] - r[2]
        if not out or held + n > split_bytes:
            out.append([])
            held = 0
        out[-1].append(r)
        held += n
    return out


def read_records(spark, path, key=None, split_bytes=SPLIT_BYTES):
    """``value``: text of every object in the array under ``key`` of each document's root (of the root array without a key).

    ``path`` is a file or folder; a file may hold several documents one after the other. Elements that are no objects are left
    out, empty files and arrays give no rows, an unfinished document is an error. Tasks open files by pyarrow's file systems.
    The driver holds the list of files and one short summary for each range of a cut document.
    """
    spark.dataSource.register(JsonRecords)
    files = [(r["path"], r["length"]) for r in spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()]
    load = lambda ranges, mode: (spark.read.format("json_records").option("key", key or "").option("mode", mode)
                                 .option("tasks", json.dumps(_tasks(ranges, split_bytes))).load())
    ranges = [[p, n, a, min(n, a + split_bytes), [0, 0, False]] for p, n in files for a in range(0, n, split_bytes)]
    long = [r for r in ranges if r[1] > split_bytes]
    if long:
        found = {(r["path"], r["start"]): [[s, n, {int(k): v for k, v in d.items()}] for s, n, d in json.loads(r["value"])]
                 for r in load(long, "sums").collect()}
        for p in dict.fromkeys(r[0] for r in long):
            own = [r for r in long if r[0] == p]
            states, end = starts([found[p, r[2]] for r in own], 1 if key else 0)
            if end != (0, 0):
                raise ValueError(f"unfinished JSON document: {p}")
            for r, s in zip(own, states):
                r[4] = s
    return load(ranges, "records").select("value")
