"""Keyed table store: rows in buckets by the hash of their key, rewritten bucket by bucket, one manifest naming the live files.

A merge reads the buckets that hold keys of the batch, and those only, writes their new content beside the old and commits by
writing the next manifest (copy on write). Readers open the newest complete manifest, so they see a merge whole or not at all.
The manifest also keeps the last batch of every writer: a replayed batch that was committed is passed over, one that was not is
written again. Files that neither of the two newest manifests names are removed after a commit.

Layout: ``<path>/m<number>-<run>-<batch>/`` (one small JSON file: bucket, folder; buckets without a folder are empty) and
``<path>/data/<number>-<run>-<batch>/_bucket=<k>/``.
"""
import re

from pyspark.sql import functions as F

BUCKETS = 64
MANIFEST = "kind string, bucket int, folder string, run string, batch long, buckets int, keys array<string>"


def _hadoop(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _list(spark, path):
    fs, p = _hadoop(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def _delete(spark, path):
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def versions(spark, path):
    """Complete versions of a store, oldest first: (number, run, batch)."""
    out = []
    for name in _list(spark, path):
        m = re.fullmatch(r"m(\d{12})-(\w+)-(\d+)", name)
        if m and "_SUCCESS" in _list(spark, f"{path}/{name}"):
            out.append((int(m[1]), m[2], int(m[3])))
    return sorted(out)


def _name(version):
    return f"{version[0]:012d}-{version[1]}-{version[2]}"


class Store:
    """Rows of ``schema`` unique by ``keys`` (NULL is a key like any other) in ``buckets`` buckets under ``path``.

    ``keys`` and ``buckets`` are fixed by the first merge; later ones read them from the manifest.
    """

    def __init__(self, spark, path, keys=None, buckets=BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys or []), buckets
        self._load()

    def _load(self):
        have = versions(self.spark, self.path)
        self.version = have[-1] if have else None
        self.live, self.done = {}, {}
        for r in self._manifest(self.version) if have else []:
            if r["kind"] == "bucket":
                self.live[r["bucket"]] = r["folder"]
            elif r["kind"] == "run":
                self.done[r["run"]] = r["batch"]
            else:
                self.buckets, self.keys = r["buckets"], r["keys"]

    def _manifest(self, version):
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/m{_name(version)}").collect()   # one row a bucket and writer

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _files(self, folders, schema=None):
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self, schema=None):
        """All live rows; ``schema`` is needed (and used) only while the store is empty."""
        if not self.live:
            if schema is None:
                raise ValueError(f"{self.path} holds no rows")
            return self.spark.createDataFrame([], schema)
        return self._files(sorted(self.live.values()))

    def touched(self, rows):
        """Buckets that hold keys of ``rows``: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def merge(self, rows, combine, run="batch", batch=None):
        """Replace the touched buckets by ``combine(old, rows)``; returns their numbers, none for a batch that was committed before.

        ``combine`` gets the live rows of the touched buckets and the batch (of the same columns) and returns rows with the same
        keys. ``run`` and ``batch`` name the writer and its batch; without a number it is the next one of that writer.
        """
        self._load()
        batch = self.done.get(run, -1) + 1 if batch is None else batch
        if batch <= self.done.get(run, -1):
            return []
        at = self.touched(rows)
        old = [self.live[b] for b in at if b in self.live]
        before = self._files(old).select(*rows.columns) if old else self.spark.createDataFrame([], rows.schema)
        version = ((self.version[0] if self.version else -1) + 1, run, batch)
        out = combine(before, rows).withColumn("_bucket", self.bucket())
        target = f"{self.path}/data/{_name(version)}"
        out.repartition(max(1, len(at)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(target)
        written = {int(n.split("=")[1]) for n in _list(self.spark, target) if n.startswith("_bucket=")}
        live = {b: f for b, f in self.live.items() if b not in at} | {b: f"{_name(version)}/_bucket={b}" for b in written}
        self._commit(version, live, self.done | {run: batch})
        return at

    def _commit(self, version, live, done):
        rows = [("store", None, None, None, None, self.buckets, self.keys)]
        rows += [("bucket", b, f, None, None, None, None) for b, f in sorted(live.items())] + [("run", None, None, r, n, None, None) for r, n in done.items()]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{self.path}/m{_name(version)}")
        self._load()
        keep = versions(self.spark, self.path)[-2:]
        named = {f.split("/")[0] for v in keep for f in (r["folder"] for r in self._manifest(v) if r["kind"] == "bucket")}
        for name in _list(self.spark, self.path):
            if name[0] == "m" and name[1:] not in {_name(v) for v in keep} and name[1:] < _name(keep[0]):
                _delete(self.spark, f"{self.path}/{name}")
        for name in _list(self.spark, f"{self.path}/data"):
            if name not in named and name < _name(keep[-1]):
                _delete(self.spark, f"{self.path}/data/{name}")


def upsert_into(store, rows, keep_if_null=(), insert_only=False, run="batch", batch=None):
    """``operators.status.upsert`` of a batch into a store: only the buckets of its keys are read and written."""
    from floetrack.operators.status import upsert
    return store.merge(rows, lambda old, new: upsert(old, new, store.keys, keep_if_null, insert_only), run, batch)
