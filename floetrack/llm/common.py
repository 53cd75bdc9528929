"""Shared folder, written intermediate tables and connected components."""
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from floetrack.session import shared_folder

SPACE = r"[\x20\x09-\x0D]+"


def folder(spark, name):
    """A fresh path in the folder all executors share (``spark.checkpoint.dir``; a temporary one only in local tests)."""
    base = shared_folder(spark)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df, name, codec="zstd"):
    """Write the frame once to the shared folder and read it back: lineage is cut and lost executors cost one task."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release():
    """Hand back to the system what a finished task has freed: an idle Python worker stays beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def crc_mod(key, m):
    """crc32 of the decimal text of ``key``, modulo ``m`` (NULL keys: of the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % m


def _fingerprint(e):
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges):
    """Smallest node reachable from every node of ``edges(u, v)``: rows (node, component), nodes with links only.

    Alternating large-star and small-star steps; each step is two aggregates by key and one join (which AQE can split on a
    hot centre), written to the shared folder. Rounds grow with the logarithm of the longest path.
    """
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    seen = _fingerprint(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "star")
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = written(e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                    .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
