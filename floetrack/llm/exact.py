"""Exact de-duplication by a stateful stream.

Each text leaves a fingerprint (digest of the normalised text, stable identifier, code points, content locator). A stream
over the fingerprints keeps one state row per digest in RocksDB, on disk, without expiry: how many rows it has seen and the
identifier and locator of the best one. Rows that hit a digest are then held against the full bytes of the retained row,
found by its locator.
"""
from pyspark.sql import functions as F

from floetrack.llm.common import SPACE, folder, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}  # no pre-allocated files: there may be many small stores


def normalised(text):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def fingerprints(docs, key="doc_id", text="text"):
    """key, digest (SHA-256 of the normalised text), points (code points of the text) and locator of every row.

    The locator is the digest of the original text: rows with one identifier and one text are the same content.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("bigint").alias("key"), F.sha2(normalised(text).cast("binary"), 256).alias("digest"),
                       F.char_length(t).alias("points"), F.xxhash64(t).alias("locator"))


def stateful(stream):
    """Streaming state per digest: rows seen and the best row (most code points, then smallest key, NULL keys last)."""
    best = F.min(F.struct((-F.col("points")).alias("rank"), F.col("key").isNull().alias("unknown"), "key", "locator")).alias("best")
    return stream.groupBy("digest").agg(F.count("*").alias("seen"), best)


def run_stream(src, schema, spark, max_bytes=1 << 30):
    """Drive the stream over the fingerprints in folder ``src`` to its end; returns the last state of every digest.

    Each micro-batch takes up to ``max_bytes`` of fingerprints and writes the digests it changed to a folder of its own,
    overwriting what a failed attempt left.
    """
    out, ckpt = folder(spark, "states"), folder(spark, "stream")
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(src)
        changed = stateful(spark.createDataFrame([], schema)).schema.add("batch", "long")

        def keep(batch, n):
            batch.withColumn("batch", F.lit(n).cast("bigint")).write.mode("overwrite").parquet(f"{out}/step={n}")

        (stateful(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = spark.read.schema(changed).option("recursiveFileLookup", "true").parquet(out)
    return got.groupBy("digest").agg(F.max_by(F.struct("seen", "best"), "batch").alias("last")).select("digest", "last.seen", "last.best")


def dedup(docs, key="doc_id", text="text", max_bytes=1 << 30):
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256, and locator.

    Equal texts (white space deleted, NULL as empty) form a group; the row with most code points, then the smallest key
    (NULL keys last), stays. Rows that repeat the key and the text of the row that stays are one record, so all say kept.
    Hits are compared byte by byte with the row that stays; a difference (a digest collision) ends the job with an error
    rather than a wrong result. An empty table gives no rows; other columns are not read.
    """
    spark, src = docs.sparkSession, folder(docs.sparkSession, "prints")
    prints = fingerprints(docs, key, text)
    prints.write.parquet(src)
    prints = spark.read.schema(prints.schema).parquet(src)
    stays = F.col("key").eqNullSafe(F.col("best.key")) & (F.col("locator") == F.col("best.locator"))
    if prints.isEmpty():
        return prints.select(F.col("key").alias(key), F.col("key").alias("keep_id"), F.lit(0).cast("bigint").alias("group_size"),
                             F.lit(False).alias("kept"), F.col("digest").alias("text_sha256"), "locator")
    last = written(run_stream(src, prints.schema, spark, max_bytes), "groups")
    rows = docs.select(F.col(key).cast("bigint").alias("key"), normalised(text).cast("binary").alias("content"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("locator")).withColumn("digest", F.sha2("content", 256))
    hits = written(rows.join(last.where("seen > 1").select("digest", "best"), "digest").select("digest", stays.alias("stays"), "content"), "hits")
    held = hits.where("stays").dropDuplicates(["digest"]).select("digest", F.col("content").alias("held"))
    if not hits.where("not stays").join(held, "digest").where("content != held").isEmpty():
        raise ValueError("two different texts have one SHA-256 digest")
    return prints.join(last, "digest").select(F.col("key").alias(key), F.col("best.key").alias("keep_id"), F.col("seen").alias("group_size"),
                                              stays.alias("kept"), F.col("digest").alias("text_sha256"), "locator")
