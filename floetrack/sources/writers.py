"""Sinks: partitioned tables, snapshots, manifests, reports."""
from pyspark.sql import functions as F

from floetrack.operators.ordered import null_join


def month_key(ts="obs_time"):
    """``YYYYMM`` partition key."""
    return F.date_format(F.col(ts), "yyyyMM").cast("int")


def lat_band_key(lat="latitude"):
    """Latitude-band partition key ``round(lat // 10) + 95``."""
    return (F.floor(F.col(lat) / 10.0) + 95).cast("int")


def write_partitioned(df, path, by, max_rows=5_000_000, fmt="parquet", mode="overwrite", sort=("latitude",)):
    """Write by partition key with at most ``max_rows`` per file.

    Tasks are balanced at run time by the measured bytes of each key: a small key is one task, a key holding much of the
    data is split over as many as its size asks for. Within a task rows are sorted for min/max skipping. ``by`` maps the key
    name to its expression.
    """
    out = df
    for k, c in by.items():
        out = out.withColumn(k, c)
    keys = list(by)
    out = out.hint("rebalance", *keys)
    cols = keys + [c for c in sort if c in df.columns]
    (out.sortWithinPartitions(*cols).write.mode(mode).format(fmt).option("maxRecordsPerFile", max_rows)
     .option("header", True).partitionBy(*keys).save(path))


def write_latest_snapshot(df, path, source="source", time_col="obs_time", fmt="parquet"):
    """Write the rows at each source's newest time."""
    last_rows(df, source, time_col).write.mode("overwrite").format(fmt).save(path)


def last_rows(df, source="source", time_col="obs_time"):
    """Rows at each source's newest time (a small aggregate joined back); rows without a source are a group of their own."""
    last = df.groupBy(source).agg(F.max(time_col).alias("_last"))
    return null_join(df, last, [source]).filter(F.col(time_col) == F.col("_last")).drop("_last")


def manifest(df, dataset):
    """Rows per file of a table that was just read: dataset, file, rows."""
    return (df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(dataset).alias("dataset"), "file", "rows"))


def write_report(df, path):
    """Write a (one-row) report frame as a JSON document."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_table(df, path, fmt="parquet", mode="overwrite"):
    df.write.mode(mode).format(fmt).option("header", True).save(path)


def write_splits(df, path, split="split", fmt="parquet"):
    """One folder per split (``split=train`` and so on)."""
    df.write.mode("overwrite").format(fmt).option("header", True).partitionBy(split).save(path)


def replace_table(spark, df, path, tmp):
    """Overwrite a table with a result that reads it: write it beside, then swap the folders by renaming.

    Between the two renames the old rows are whole under ``<path>.old`` and the new ones under ``tmp``; no write ever
    touches the live folder, so a failure loses nothing.
    """
    df.write.mode("overwrite").parquet(tmp)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    live, new, old = hadoop(path), hadoop(tmp), hadoop(path.rstrip("/") + ".old")
    fs = live.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(live) and not fs.rename(live, old):
        raise OSError(f"cannot set {path} aside")
    if not fs.rename(new, live):
        raise OSError(f"cannot put {tmp} in place of {path}; the old table is {path}.old")
    fs.delete(old, True)
