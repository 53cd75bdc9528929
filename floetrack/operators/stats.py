"""Exact order statistics without holding a group in one buffer."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from floetrack.operators.ordered import null_join


def exact_median(df, value, by=(), name="median", levels=2, bins=2048):
    """Exact median of ``value`` per group (NULLs skipped), one row per group.

    Values are first counted per distinct value (map-side combined), then the two middle ranks are located
    through ``levels`` rounds of equal-width bins: only bin counts (at most ``bins`` per group) are ever
    ordered, and the last round orders the distinct values of the one or two bins holding the middle.
    """
    by = list(by)
    keys = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    cnt = (src.filter(F.col(value).isNotNull())
           .groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    span = cnt.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    rank = span.select(*keys, "_lo", "_hi", F.lit(0).cast("long").alias("_base"),
                       F.expr("(_n + 1) div 2").alias("_r1"), F.expr("_n div 2 + 1").alias("_r2"))
    # One target row per middle rank: it narrows its own [lo, hi] range level by level.
    target = rank.select(*keys, "_lo", "_hi", "_base", F.explode(F.array_distinct(F.array("_r1", "_r2"))).alias("_r"))
    bin_of = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor(
        (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(F.lit(0)).cast("int")
    w = Window.partitionBy(*keys, "_r").orderBy("_bin")
    for _ in range(levels):
        hist = (null_join(cnt, target if by else F.broadcast(target), keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
                .withColumn("_bin", bin_of)
                .groupBy(*keys, "_r", "_base", "_bin")
                .agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        target = (hist.withColumn("_cum", F.sum("_c").over(w) + F.col("_base"))
                  .filter((F.col("_cum") >= F.col("_r")) & (F.col("_cum") - F.col("_c") < F.col("_r")))
                  .select(*keys, "_lo", "_hi", (F.col("_cum") - F.col("_c")).alias("_base"), "_r"))
    wv = Window.partitionBy(*keys, "_r").orderBy("_v")
    final = (null_join(cnt, target if by else F.broadcast(target), keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
             .withColumn("_cum", F.sum("_c").over(wv) + F.col("_base"))
             .filter((F.col("_cum") >= F.col("_r")) & (F.col("_cum") - F.col("_c") < F.col("_r"))))
    # avg of the one or two middle values; two equal ranks collapse to the same value
    return final.groupBy(*keys).agg(F.avg("_v").alias(name)).select(*by, name)


def attach(df, one_row):
    """Add the columns of a frame of at most one row (a global aggregate) to every row, as a scalar subquery."""
    names = one_row.columns
    out = df.withColumn("_one", one_row.select(F.struct(*names)).scalar())
    return out.select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in names])


def global_cuts(df, order_ts, ties, ranks):
    """Rows at the given 1-based global ranks by ``(order_ts, *ties)``, one row per rank.

    ``ranks`` is a one-row frame with an array column ``ranks``. Only day and second counts are ordered as
    whole tables; rows themselves are ordered inside the seconds that contain a wanted rank.
    """
    day = F.date_trunc("day", F.col(order_ts))
    sec = F.date_trunc("second", F.col(order_ts))
    rows = df.select(order_ts, *ties).withColumn("_d", day).withColumn("_s", sec)

    def locate(counts, col):
        c = counts.withColumn("_cum", F.sum("_c").over(Window.partitionBy("_rank").orderBy(col)) + F.col("_base"))
        return c.filter((F.col("_cum") >= F.col("_rank")) & (F.col("_cum") - F.col("_c") < F.col("_rank")))

    # day counts are few; every wanted rank looks at all of them
    days = rows.groupBy("_d").agg(F.count(F.lit(1)).alias("_c"))
    d = locate(attach(days, ranks).withColumn("_rank", F.explode(F.array_distinct("ranks")))
               .withColumn("_base", F.lit(0).cast("long")), "_d")
    d = d.select("_d", "_rank", (F.col("_cum") - F.col("_c")).alias("_base"))
    secs = rows.join(F.broadcast(d), "_d").groupBy("_rank", "_base", "_s").agg(F.count(F.lit(1)).alias("_c"))
    s = locate(secs, "_s").select("_s", "_rank", (F.col("_cum") - F.col("_c")).alias("_base"))
    w = Window.partitionBy("_rank").orderBy(order_ts, *ties)
    return (rows.join(F.broadcast(s), "_s").withColumn("_rn", F.row_number().over(w) + F.col("_base"))
            .filter(F.col("_rn") == F.col("_rank")).select("_rank", order_ts, *ties))
