"""Order-dependent work on keyed rows that stays balanced when one key holds a large share of the data.

Results are the same for every chunk setting, NULL keys and NULL order values included; the setting only decides how a key's
rows are spread. Keys that fit a task use plain windows: one shuffle. A key that does not is cut into chunks at quantiles of
its whole ordering tuple (numbers, times, texts and NULLs alike, ties cut by the next column), every window runs per
``(key, chunk)``, and two aids keep the results identical to a window over the whole key:

* ``with_halo`` copies the last / first few rows of the neighbouring chunks into each chunk, so bounded
  frames (lag, lead, rows between) see their neighbours;
* ``with_prefix`` adds what earlier chunks summed up to, so running sums and row numbers continue, plus
  per-key totals. The helper table has one row per key and chunk.

Rows without an ordering value come first, as in a window.
"""
import math
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from floetrack.functions.geo import micros
from floetrack.session import materialize

CHUNK = "_chunk"
HALO = "_halo"
DAY_US = 86_400_000_000.0
TASK_ROWS = 4_000_000           # rows of one key a single task may order
ROW_BYTES = 4                   # inputs below TASK_ROWS of so many bytes are not measured: the plan's size tells
SAMPLE = 64                     # sampled tuples per chunk
AUTO = "auto"


def _position(df, col):
    """Ordering column on a numeric scale (microseconds for times)."""
    return micros(col) if dict(df.dtypes)[col].startswith("timestamp") else F.col(col)


class Width(float):
    """A chunk width already on the ordering column's scale."""


class Cuts:
    """Cuts of the keys that are too large for a task: frame (keys, _cuts), cuts being ordered tuples of the columns ``order``."""

    def __init__(self, keys, order, cuts):
        self.keys, self.order, self.cuts = list(keys), list(order), cuts


NO_VALUE = -(1 << 62)           # chunk of the rows without an ordering value, when a width is forced
MAX_CUTS = 4096


def null_join(left, right, cols, how="inner"):
    """Join on columns of equal names where NULL equals NULL; the left side's columns stay."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols])
    return left.join(r, on, how).drop(*[f"_r_{c}" for c in cols])


def below(cuts, x, n):
    """How many values of the ordered array ``cuts`` (of ``n``) are at or below ``x``: two short walks instead of one long."""
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("int")
    heads = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda i: F.get(cuts, i * step))
    h = F.size(F.filter(heads, lambda c: c <= x))
    part = F.size(F.filter(F.slice(cuts, (h - 1) * step + 1, step), lambda c: c <= x))
    return F.when((n == 0) | (h == 0), F.lit(0)).otherwise((h - 1) * step + part).cast("long")


def chunk_width(df, keys, order, chunk=AUTO):
    """How to cut keys: None (plain windows), a width on the ordering column's scale, or cuts of the large keys.

    ``chunk``: ``auto`` measures the keys with one aggregate, unless the plan's size shows that no key can be large (a caller
    that knows better passes the value of an earlier call); None asks for plain windows, as a streaming frame needs; a number
    forces a width (days for times, units otherwise).
    """
    if chunk is None or isinstance(chunk, (Width, Cuts)):
        return chunk
    if chunk != AUTO:
        return Width(chunk * DAY_US if dict(df.dtypes)[order[0]].startswith("timestamp") else chunk)
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= TASK_ROWS * ROW_BYTES:
        return None
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = sizes.agg(F.max("_n")).first()[0]
    if n is None or n <= TASK_ROWS:
        return None
    return Cuts(keys, order, _cuts(df, keys, order, sizes.filter(F.col("_n") > TASK_ROWS)))


def _tuple(cols):
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(cols)])


def _cuts(df, keys, order, big):
    """Written table of cuts: quantiles of the distinct tuples in a hash sample of each large key (all of them, if few)."""
    m = F.least(F.lit(MAX_CUTS), F.ceil(2 * F.col("_n") / TASK_ROWS)).cast("int")
    rows = null_join(df.select(*keys, _tuple(order).alias("_o")), big, keys).withColumn("_m", m)
    kept = rows.filter(F.pmod(F.xxhash64("_o"), F.lit(1 << 30)) / float(1 << 30) * F.col("_n") <= SAMPLE * F.col("_m"))
    s = kept.groupBy(*keys, "_m").agg(F.array_sort(F.collect_set("_o")).alias("_s"))
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_m") - 1)), lambda i: F.get("_s", F.floor(i * F.size("_s") / F.col("_m")).cast("int")))
    return materialize(s.select(*keys, F.array_distinct(at).alias("_cuts")))


def with_chunk(df, order, width):
    """Add ``_chunk``; a constant when ``width`` is None. Chunks ascend in the order of the rows, NULLs first."""
    if width is None:
        return df.withColumn(CHUNK, F.lit(0).cast("long"))
    if isinstance(width, Width):
        c = F.floor(_position(df, order[0]).cast("double") / F.lit(float(width))).cast("long")
        return df.withColumn(CHUNK, F.coalesce(c, F.lit(NO_VALUE)))
    k = min(len(order), len(width.order))   # an operator that orders by fewer columns cuts by these
    cuts = width.cuts
    if k < len(width.order):
        head = F.transform("_cuts", lambda c: F.struct(*[c[f"o{i}"].alias(f"o{i}") for i in range(k)]))
        cuts = cuts.withColumn("_cuts", F.array_distinct(head))
    out = null_join(df, cuts, width.keys, "left")
    c = F.when(F.col("_cuts").isNotNull(), below(F.col("_cuts"), _tuple(order[:k]), F.size("_cuts"))).otherwise(F.lit(0).cast("long"))
    return out.withColumn(CHUNK, c).drop("_cuts")


def window(keys, order, width):
    """Window over a key in order, or over its chunk when chunked."""
    w = Window.partitionBy(*keys) if width is None else Window.partitionBy(*keys, CHUNK)
    return w.orderBy(*order)


def with_halo(df, keys, order, width, before=0, after=0):
    """Rows plus ``_chunk`` and ``_halo``; halo rows are copies from neighbouring chunks to be dropped later."""
    keys, order = list(keys), list(order)
    base = with_chunk(df, order, width)
    out = [base.withColumn(HALO, F.lit(False))]
    if width is None or not (before or after):
        return out[0]
    sizes = base.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    wk = Window.partitionBy(*keys).orderBy(CHUNK)
    sizes = sizes.withColumn("_cum", F.sum("_n").over(wk))
    for k, back in ((before, True), (after, False)):
        if not k:
            continue
        rows = wk.rowsBetween(1, k) if back else wk.rowsBetween(-k, -1)
        near = F.collect_list(F.struct(
            F.col(CHUNK).alias("c"), (F.col("_cum") - F.col("_n")).alias("start"), F.col("_cum").alias("end"))).over(rows)
        target = (sizes.withColumn("_near", near).withColumn("_t", F.explode("_near"))
                  .select(*keys, CHUNK, F.col("_t.c").alias("_to"),
                          ((F.col("_t.start") - F.col("_cum")) if back
                           else (F.col("_cum") - F.col("_n") - F.col("_t.end"))).alias("_skip"))
                  .filter(F.col("_skip") < k))
        w = Window.partitionBy(*keys, CHUNK).orderBy(*([F.desc(o) for o in order] if back else order))  # NULLs first, or last backwards
        edge = base.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
        out.append(null_join(edge, target, keys + [CHUNK])
                   .filter(F.col("_r") + F.col("_skip") <= k)
                   .withColumn(CHUNK, F.col("_to")).drop("_r", "_to", "_skip")
                   .withColumn(HALO, F.lit(True)))
    return reduce(lambda a, b: a.unionByName(b), out)


def drop_halo(df, keep_chunk=False):
    out = df.filter(~F.col(HALO)).drop(HALO)
    return out if keep_chunk else out.drop(CHUNK)


def with_prefix(df, keys, width, sums=(), mins=(), maxs=(), count=None):
    """Add per-key totals and the sums of earlier chunks to rows that carry ``_chunk``.

    For every column ``c`` of ``sums``: ``c_before`` (earlier chunks) and ``c_total``; of ``mins`` / ``maxs``:
    ``c_min`` / ``c_max`` of the key; ``count`` names a row counter giving ``<count>_before`` and ``<count>_total``.
    """
    keys = list(keys)
    zero = {c: F.lit(0.0) for c in sums}
    if count:
        zero[count] = F.lit(0).cast("long")
    wk = Window.partitionBy(*keys)
    if width is None:
        cols = [z.alias(f"{c}_before") for c, z in zero.items()]
        cols += [F.sum(c).over(wk).alias(f"{c}_total") for c in sums]
        cols += [F.min(c).over(wk).alias(f"{c}_min") for c in mins] + [F.max(c).over(wk).alias(f"{c}_max") for c in maxs]
        if count:
            cols.append(F.count(F.lit(1)).over(wk).alias(f"{count}_total"))
        return df.select("*", *cols)
    aggs = [F.sum(c).alias(f"_s_{c}") for c in sums]
    aggs += [F.min(c).alias(f"_mn_{c}") for c in mins] + [F.max(c).alias(f"_mx_{c}") for c in maxs]
    if count:
        aggs.append(F.count(F.lit(1)).alias(f"_s_{count}"))
    part = df.groupBy(*keys, CHUNK).agg(*aggs)
    wb = wk.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(f"_s_{c}").over(wb), z).alias(f"{c}_before") for c, z in zero.items()]
    cols += [F.sum(f"_s_{c}").over(wk).alias(f"{c}_total") for c in zero]
    cols += [F.min(f"_mn_{c}").over(wk).alias(f"{c}_min") for c in mins]
    cols += [F.max(f"_mx_{c}").over(wk).alias(f"{c}_max") for c in maxs]
    return null_join(df, part.select(*keys, CHUNK, *cols), keys + [CHUNK])


def running_sum(col, keys, order, width):
    """Sum up to the row within its chunk; add ``<col>_before`` for the running sum of the key."""
    return F.sum(col).over(window(keys, order, width).rowsBetween(Window.unboundedPreceding, 0))


def row_numbers(df, keys, order, width, rn="rn", n=None):
    """1-based position of each row within its key and, on request, the key's row count."""
    base = with_chunk(df, order, width).withColumn("_rn0", F.row_number().over(window(keys, order, width)))
    out = with_prefix(base, keys, width, count="_rows").withColumn(rn, F.col("_rn0") + F.col("_rows_before"))
    if n:
        out = out.withColumn(n, F.col("_rows_total"))
    return out.drop("_rn0", "_rows_before", "_rows_total", CHUNK)


def last_per_key(df, keys, order):
    """Last row of each key by ``order``; a map-side combined aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
            .select(*keys, "_b.*"))
