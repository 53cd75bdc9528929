"""Nearest-value lookup on the axes of a regular or irregular grid.

An axis is the list of distinct coordinate values (about the cube root of the number of cells). Whether it is regular is
decided by one aggregate over all its values, of any number; a regular axis turns the lookup into arithmetic (no join and
no list at all). The values of a short irregular one become a table of value ranges keyed by bins for an equi-join; those of a
long one stay a table, and the lookup is an as-of join: both sides are cut at the same boundaries, each range finds the axis
values before and after its queries in order, and what lies beyond a range's ends is carried over from the ranges beside it.
"""
import math
from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F

from floetrack.functions.geo import _c, clamp, micros
from floetrack.operators.ordered import below
from floetrack.session import materialize

LISTED = 20_000                 # values of an irregular axis that the driver lists; a longer one stays a table
RANGE_VALUES = 50_000           # axis values per range of a long axis
MAX_RANGES = 4096


def numeric(col, dtype):
    """Coordinates as double; timestamps as whole microseconds."""
    return micros(col).cast("double") if dtype.startswith("timestamp") else _c(col).cast("double")


@dataclass(frozen=True)
class Axis:
    """Sorted distinct values of one coordinate (timestamps in microseconds); of a regular axis only the ends and their number."""
    name: str
    values: tuple
    is_time: bool = False
    count: int = 0              # set for a regular axis

    @property
    def n(self):
        return self.count or len(self.values)

    @property
    def step(self):
        return (self.values[-1] - self.values[0]) / (self.n - 1) if self.n > 1 else 1.0

    @property
    def regular(self):
        if self.count:
            return True
        lo, st = self.values[0], self.step
        tol = 0.0 if self.is_time else 1e-9 * max(1.0, abs(lo))
        return all(abs(lo + i * st - v) <= tol for i, v in enumerate(self.values))

    @property
    def bin_width(self):
        """The finest width at which the bins of all ranges stay at four a value: far outliers do not widen it."""
        gaps = [b - a for a, b in zip(self.values, self.values[1:])]
        width = max(self.step, 1e-12)
        for q in sorted(gaps):
            if q > 0 and (self.values[-1] - self.values[0]) / q <= 4 * self.n:
                return min(width, q)
        return width

    def dtype(self):
        return "timestamp_ntz" if self.is_time else "double"

    def own_index(self, col):
        """Index of a column that already holds axis values (regular axes only)."""
        x = numeric(col, self.dtype())
        return F.round((x - self.values[0]) / self.step).cast("int")

    def nearest_index(self, col):
        """Index of the nearest value, the lower one on a tie (regular axes only)."""
        x = numeric(col, self.dtype())
        raw = F.ceil((x - self.values[0]) / F.lit(float(self.step)) - 0.5)
        return clamp(raw, 0, self.n - 1).cast("int")

    def table(self, spark):
        """Axis values as a frame ``(idx, value)``."""
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(self.values)], "idx int, value double")

    def ranges(self, spark):
        """``(bin, idx, value, lo, hi)``: each value's nearest range, repeated for the bins it touches."""
        v = self.values
        lo0, width = v[0], self.bin_width
        rows = []
        for i, x in enumerate(v):
            a = (v[i - 1] + x) / 2 if i else float("-inf")
            b = (x + v[i + 1]) / 2 if i + 1 < self.n else float("inf")
            base = math.floor(lo0 / width)
            first = math.floor(max(a, lo0) / width) - base
            last = math.floor(min(b, v[-1]) / width) - base
            rows += [(k, i, float(x), float(a), float(b)) for k in range(first, last + 1)]
        return spark.createDataFrame(rows, "bin long, idx int, value double, lo double, hi double")

    def bin_of(self, col):
        x = numeric(col, self.dtype())
        x = clamp(x, float(self.values[0]), float(self.values[-1]))
        width = self.bin_width
        return (F.floor(x / F.lit(float(width))) - F.lit(math.floor(self.values[0] / width))).cast("long")

    def index_of(self, df, col, out, exact=False):
        """Add ``out``: the index of the nearest axis value (or of the value itself with ``exact``)."""
        if self.regular:
            return df.withColumn(out, self.own_index(col) if exact else self.nearest_index(col))
        r = F.broadcast(self.ranges(df.sparkSession)).select(      # at most LISTED values
            F.col("bin").alias("_bin"), F.col("idx").alias(out), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        x = numeric(col, self.dtype())
        return (df.withColumn("_bin", self.bin_of(col)).withColumn("_x", x)
                .join(r, "_bin", "left")
                .filter(F.col(out).isNull() | ((F.col("_x") > F.col("_lo")) & (F.col("_x") <= F.col("_hi"))))
                .drop("_bin", "_x", "_lo", "_hi"))

    def value_at(self, df, idx, out):
        """Add ``out``: the axis value (microseconds for time) at index column ``idx``."""
        if self.regular:
            return df.withColumn(out, F.lit(float(self.values[0])) + F.col(idx) * F.lit(float(self.step)))
        t = F.broadcast(self.table(df.sparkSession)).select(F.col("idx").alias(idx), F.col("value").alias(out))
        return df.join(t, idx, "left")


class LongAxis:
    """An irregular axis of any number of values: a written table (idx, value) in ranges, and the ranges' boundaries."""

    regular = False

    def __init__(self, name, seen, n, lo, hi, is_time=False):
        self.name, self.n, self.is_time, self.values = name, n, is_time, (lo, hi)
        parts = min(MAX_RANGES, max(1, math.ceil(n / RANGE_VALUES)))
        cuts = [] if parts == 1 else seen.agg(F.percentile_approx("v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(max(10_000, 4 * parts)))).first()[0]
        self.cuts = sorted(set(cuts))
        v = materialize(seen.select(F.col("v").alias("value")).withColumn("part", self._part("value")))
        sizes = v.groupBy("part").agg(F.count(F.lit(1)).alias("n"))                                 # one row a range
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        v = v.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
        rank = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
        self.frame = materialize(v.select("part", (F.col("before") + rank).cast("int").alias("idx"), "value"))

    def _part(self, col):
        if not self.cuts:
            return F.lit(0).cast("long")
        return below(F.array(*[F.lit(float(c)) for c in self.cuts]), F.col(col), F.lit(len(self.cuts)))

    def dtype(self):
        return "timestamp_ntz" if self.is_time else "double"

    def _carried(self):
        """Per range the last axis value before it and the first one after it; ranges without axis values included."""
        own = self.frame.groupBy("part").agg(F.min(F.struct("value", "idx")).alias("lo"), F.max(F.struct("value", "idx")).alias("hi"))
        every = self.frame.sparkSession.range(len(self.cuts) + 1).withColumnRenamed("id", "part").join(own, "part", "left")
        up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("part"), F.desc("part")))
        return every.select("part", F.last("hi", True).over(up).alias("_before"), F.last("lo", True).over(down).alias("_after"))

    def lookup(self, queries):
        """(x, idx) of the nearest axis value, the lower one on a tie, for distinct values ``queries(x)``."""
        a = self.frame.select("part", F.col("value").alias("x"), F.struct("value", "idx").alias("_own"))
        q = queries.select(self._part("x").alias("part"), "x", F.lit(None).cast(a.schema["_own"].dataType).alias("_own"))
        first = F.col("_own").isNull()                          # an axis value comes before a query of the same value
        up = Window.partitionBy("part").orderBy("x", first).rowsBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy("part").orderBy(F.desc("x"), first).rowsBetween(Window.unboundedPreceding, 0)
        both = a.unionByName(q).withColumn("_lo", F.last("_own", True).over(up)).withColumn("_hi", F.last("_own", True).over(down)).filter(first)
        both = both.join(F.broadcast(self._carried()), "part")  # one row a range
        lo, hi = F.coalesce("_lo", "_before"), F.coalesce("_hi", "_after")
        low = hi.isNull() | (F.col("x") - lo["value"] <= hi["value"] - F.col("x"))
        return both.select("x", F.when(low, lo["idx"]).otherwise(hi["idx"]).alias("idx"))

    def index_of(self, df, col, out, exact=False):
        """Add ``out``: the index of the nearest axis value (or of the value itself with ``exact``); equal values are looked up once."""
        d = df.withColumn("_x", numeric(col, self.dtype()))
        found = self.frame.select(F.col("value").alias("x"), "idx") if exact else self.lookup(d.filter("_x is not null").select(F.col("_x").alias("x")).distinct())
        r = found.select(F.col("x").alias("_rx"), F.col("idx").alias(out))
        return d.join(r, F.col("_x") == F.col("_rx"), "left").drop("_x", "_rx")

    def value_at(self, df, idx, out):
        """Add ``out``: the axis value (microseconds for time) at index column ``idx``."""
        return df.join(self.frame.select(F.col("idx").alias(idx), F.col("value").alias(out)), idx, "left")


def grid_axes(grid, columns=("obs_time", "latitude", "longitude"), listed=LISTED):
    """Read the axes of a grid in one column-pruned pass over all its rows; raises when a column holds no value."""
    types = dict(grid.dtypes)
    vals = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), numeric(c, types[c]).alias("v")) for c in columns]))
    seen = grid.select(vals.alias("a")).select("a.c", "a.v").filter("v is not null").distinct()
    ends = seen.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))       # one row per column
    step = (F.col("hi") - F.col("lo")) / (F.col("n") - 1)
    off = F.when(F.col("n") > 1, F.abs(F.col("lo") + F.round((F.col("v") - F.col("lo")) / step) * step - F.col("v"))).otherwise(F.lit(0.0))
    found = {r["c"]: r for r in seen.join(F.broadcast(ends), "c").groupBy("c", "n", "lo", "hi").agg(F.max(off).alias("off")).collect()}
    out = {}
    for c in columns:
        if c not in found:
            raise ValueError(f"grid axis {c} is empty")
        r, is_time = found[c], types[c].startswith("timestamp")
        if r["off"] <= (0.0 if is_time else 1e-9 * max(1.0, abs(r["lo"]))):
            out[c] = Axis(c, (r["lo"], r["hi"]), is_time, r["n"])
            continue
        values = seen.filter(F.col("c") == c)
        if r["n"] > listed:
            out[c] = LongAxis(c, values.select("v"), r["n"], r["lo"], r["hi"], is_time)
        else:
            out[c] = Axis(c, tuple(sorted(x["v"] for x in values.collect())), is_time)
    return out
