"""Column standardisation, filtering, de-duplication and removal accounting."""
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from floetrack.config import GRID_ALIASES, REGION_LAT, UNIT_FACTORS, VARIABLE_GROUP
from floetrack.functions import geo
from floetrack.functions.values import is_synthetic_row, to_number
from floetrack.operators.ordered import null_join
from floetrack.operators.stats import attach


def standardize_columns(df, aliases=GRID_ALIASES):
    """Rename known coordinate and time aliases; a column already standard is left alone."""
    have = set(df.columns)
    ren = {a: t for a, t in aliases.items() if a in have and t not in have}
    seen = set()
    ren = {a: t for a, t in ren.items() if not (t in seen or seen.add(t))}
    return df.withColumnsRenamed(ren)


def drop_blank_ids(df, col="iceberg_id"):
    return df.filter(F.trim(F.col(col).cast("string")) != "")


def valid_coords(df, lat="latitude", lon="longitude"):
    return df.filter(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))


def clip_region(df, lat_min=REGION_LAT[0], lat_max=REGION_LAT[1], lat="latitude"):
    """Keep the latitude band; data the clip would empty is returned whole."""
    inside = F.col(lat).between(lat_min, lat_max)
    some = df.agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("_some"))
    return attach(df, some).filter(~F.col("_some") | inside).drop("_some")


def dedupe_rows(df):
    return df.dropDuplicates()


def duplicate_count(df):
    """One row: rows that repeat an earlier identical row."""
    per = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def dedupe_keys(df, keys, order):
    """First row per key by a total order (an aggregate, so a hot key is combined map-side)."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
            .select(*keys, "_b.*").select(*df.columns))


def flag_rejects(df, rules, dedupe_on=None):
    """Add ``reject_reason``: the first rule a row fails, in order; ``duplicates`` marks repeats of kept rows.

    ``rules`` is an ordered mapping reason -> reject condition. When ``duplicates`` is among the reasons its
    condition is ignored: rows equal in ``dedupe_on`` (all columns by default) are collapsed to their first copy
    with a copy count, and the surplus copies are counted. Returns the flagged frame with a ``_copies`` column.
    """
    names = list(rules)
    cut = names.index("duplicates") if "duplicates" in names else len(names)
    chain = lambda part: reduce(lambda acc, n: acc.when(rules[n], n) if acc is not None else F.when(rules[n], n), part, None)
    early, late = names[:cut], names[cut + 1:]
    none = F.lit(None).cast("string")
    out = df.withColumn("reject_reason", chain(early) if early else none)
    if "duplicates" in names:
        cols = list(dedupe_on or df.columns)
        out = out.groupBy(*cols, "reject_reason").agg(F.count(F.lit(1)).alias("_copies"))
    else:
        out = out.withColumn("_copies", F.lit(1).cast("long"))
    if late:
        out = out.withColumn("reject_reason", F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
                             .otherwise(chain(late)))
    return out


def clean_tracks(df, rules):
    """(clean rows, counts per reason): rules applied in order, duplicates after the rules before them."""
    flagged = flag_rejects(df, rules)
    early = list(rules)[:list(rules).index("duplicates")] if "duplicates" in rules else list(rules)
    clean = flagged.filter(F.col("reject_reason").isNull()).drop("reject_reason", "_copies")
    dup = ~F.coalesce(F.col("reject_reason").isin(*early), F.lit(False)) if early else F.lit(True)
    n = F.sum
    sums = {}
    for r in rules:
        if r == "duplicates":
            sums[r] = n(F.when(dup, F.col("_copies") - 1).otherwise(0))
        elif r in early:
            sums[r] = n(F.when(F.col("reject_reason") == r, F.col("_copies")).otherwise(0))
        else:
            sums[r] = n(F.when(F.col("reject_reason") == r, 1).otherwise(0))
    sums["rows_before"] = n("_copies")
    sums["rows_after"] = n(F.when(F.col("reject_reason").isNull(), 1).otherwise(0))
    agg = flagged.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in sums.items()])
    counts = agg.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(k) for k in sums]), F.array(*[F.col(k) for k in sums]))).alias("reason", "n"))
    return clean, counts


def normalize_units(df, units):
    """Convert columns to canonical units. ``units`` maps column -> source unit text; unknown units leave the column as is.

    Returns (frame, notes) where notes is a frame (variable, unit, note).
    """
    table = {(g, u): (f, o) for g, u, f, o in UNIT_FACTORS}
    canon = {"wind": "m s-1", "temperature": "K", "pressure": "Pa"}
    notes, out = [], df
    for col, unit in units.items():
        g = VARIABLE_GROUP.get(col)
        if g is None or unit == canon[g]:
            continue
        if (g, unit) in table:
            f, o = table[(g, unit)]
            out = out.withColumn(col, F.col(col) * f + o)
            notes.append((col, unit, f"{col}: converted {unit} -> {canon[g]}"))
        else:
            notes.append((col, unit, f"{col}: unknown units `{unit}`, left unchanged"))
    spark = df.sparkSession
    return out, spark.createDataFrame(notes, "variable string, unit string, note string")


def normalize_units_by_row(df, value, unit, group):
    """Convert a long-form value column by the unit named in each row (broadcast factor table)."""
    t = df.sparkSession.createDataFrame(UNIT_FACTORS, "g string, u string, f double, o double")
    t = F.broadcast(t.filter(F.col("g") == group).select(F.col("u").alias(unit), "f", "o"))     # fixed table
    return (df.join(t, unit, "left")
            .withColumn("unit_known", F.col("f").isNotNull())
            .withColumn(value, F.coalesce(F.col(value) * F.col("f") + F.col("o"), F.col(value))).drop("f", "o"))


def check_units(spec, actual, strict=False):
    """Unit conformity per variable: ok, UNITS_MISSING or UNITS_MISMATCH.

    ``strict`` is the variant that ignores case and reports a mismatch as an error.
    """
    j = spec.join(actual, "variable", "left")
    same = (F.lower(F.trim("actual")) == F.lower("units")) if strict else (F.col("actual") == F.col("units"))
    code = F.when(F.col("actual").isNull(), "UNITS_MISSING").when(~same, "UNITS_MISMATCH").otherwise("ok")
    sev = (F.when(code == "ok", "info").when((code == "UNITS_MISMATCH") & F.lit(strict), "error").otherwise("warning"))
    return j.select("variable", F.col("units").alias("expected"), "actual", code.alias("code"), sev.alias("severity"),
                    (code == "ok").alias("conforms"))


def project_schema(df, columns):
    """Select ``{name: type}``; columns the frame lacks become NULL."""
    have = set(df.columns)
    return df.select(*[(F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])


def search(df, q, cols, **equals):
    """Case-insensitive text search over several columns plus exact filters."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]))
    out = df.filter(text.contains(q.strip().lower())) if q and q.strip() else df
    for c, val in equals.items():
        out = out.filter(F.col(c) == val)
    return out


def is_synthetic(df, **cols):
    """One row: does any row carry a demo or synthetic marker."""
    return df.agg(F.coalesce(F.bool_or(is_synthetic_row(**cols)), F.lit(False)).alias("synthetic"))


def clamp_to_region(df, lat_min, lat_max, lon_min, lon_max):
    """Clamp points to the region with a note on those that moved."""
    la, lo = F.col("latitude"), F.col("longitude")
    la2, lo2 = geo.clamp(la, lat_min, lat_max), geo.clamp(lo, lon_min, lon_max)
    moved = (la != la2) | (lo != lo2)
    note = F.when(moved, F.concat(
        F.format_string("Point (%.2f, %.2f) is outside the grid; ", la, lo),
        F.format_string("snapped to (%.2f, %.2f).", la2, lo2)))
    return (df.withColumn("_n", note).withColumn("_la", la2).withColumn("_lo", lo2)
            .drop("latitude", "longitude").withColumnsRenamed({"_la": "latitude", "_lo": "longitude", "_n": "note"}))


def prefer_real(df, by="dataset", classification="classification", real_only=True):
    """Per dataset the rows of its best class (real before synthetic); real-only never falls back to synthetic."""
    low = F.lower(F.coalesce(F.col(classification), F.lit("unclassified")))
    synth = low.contains("demo") | low.contains("synthetic")
    rank = F.when(low.isin("", "unknown", "unclassified"), 2).when(synth, 1).otherwise(0)
    if real_only:
        return df.filter(rank == 0)
    best = df.groupBy(by).agg(F.min(rank).alias("_best"))       # one row per dataset
    return null_join(df, best, [by]).filter(rank == F.col("_best")).drop("_best")


def dataset_status(df, by="dataset", classification="classification"):
    low = F.lower(F.coalesce(F.col(classification), F.lit("unclassified")))
    synth = low.contains("demo") | low.contains("synthetic")
    real = ~synth & ~low.isin("", "unknown", "unclassified")
    return df.groupBy(by).agg(F.when(F.bool_or(real), "available").otherwise("unavailable").alias("status"))


def thin_dates(df, k=None, stride=None, time_col="obs_time"):
    """Every ``max(1, n_dates // k)``-th (or ``stride``-th) distinct date; only the date list is ordered."""
    d = F.to_date(time_col)
    dates = df.select(d.alias("_d")).distinct()
    w = Window.orderBy("_d")                       # distinct dates: one row per day of data
    n = F.count(F.lit(1)).over(Window.partitionBy())
    step = F.lit(stride) if stride else F.greatest(F.lit(1), F.floor(n / F.lit(max(1, k))))
    keep = (dates.withColumn("_i", F.row_number().over(w) - 1).withColumn("_step", step)
            .filter(F.col("_i") % F.col("_step") == 0).select("_d"))
    return df.withColumn("_d", d).join(keep, "_d", "left_semi").drop("_d")


def keep_dates(df, dates, time_col="obs_time"):
    """Rows whose date is among ``dates`` (a frame with a ``date`` column)."""
    return (df.withColumn("_d", F.to_date(time_col))
            .join(dates.select(F.col("date").alias("_d")).distinct(), "_d", "left_semi").drop("_d"))


def first_of_day(df, keys, variables, time_col="obs_time"):
    """First non-missing observation per day, key and variable, in long form."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"))
                                for c in variables]))
    long = (df.select(*keys, time_col, parts.alias("_v")).select(*keys, time_col, "_v.variable", "_v.value")
            .filter("value is not null"))
    return (long.groupBy(F.to_date(time_col).alias("date"), *keys, "variable")
            .agg(F.min_by("value", F.struct(time_col, "value")).alias("value"), F.min(time_col).alias("first_time")))


def ocean_cells_only(df, primary="thetao", secondary="so"):
    """(cells where the primary, else the secondary variable is present, one-row count of dropped cells)."""
    cols = [c for c in (primary, secondary) if c in df.columns]
    present = to_number(cols[0]).isNotNull() if cols else F.lit(True)
    return df.filter(present), df.agg(F.count_if(~present).alias("dropped"))


def present_columns(df, required):
    """Required columns the frame has, in the required order (``missing`` those it lacks)."""
    have = set(df.columns)
    return [c for c in required if c in have], [c for c in required if c not in have]


def union_all(*dfs):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_distinct(a, b, keys=None):
    u = a.unionByName(b, allowMissingColumns=True)
    return u.dropDuplicates(list(keys)) if keys else u.dropDuplicates()


def unseen(new, known, key):
    return new.join(known.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti")


def select_ids(df, ids, key):
    """(rows whose key is listed, listed keys that were not found)."""
    want = ids.select(key).distinct()
    return df.join(want, key, "left_semi"), want.join(df.select(key).distinct(), key, "left_anti")
