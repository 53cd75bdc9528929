"""Scalar cleaning and formatting expressions."""
from pyspark.sql import functions as F

from floetrack.config import ENTITY_ID_PATTERN, ENTITY_STOP_WORDS, KM_TO_NM_IMPORT, NM_TO_KM
from floetrack.functions.geo import _c


def rnd(c, n):
    """Half-up rounding without negative zero."""
    return F.round(_c(c), n) + F.lit(0.0)


def to_number(c):
    """Text or number to double; anything non-finite or unreadable becomes NULL."""
    v = _c(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def null_safe(c):
    """Finite value rounded to 6 places, else NULL."""
    return rnd(to_number(c), 6)


def parse_time(c):
    """Text to zone-less UTC timestamp; unreadable text becomes NULL."""
    return F.try_to_timestamp(_c(c).cast("string")).cast("timestamp_ntz")


def iso_utc(ts):
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def file_date(name):
    """Timestamp from the first eight-digit group of a file name."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(_c(name), r"(\d{8})", 1), F.lit("")),
                              F.lit("yyyyMMdd")).cast("timestamp_ntz")


def km_to_nm(c, imported=False):
    return _c(c) * KM_TO_NM_IMPORT if imported else _c(c) / NM_TO_KM


def nm_to_km(c):
    return _c(c) * NM_TO_KM


def extract_ids(text, limit=2):
    """Distinct upper-cased entity ids in text order, stop words removed, first ``limit``."""
    hits = F.array_distinct(F.transform(
        F.regexp_extract_all(_c(text), F.lit(ENTITY_ID_PATTERN), F.lit(0)), F.upper))
    return F.slice(F.filter(hits, lambda x: ~x.isin(*ENTITY_STOP_WORDS)), 1, limit)


def distinct_keep_order(arr):
    return F.array_distinct(_c(arr))


def is_synthetic_row(iceberg_id=None, classification=None, source_format=None):
    """True when any marker says the row is demo or synthetic data."""
    flags = [F.lit(False)]
    if iceberg_id is not None:
        flags.append(F.coalesce(_c(iceberg_id).startswith("DEMO-"), F.lit(False)))
    if classification is not None:
        low = F.lower(F.coalesce(_c(classification), F.lit("")))
        flags.append(low.contains("demo") | low.contains("synthetic"))
    if source_format is not None:
        flags.append(F.lower(F.coalesce(_c(source_format), F.lit(""))) == "synthetic")
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def pack(c):
    return F.to_json(_c(c))


def unpack(c, schema):
    return F.from_json(_c(c), schema)
