"""Geodesy as native column expressions (stay inside whole-stage codegen)."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from floetrack.config import COMPASS, R_KM


def _c(x):
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def clamp(x, lo, hi):
    """Value limited to [lo, hi]; NULL stays NULL (least / greatest would skip it)."""
    x = _c(x)
    return F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)


def micros(ts):
    """Microseconds since the epoch of a (zone-less, UTC) timestamp."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def hours_between(later, earlier):
    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def haversine(lat1, lon1, lat2, lon2, radius=R_KM):
    """Great-circle distance in the unit of ``radius``."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    s1 = F.sin(F.radians(lat2 - lat1) / 2)
    s2 = F.sin(F.radians(lon2 - lon1) / 2)
    a = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    # rounding may push a past 1 for antipodes: asin gives NaN there, a quarter turn is meant; NULL stays NULL
    return F.lit(2.0 * radius) * F.nanvl(F.asin(F.sqrt(a)), F.lit(1.5707963267948966))


def bearing(lat1, lon1, lat2, lon2):
    """Initial bearing in [0, 360)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = (F.cos(F.radians(lat1)) * F.sin(F.radians(lat2))
         - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon))
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def destination(lat, lon, bearing_deg, km, radius=R_KM):
    """struct(lat, lon) reached from a start along a bearing; longitude is not wrapped."""
    lat, lon, bearing_deg, km = map(_c, (lat, lon, bearing_deg, km))
    d, b, la = km / F.lit(radius), F.radians(bearing_deg), F.radians(lat)
    lat2 = F.asin(clamp(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(b), -1.0, 1.0))
    dlon = F.atan2(F.sin(b) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(lat2))
    return F.struct(F.degrees(lat2).alias("lat"), F.degrees(F.radians(lon) + dlon).alias("lon"))


def intermediate(lat1, lon1, lat2, lon2, f):
    """struct(lat, lon) at fraction ``f`` of the great circle; the start point when the ends coincide."""
    lat1, lon1, lat2, lon2, f = map(_c, (lat1, lon1, lat2, lon2, f))
    p1, p2, l1, l2 = F.radians(lat1), F.radians(lat2), F.radians(lon1), F.radians(lon2)
    d = haversine(lat1, lon1, lat2, lon2, 1.0)
    a = F.try_divide(F.sin((1 - f) * d), F.sin(d))
    b = F.try_divide(F.sin(f * d), F.sin(d))
    x = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2)
    y = a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
    z = a * F.sin(p1) + b * F.sin(p2)
    same = d < 1e-10
    return F.struct(
        F.when(same, lat1).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))).alias("lat"),
        F.when(same, lon1).otherwise(F.degrees(F.atan2(y, x))).alias("lon"))


def compass_to_deg(text):
    """Compass name or number (mod 360) to degrees; NULL when neither."""
    t = F.upper(F.trim(F.replace(_c(text), F.lit("°"), F.lit(""))))
    names = F.create_map(*[F.lit(v) for kv in COMPASS.items() for v in kv])
    return F.coalesce(F.try_element_at(names, t), F.pmod(t.try_cast("double"), F.lit(360.0)))


def km_per_degree(radius=R_KM):
    return 3.141592653589793 * radius / 180.0


def to_plane(lat, lon, lat0, lon0):
    """struct(x, y) km east/north of an origin on the tangent plane."""
    lat, lon, lat0, lon0 = map(_c, (lat, lon, lat0, lon0))
    k = F.lit(km_per_degree())
    return F.struct(((lon - lon0) * k * F.cos(F.radians(lat0))).alias("x"), ((lat - lat0) * k).alias("y"))


def from_plane(x, y, lat0, lon0):
    """struct(lat, lon) of tangent-plane kilometres."""
    x, y, lat0, lon0 = map(_c, (x, y, lat0, lon0))
    k = F.lit(km_per_degree())
    return F.struct((lat0 + y / k).alias("lat"), (lon0 + x / (k * F.cos(F.radians(lat0)))).alias("lon"))


def clamp_lat(lat, lo=-89.0, hi=-50.0):
    return clamp(lat, lo, hi)


def wrap_lon(lon):
    """Longitude folded into [-180, 180)."""
    return F.pmod(_c(lon) + 180.0, F.lit(360.0)) - 180.0


def vec_mag(u, v):
    """Vector magnitude; a missing component counts as zero."""
    return F.hypot(F.coalesce(_c(u), F.lit(0.0)), F.coalesce(_c(v), F.lit(0.0)))


def vec_dir_to(u, v):
    """Direction the vector points towards, [0, 360); NULL when a component is NULL."""
    return F.pmod(F.degrees(F.atan2(_c(u), _c(v))), F.lit(360.0))


def wind_from_uv(u, v):
    """struct(speed, direction): speed and the direction the wind blows from (180 when calm)."""
    u, v = _c(u), _c(v)
    frm = F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))
    return F.struct(F.hypot(u, v).alias("speed"),
                    F.when((u == 0) & (v == 0), F.lit(180.0)).otherwise(frm).alias("direction"))


def sin_cos_doy(ts):
    """struct(sin, cos) of the day of year scaled to [0, 1], period 366 days."""
    ang = F.lit(2.0 * 3.141592653589793) * (F.dayofyear(_c(ts)) - 1.0) / 366.0
    return F.struct(((F.sin(ang) + 1.0) / 2.0).alias("sin_doy"), ((F.cos(ang) + 1.0) / 2.0).alias("cos_doy"))


def season(ts):
    """Southern-hemisphere season."""
    m = F.month(_c(ts))
    return (F.when(m.isin(12, 1, 2), "summer").when(m.isin(3, 4, 5), "autumn")
            .when(m.isin(6, 7, 8), "winter").otherwise("spring"))


def cell_index(x, lo, res, n):
    """Nearest node index on a regular axis, clamped; the lower node wins a tie."""
    raw = F.ceil((_c(x) - F.lit(float(lo))) / F.lit(float(res)) - 0.5)
    return clamp(raw, 0, int(n) - 1).cast("int")


def polar_xy(lat, lon, a, b, lat_ts):
    """struct(x, y) metres of the south polar stereographic projection (Snyder 1987, central meridian 0)."""
    e = (1.0 - (b * b) / (a * a)) ** 0.5
    import math
    pc = math.radians(-lat_ts)
    tc = math.tan(math.pi / 4 - pc / 2) / ((1 - e * math.sin(pc)) / (1 + e * math.sin(pc))) ** (e / 2)
    mc = math.cos(pc) / math.sqrt(1 - e * e * math.sin(pc) ** 2)
    p = F.radians(-_c(lat))
    es = F.lit(e) * F.sin(p)
    t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - es) / (1 + es), F.lit(e / 2))
    rho = F.lit(a * mc / tc) * t
    lam = F.radians(_c(lon))
    return F.struct((rho * F.sin(lam)).alias("x"), (rho * F.cos(lam)).alias("y"))


SQL_FUNCTIONS = {
    "geo_haversine_km": ("lat1 double, lon1 double, lat2 double, lon2 double", "double",
                         "2 * 6371.0088D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + "
                         "cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    "geo_bearing": ("lat1 double, lon1 double, lat2 double, lon2 double", "double",
                    "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * "
                    "sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))), 360D)"),
    "geo_wrap_lon": ("lon double", "double", "pmod(lon + 180D, 360D) - 180D"),
}


def register_sql_functions(spark):
    """Make the geo functions callable from SQL as native (inlined) expressions."""
    for name, (args, ret, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
