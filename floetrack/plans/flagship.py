"""The flagship query: fixes with kinematics and their environment."""
from pyspark.sql import functions as F

from floetrack.functions import geo
from floetrack.functions.values import rnd
from floetrack.operators.axes import grid_axes
from floetrack.operators.joins import env_join, no_env
from floetrack.operators.tracks import feature_lags, kinematics, per_track_split

ENV = (("sea_ice", ["sic"]), ("ocean", ["uo", "vo"]), ("weather", ["u10", "v10", "t2m", "msl"]))


def track_environment(tracks, grid, tolerance_hours=24.0, axes=None):
    """Kinematics plus sea-ice, ocean and weather values at every fix; the three domains may share one grid table.

    Domains on the same grid are fetched by one join; gap and staleness are reported per domain.
    """
    ax = axes or grid_axes(grid)
    every = [c for _, cols in ENV for c in cols]
    out = env_join(kinematics(tracks), grid, every, "env", tolerance_hours, ax)
    for name, _ in ENV:
        out = out.withColumn(f"{name}_gap_hours", F.col("env_gap_hours")).withColumn(f"{name}_stale", F.col("env_stale"))
    return _vectors(out.drop("env_gap_hours", "env_stale"))


def _vectors(out):
    return (out.withColumn("current_magnitude", rnd(geo.vec_mag("uo", "vo"), 6)).withColumn("current_direction", rnd(geo.vec_dir_to("uo", "vo"), 4))
            .withColumn("wind_magnitude", rnd(geo.vec_mag("u10", "v10"), 6)).withColumn("wind_direction", rnd(geo.vec_dir_to("u10", "v10"), 4)))


def track_environments(tracks, grids, tolerance_hours=24.0, axes=None):
    """Kinematics plus sea-ice, ocean and weather values, each from a grid with axes of its own.

    ``grids``: domain -> long table; a domain that is absent (or None) gives NULLs and counts as stale. Each grid costs one
    equi-join on three integers; gap and staleness are the domain's own.
    """
    out = kinematics(tracks)
    for name, cols in ENV:
        grid = grids.get(name)
        out = no_env(out, cols, name) if grid is None else env_join(out, grid, cols, name, tolerance_hours, (axes or {}).get(name))
    return _vectors(out)


def feature_table(tracks, grids, tolerance_hours=24.0, axes=None, chunk="auto"):
    """Model features of every fix: motion, environment, lags and the track's chronological split."""
    out = feature_lags(track_environments(tracks, grids, tolerance_hours, axes).drop("displacement_nm"))
    return per_track_split(out.drop("prev_latitude", "prev_longitude"), chunk=chunk)
