"""Radii, unit factors, thresholds, weights and labels used across the library."""
from dataclasses import dataclass, field

# Earth radii (the caller picks the one its figures are defined with).
R_KM = 6371.0088
R_KM_ROUND = 6371.0
R_NM = 3440.065

# Length factors.
NM_TO_KM = 1.852
KM_TO_NM_IMPORT = 0.539957
KM_TO_NM_ALERT = 0.5399568

# Regional latitude bands.
REGION_LAT = (-90.0, -50.0)
SEA_ICE_LAT = (-75.0, -55.0)

# Column aliases.
TRACK_ALIASES = {
    "id": "iceberg_id", "iceberg": "iceberg_id",
    "time": "timestamp", "date": "timestamp",
    "lat": "latitude", "lat_dd": "latitude",
    "lon": "longitude", "lon_dd": "longitude",
    "length": "length_nm", "width": "width_nm",
}
GRID_ALIASES = {
    "lat": "latitude", "lat_dd": "latitude", "y": "latitude",
    "lon": "longitude", "lon_dd": "longitude", "x": "longitude",
    "valid_time": "time", "datetime": "time",
}
TRACK_COLUMNS = ("iceberg_id", "timestamp", "latitude", "longitude", "length_nm", "width_nm")

# Unit conversions: variable group, source unit, factor, offset.
UNIT_FACTORS = [
    ("wind", "ms", 1.0, 0.0), ("wind", "m/s", 1.0, 0.0), ("wind", "m s-1", 1.0, 0.0),
    ("wind", "knots", 0.514444, 0.0), ("wind", "km/h", 0.277778, 0.0),
    ("temperature", "K", 1.0, 0.0), ("temperature", "degC", 1.0, 273.15),
    ("temperature", "C", 1.0, 273.15), ("temperature", "degree_Celsius", 1.0, 273.15),
    ("pressure", "Pa", 1.0, 0.0), ("pressure", "hPa", 100.0, 0.0),
    ("pressure", "mbar", 100.0, 0.0), ("pressure", "mb", 100.0, 0.0),
]
VARIABLE_GROUP = {"u10": "wind", "v10": "wind", "t2m": "temperature", "msl": "pressure"}

# Variable specifications: dataset, variable, units, low, high, cadence in hours.
VARIABLE_SPEC = [
    ("sea_ice", "sea_ice_concentration", "fraction", 0.0, 1.0, 24),
    ("ocean_surface", "uo", "m s-1", -5.0, 5.0, 24),
    ("ocean_surface", "vo", "m s-1", -5.0, 5.0, 24),
    ("ocean_surface", "thetao", "K", -3.0, 308.0, 24),
    ("ocean_surface", "so", "psu", 0.0, 42.0, 24),
    ("weather_surface", "u10", "m s-1", -80.0, 80.0, 1),
    ("weather_surface", "v10", "m s-1", -80.0, 80.0, 1),
    ("weather_surface", "t2m", "K", 150.0, 330.0, 1),
    ("weather_surface", "msl", "Pa", 90000.0, 105000.0, 1),
]

# Compass names.
COMPASS = {"N": 0.0, "NE": 45.0, "E": 90.0, "SE": 135.0, "S": 180.0, "SW": 225.0, "W": 270.0, "NW": 315.0}

# Ice-class concentration limits.
ICE_CLASS_LIMITS = {"PC1": 1.0, "PC2": 1.0, "PC3": 1.0, "PC4": 0.8, "PC5": 0.6, "PC6": 0.45, "PC7": 0.3, "NO": 0.2}

# Route preference weights (safety, distance); "recommended" comes from the objective weights.
PREFERENCE_WEIGHTS = {
    "shortest": (0.0, 1.0), "safest": (1.0, 0.0), "fuel_efficient": (0.3, 0.7), "alternative": (0.85, 0.15),
}

# Forecast horizons in hours.
TRACK_HORIZONS = [2, 4, 6, 12, 24, 48, 72]
SEA_ICE_HORIZONS = [6, 12, 24, 48, 72]

# Accuracy component weights, labels.
SCORE_WEIGHTS = {"sea_ice": 0.35, "iceberg": 0.30, "route": 0.20, "recalc": 0.10, "land_mask": 0.05}
SCORE_LABELS = {
    "sea_ice": "Sea-Ice Model (R2)", "iceberg": "Iceberg Model (km error)", "route": "Route Engine",
    "recalc": "2-Hour Recalculation", "land_mask": "Land Mask",
}

# Visible names of real sources.
REAL_LABELS = {
    "sea_ice": "real_sea_ice", "iceberg": "real_iceberg", "ocean_currents": "real_ocean",
    "weather": "real_weather", "vessel": "real_vessel", "bathymetry": "real_bathymetry",
}

# Entity id pattern and words that are not ids.
ENTITY_ID_PATTERN = r"(?i)([A-Z]{2,5}-?[A-Z]?[0-9]{3,4})"
ENTITY_STOP_WORDS = ("DEMO", "LSTM", "RF")

# Polar stereographic source grids: origin x, step x, origin y, step y, rows, columns, ellipsoid, true-scale latitude.
POLAR_GRIDS = {
    "3125m": dict(x0=-3950000.0, dx=3125.0, y0=4350000.0, dy=-3125.0, ny=2656, nx=2528,
                  a=6378137.0, b=6356752.314245179, lat_ts=-70.0),
    "1000m": dict(x0=-3946875.0, dx=1000.0, y0=4346125.0, dy=-1000.0, ny=8294, nx=7894,
                  a=6378273.0, b=6356889.449, lat_ts=-70.0),
}


@dataclass(frozen=True)
class RiskConfig:
    """Risk thresholds and weights."""
    w_ice: float = 0.40
    w_iceberg: float = 0.35
    w_weather: float = 0.25
    max_safe_concentration: float = 0.6
    ice_block: float | None = 0.85
    ice_high: float | None = 0.6
    ice_moderate: float | None = 0.3
    exclusion_km: float = 20.0
    buffer_km: float = 30.0
    reach_km: float = 150.0
    hard_block_km: float | None = None
    block_radius_km: float | None = None
    warning_radius_km: float | None = None
    horizon_hours: int = 24
    min_clearance_km: float = 10.0
    max_wind_knots: float = 50.0
    max_wave_m: float = 8.0
    max_risk: float = 0.95
    class_limits: dict = field(default_factory=lambda: dict(ICE_CLASS_LIMITS))
    safety_weight: float = 0.6
    distance_weight: float = 0.4

    @property
    def iceberg_block_km(self):
        return self.block_radius_km if self.block_radius_km is not None else self.hard_block_km


# The deployed thresholds.
DEPLOYED = RiskConfig(hard_block_km=20.0, block_radius_km=20.0, warning_radius_km=60.0)
# The older weights; their fourth share, 0.15 for distance, belongs to the route, not to the cell.
LEGACY = RiskConfig(w_ice=0.35, w_iceberg=0.30, w_weather=0.20)
