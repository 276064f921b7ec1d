"""Parameters of the climatology; every threshold is one of these, none is built in elsewhere."""

from __future__ import annotations

from dataclasses import dataclass, field

# The record layout, as (name, start, end, scale, sentinel); slices count from 0.
MANDATORY = [
    ("usaf", 4, 10, None, None), ("wban", 10, 15, None, None), ("datetime_raw", 15, 27, None, None),
    ("lat", 28, 34, 1000.0, "+99999"), ("lon", 34, 41, 1000.0, "+999999"), ("report_type", 41, 46, None, None),
    ("wind_dir", 60, 63, 1.0, "999"), ("wind_dir_qc", 63, 64, None, None), ("wind_type", 64, 65, None, None),
    ("wind_speed_ms", 65, 69, 10.0, "9999"), ("wind_speed_qc", 69, 70, None, None),
    ("ceiling_m", 70, 75, 1.0, "99999"), ("ceiling_qc", 75, 76, None, None),
    ("visibility_m", 78, 84, 1.0, "999999"), ("visibility_qc", 84, 85, None, None),
    ("temp_c", 87, 92, 10.0, "+9999"), ("temp_qc", 92, 93, None, None),
    ("dewpoint_c", 93, 98, 10.0, "+9999"), ("dewpoint_qc", 98, 99, None, None),
    ("slp_hpa", 99, 104, 10.0, "99999"), ("slp_qc", 104, 105, None, None),
]
RECORD_LENGTH = 105

# Optional sections behind the mandatory part, as (name, pattern, scale, sentinel).
SECTIONS = [
    ("precip_period_h", r"AA1(\d{2})\d{4}.\d", 1.0, "99"), ("precip_mm", r"AA1\d{2}(\d{4}).\d", 10.0, "9999"), ("precip_qc", r"AA1\d{2}\d{4}.(\d)", None, None),
    ("snow_depth_cm", r"AJ1(\d{4}).\d", 1.0, "9999"), ("snow_depth_qc", r"AJ1\d{4}.(\d)", None, None),
    ("sky_cover_oktas", r"GF1(\d{2})\d{2}\d", 1.0, "99"), ("sky_cover_qc", r"GF1\d{2}\d{2}(\d)", None, None),
]

# Each measured value's quality flag and physical bounds (none for the wind's direction).
QC_OF = {
    "temp_c": "temp_qc", "dewpoint_c": "dewpoint_qc", "wind_dir": "wind_dir_qc", "wind_speed_ms": "wind_speed_qc", "slp_hpa": "slp_qc",
    "visibility_m": "visibility_qc", "ceiling_m": "ceiling_qc", "precip_mm": "precip_qc", "snow_depth_cm": "snow_depth_qc", "sky_cover_oktas": "sky_cover_qc",
}
BOUNDS = {
    "temp_c": (-60.0, 60.0), "dewpoint_c": (-70.0, 40.0), "wind_speed_ms": (0.0, 75.0), "slp_hpa": (900.0, 1090.0), "visibility_m": (0.0, 160000.0),
    "ceiling_m": (0.0, 22000.0), "precip_mm": (0.0, 500.0), "snow_depth_cm": (0.0, 500.0), "sky_cover_oktas": (0.0, 8.0),
}
# Variables that are averaged by hour, and report types that count, padded as in the files.
CONTINUOUS = ["temp_c", "dewpoint_c", "wind_speed_ms", "slp_hpa", "visibility_m", "ceiling_m", "sky_cover_oktas"]
REPORT_TYPES = ["FM-12", "FM-13", "FM-15", "FM-16", "CRN05", "MESOW", "SY-MT", "SY-SA", "SAO", "SAOSP", "AUTO", "AERO"]

# The model's features in order, as name: (label, unit, group); the order is that of vectors and loadings.
FEATURES = {
    "annual_mean_temp_f": ("Annual mean temperature", "°F", "temperature"),
    "winter_mean_temp_f": ("Winter (DJF) mean temperature", "°F", "temperature"),
    "summer_mean_temp_f": ("Summer (JJA) mean temperature", "°F", "temperature"),
    "seasonal_temp_range_f": ("Seasonal range (summer - winter)", "°F", "temperature"),
    "diurnal_temp_range_f": ("Mean diurnal range (daily max - min)", "°F", "temperature"),
    "hot_days_per_year": ("Days >= 90°F per year", "days/yr", "temperature"),
    "freeze_days_per_year": ("Days with min <= 32°F per year", "days/yr", "temperature"),
    "annual_precip_in": ("Annual precipitation", "in", "precipitation"),
    "wet_days_per_year": ("Wet days (>= 0.04 in) per year", "days/yr", "precipitation"),
    "summer_precip_fraction": ("Share of precipitation falling in JJA", "fraction", "precipitation"),
    "frozen_precip_days_per_year": ("Frozen-precipitation days per year (proxy for snow days)", "days/yr", "snow"),
    "summer_dewpoint_f": ("Summer (JJA) mean dew point", "°F", "humidity"),
    "annual_dewpoint_depression_f": ("Mean dew-point depression (T - Td)", "°F", "humidity"),
    "mean_wind_mph": ("Mean wind speed", "mph", "wind"),
}
FEATURE_NAMES = list(FEATURES)
# Features that need a gauge.
PRECIP_FEATURES = ["annual_precip_in", "wet_days_per_year", "summer_precip_fraction", "frozen_precip_days_per_year"]


@dataclass(frozen=True)
class Climate:
    """Window, selection, cleaning, validity and model parameters, with the defaults in use."""

    start_year: int = 2015
    end_year: int = 2024
    lat_range: tuple = (24.0, 50.0)
    lon_range: tuple = (-125.0, -66.0)
    country: str = "US"
    qc_fail: tuple = ("2", "3", "6", "7")
    bounds: dict = field(default_factory=lambda: dict(BOUNDS))
    report_types: tuple = tuple(REPORT_TYPES)
    min_obs_per_day: int = 18
    min_days_fraction: float = 0.7
    min_precip_report_fraction: float = 0.02
    hot_c: float = 32.2
    freeze_c: float = 0.0
    wet_mm: float = 1.0
    year_days: float = 365.25
    merge_year_boundary: bool = False
    neighbors: int = 10
    seed: int = 42
    earth_mi: float = 3958.8
    max_score: int = 5000
    score_scale_mi: float = 1250.0
    score_radius_mi: float = 15.0
    window_years: float = 0.0

    @property
    def window_days(self) -> float:
        return (self.window_years or self.end_year - self.start_year + 1) * self.year_days
