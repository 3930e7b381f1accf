"""Names, types and fixed parameters of the panel data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# They have to equal the published ones for results to agree.
# ---------------------------------------------------------------------------
LOOKBACK = 48
HORIZON = 12

LAGS = (1, 2, 3, 6, 12, 24)

CALENDAR_FEATURES = ("hour_sin", "hour_cos", "doy_sin", "doy_cos")

HISTORY_FEATURES = (
    "log_frp",
    "frp_lag_1h", "frp_lag_2h", "frp_lag_3h",
    "frp_lag_6h", "frp_lag_12h", "frp_lag_24h",
    "frp_rolling_6h_mean", "frp_rolling_6h_std",
    "frp_trend_6h",
    "cumulative_frp",
    "hours_since_first_fire",
    "is_fire",
    "sat_fraction",
)

COVARIATES = (
    "u10", "v10", "t2m_K", "d2m_K", "blh_m",
    "u850", "v850",
    "wind_speed_10m", "wind_dir_10m", "wind_speed_850",
    "vpd_kPa", "precip_1h_mm", "precip_24h_mm", "delta_wind_3h",
)

WIND_FEATURES = (
    "shear_signed", "wind_var_12h", "ws850_max_12h", "hdw_product", "wind_frp_coupling",
)

AR_RIDGE_FEATURES = tuple(f"frp_lag_{k}h" for k in LAGS)

WEATHER_RIDGE_FEATURES = (
    "u10", "v10", "t2m_K", "d2m_K", "blh_m",
    "wind_speed_10m", "vpd_kPa", "precip_24h_mm", "delta_wind_3h",
)

RIDGE_ALPHAS = (0.1, 1.0, 10.0, 100.0)
RIDGE_FOLDS = 5

REPORT_LEADS = (1, 3, 6, 12)
HORIZON_WEIGHTS = {1: 0.10, 3: 0.20, 6: 0.50, 12: 0.20}
CONFORMAL_LEVELS = (0.50, 0.80, 0.90)
GATE_LIMITS = {"gap_rate": 0.40, "sat_rate": 0.30, "complete_days": 3}
TARGET_PERCENTILES = (10, 25, 50, 75, 90, 95, 99)
# ---------------------------------------------------------------------------

FEATURES = CALENDAR_FEATURES + HISTORY_FEATURES + COVARIATES

# Bounded features: never z-scored.
UNSCALED = CALENDAR_FEATURES + ("is_fire", "sat_fraction")
SCALED = tuple(f for f in FEATURES if f not in UNSCALED)

SPLITS = ("train", "val", "test")

OBSERVATION_SCHEMA = T.StructType([
    T.StructField("slot_utc", T.TimestampNTZType()),
    T.StructField("slot_type", T.StringType()),
    T.StructField("frp_sum_mw", T.DoubleType()),
    T.StructField("sat_fraction", T.DoubleType()),
    T.StructField("n_pixels", T.LongType()),
])

COVARIATE_SCHEMA = T.StructType(
    [T.StructField("slot_utc", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in COVARIATES]
)

CATALOGUE_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("intensity_tier", T.StringType()),
    T.StructField("wind_regime", T.StringType()),
    T.StructField("country", T.StringType()),
])

NORM_SCHEMA = "feature string, mean double, std double"


def require(df, *columns):
    """Raise if a column is absent: a missing input is an error, not a warning."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df
