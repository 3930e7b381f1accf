"""Scalar column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(slot_type: str = "slot_type") -> Column:
    """True for slots that are not gaps."""
    return F.col(slot_type) != "missing"


def filled_saturation(c: str = "sat_fraction") -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def calendar(ts: str = "slot_utc") -> dict[str, Column]:
    """Cyclic hour (with minutes) and day-of-year codes; the year is always 365 days."""
    t = F.col(ts)
    hour = (F.hour(t) + F.minute(t) / F.lit(60.0)) * F.lit(2 * pi / 24.0)
    day = F.dayofyear(t) * F.lit(2 * pi / 365.0)
    return {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "doy_sin": F.sin(day), "doy_cos": F.cos(day)}


def fire_flag(slot_type: str = "slot_type") -> Column:
    return (F.col(slot_type) == "fire").cast("double")


def zscore(c: Column, mean: float, std: float) -> Column:
    return (c - F.lit(float(mean))) / F.lit(float(std))


def unscale(c: Column, mean: float, std: float) -> Column:
    return c * F.lit(float(std)) + F.lit(float(mean))


def floor0(c: Column) -> Column:
    """Non-negative part; null stays null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def any_positive(targets: str = "targets") -> Column:
    return F.exists(F.col(targets), lambda x: x > 0)


def residual_forecast(prior: Column, residual: Column, scale: Column, max_scale: float = 0.5) -> Column:
    """Log-space residual on top of a prior, scale clamped to [0, max_scale]."""
    clamped = F.least(F.greatest(scale, F.lit(0.0)), F.lit(float(max_scale)))
    return floor0(F.expm1(F.log1p(floor0(prior)) + clamped * residual))


def verdict(value: Column, limit: float, at_least: bool = False) -> Column:
    ok = (value >= F.lit(limit)) if at_least else (value <= F.lit(limit))
    return F.when(value.isNull() | F.isnan(value.cast("double")), "N/A").when(ok, "PASS").otherwise("FAIL")


def hours_later(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"), F.lit(0), F.lit(0))


def display_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def without_year(name: Column) -> Column:
    return F.regexp_replace(name, r"_\d{4}$", "")


def log_hybrid(pred: Column, y: Column, fire: Column, alpha: float = 0.5, fire_weight: float = 7.0) -> Column:
    """Blend of absolute and squared log error, heavier on fire-active windows."""
    d = F.log1p(pred) - F.log1p(y)
    blend = F.lit(alpha) * F.abs(d) + F.lit(1.0 - alpha) * d * d
    return blend * F.when(fire, F.lit(float(fire_weight))).otherwise(F.lit(1.0))
