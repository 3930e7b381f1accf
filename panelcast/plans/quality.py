"""Audit metrics and gate verdicts per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.columns import verdict
from panelcast.schema import GATE_LIMITS


def half_even(c: Column, digits: int) -> Column:
    """Ties go to the even digit: 0.03125 gives 0.0312."""
    return F.bround(c.cast("double"), digits)


def daily_counts(obs: DataFrame) -> DataFrame:
    """Per series and day: slot counts and the sums the audit needs."""
    fire = F.col("slot_type") == "fire"
    return obs.groupBy("series_id", F.col("slot_utc").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("slot_type") == "missing").alias("n_missing"),
        F.count_if(fire).alias("n_fire"),
        F.count(F.when(fire, F.col("sat_fraction"))).alias("n_sat_known"),
        F.count_if(fire & (F.col("sat_fraction") > 0.3)).alias("n_saturated"),
        F.max(F.when(fire, F.col("frp_sum_mw"))).alias("peak"),
    )


def complete_days(obs: DataFrame) -> DataFrame:
    """A day is complete when less than half of its slots are missing."""
    return daily_counts(obs).select("series_id", "day", (F.col("n_missing") / F.col("n") < 0.5).alias("complete"))


def audit(obs: DataFrame) -> DataFrame:
    """Metrics per series from one pass: days first, then series.  Rounded before any verdict."""
    per = daily_counts(obs).groupBy("series_id").agg(
        F.sum("n").alias("total_slots"),
        F.sum("n_missing").alias("n_missing"),
        F.sum("n_fire").alias("n_fire_slots"),
        F.sum("n_sat_known").alias("_known"),
        F.sum("n_saturated").alias("_sat"),
        F.count_if(F.col("n_missing") / F.col("n") < 0.5).alias("complete_days"),
        F.coalesce(F.max("peak"), F.lit(0.0)).alias("_peak"),
        F.count(F.lit(1)).alias("n_days"),
    )
    return per.select(
        "series_id",
        half_even(F.col("n_missing") / F.col("total_slots"), 4).alias("gap_rate"),
        half_even(F.col("_sat") / F.nullif(F.col("_known"), F.lit(0)), 4).alias("sat_rate"),
        "complete_days", half_even(F.col("_peak"), 1).alias("peak_frp_mw"),
        "total_slots", "n_fire_slots", "n_missing", "n_days")


def gate(metrics: DataFrame, limits: dict | None = None, min_fire_slots: int | None = None,
         min_days: int | None = None) -> DataFrame:
    """PASS/FAIL/N/A per criterion; OK only when every one passes.

    The fire-slot and duration criteria are documented extras, off by default.
    """
    lim = {**GATE_LIMITS, **(limits or {})}
    flags = {
        "gap_flag": verdict(F.col("gap_rate"), lim["gap_rate"]),
        "sat_flag": verdict(F.col("sat_rate"), lim["sat_rate"]),
        "days_flag": verdict(F.col("complete_days"), lim["complete_days"], True),
    }
    if min_fire_slots is not None:
        flags["fire_flag"] = verdict(F.col("n_fire_slots"), min_fire_slots, True)
    if min_days is not None:
        flags["duration_flag"] = verdict(F.col("n_days"), min_days, True)
    out = metrics.withColumns(flags)
    good = F.lit(True)
    for f in flags:
        good = good & (F.col(f) == "PASS")
    return out.withColumn("overall", F.when(good, "OK").otherwise("FLAG"))
