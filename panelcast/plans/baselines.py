"""Reference forecasters as column expressions on window rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.columns import floor0, hours_later

BASELINES = ("persistence", "diurnal_persistence", "diurnal_climatology", "linear_trend")


def prior() -> Column:
    """Persistence used in skill scores: the value one row before the anchor, for every lead."""
    return floor0(F.col("frp_lag_1h"))


def gated_prior() -> Column:
    """Persistence of the baseline comparison: the prior where the anchor burns, else 0."""
    return F.when(F.col("is_fire") > 0, prior()).otherwise(F.lit(0.0))


def diurnal() -> Column:
    return floor0(F.col("frp_lag_24h"))


def trend(lead: Column) -> Column:
    """Line through lags 6, 3, 2, 1 at x = -5, -2, -1, 0 (clipped), continued from lag 1 (not clipped)."""
    slope = (floor0(F.col("frp_lag_2h")) + 2 * floor0(F.col("frp_lag_1h")) - 3 * floor0(F.col("frp_lag_6h"))) / 14
    return F.greatest(F.col("frp_lag_1h") + slope * lead, F.lit(0.0))


def with_target_hour(rows: DataFrame, horizon: int = 12) -> DataFrame:
    """Wall-clock hour of the forecast slot, counted from the window end (not the row's own hour)."""
    t_last = F.col("target_end_utc") - F.expr(f"INTERVAL {horizon} HOURS")
    return rows.withColumn("target_hour", F.hour(hours_later(t_last, F.col("lead"))))


def hourly_climatology(train: DataFrame) -> DataFrame:
    """Mean training value by hour of day over fire-active windows: always 24 rows.

    Hours without data get the overall mean (0 when nothing burned).
    """
    spark = train.sparkSession
    seen = train.filter("fire_active").groupBy("target_hour").agg(
        F.sum("y").alias("_s"), F.count("y").alias("_n"))
    clock = spark.range(24).select(F.col("id").cast("int").alias("target_hour"))
    all_hours = Window.partitionBy()  # 24 rows
    overall = F.coalesce(F.sum("_s").over(all_hours) / F.sum("_n").over(all_hours), F.lit(0.0))
    return clock.join(F.broadcast(seen), "target_hour", "left").select(
        "target_hour", F.coalesce(F.col("_s") / F.col("_n"), overall).alias("diurnal_climatology"))


def climatology(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Attach the climatology forecast; the lookup table has 24 rows whatever the data size."""
    return rows.join(F.broadcast(hourly_climatology(train)), "target_hour", "left")


def forecast_rows(windows: DataFrame, train_split: str = "train") -> DataFrame:
    """Long rows with one column per closed-form baseline."""
    from panelcast.operators.features import long_form

    keep = ["series_id", "split", "slot_utc", "row_no", "fire_active", "is_fire", "target_end_utc",
            "frp_lag_1h", "frp_lag_2h", "frp_lag_3h", "frp_lag_6h", "frp_lag_24h"]
    rows = with_target_hour(long_form(windows, *keep))
    rows = climatology(rows, rows.filter(F.col("split") == train_split))
    return rows.select(
        "series_id", "split", "slot_utc", "row_no", "fire_active", "lead", "y", "target_hour",
        gated_prior().alias("persistence"),
        diurnal().alias("diurnal_persistence"),
        "diurnal_climatology",
        trend(F.col("lead")).alias("linear_trend"),
        prior().alias("prior"),
    )


def by_baseline(rows: DataFrame, names=BASELINES, keep=("series_id", "split", "slot_utc", "fire_active", "lead", "y")) -> DataFrame:
    """One row per (forecast row, baseline)."""
    return rows.unpivot([*keep], list(names), "baseline", "pred")
