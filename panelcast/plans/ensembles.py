"""Combining the forecasts of several seeds of one model.

Groups here are one window's seeds, so their size is the number of seeds. Forecasts come long, with a row per seed, or
side by side: a row per forecast with the seeds' values in an array ``preds``. The latter needs no grouping at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.columns import floor0
from panelcast.plans.evaluation import cross_event, event_skill, with_mean_rows

KEYS = ("series_id", "slot_utc", "lead")
CARRIED = ("split", "y", "persistence", "fire_active")


def _carried(df: DataFrame, keys) -> list:
    return [F.any_value(c).alias(c) for c in CARRIED if c in df.columns and c not in keys]


def _back(c):
    return floor0(F.expm1(c))


def _side_by_side(df: DataFrame, keys, combined) -> DataFrame:
    """``combined`` maps the known log values of a row to one log value."""
    logs = F.filter(F.transform("preds", lambda p: F.log1p(floor0(p))), lambda x: x.isNotNull())
    kept = [c for c in CARRIED if c in df.columns and c not in keys]
    return df.select(*keys, *kept, logs.alias("_logs")).select(*keys, *kept, combined(F.col("_logs")).alias("pred"))


def _sum(logs):
    return F.aggregate(logs, F.lit(0.0), lambda a, x: a + x)


def log_mean(preds: DataFrame, keys=KEYS) -> DataFrame:
    if "preds" in preds.columns:
        return _side_by_side(preds, keys, lambda x: F.when(F.size(x) > 0, _back(_sum(x) / F.size(x))))
    log = F.log1p(floor0(F.col("pred")))
    return preds.groupBy(*keys).agg(*_carried(preds, keys), _back(F.avg(log)).alias("pred"))


def trimmed_log_mean(preds: DataFrame, keys=KEYS) -> DataFrame:
    """Log mean without one smallest and one largest seed; null when no seed is left."""
    if "preds" in preds.columns:
        return _side_by_side(preds, keys, lambda x: F.when(F.size(x) > 2, _back(
            (_sum(x) - F.array_min(x) - F.array_max(x)) / (F.size(x) - 2))))
    log = F.log1p(floor0(F.col("pred")))
    inner = F.try_divide(F.sum(log) - F.min(log) - F.max(log), F.count(log) - 2)
    return preds.groupBy(*keys).agg(*_carried(preds, keys), F.when(F.count(log) > 2, _back(inner)).alias("pred"))


def log_median(preds: DataFrame, keys=KEYS) -> DataFrame:
    if "preds" in preds.columns:
        at = lambda x, i: F.get(F.sort_array(x), F.floor(i).cast("int"))
        return _side_by_side(preds, keys, lambda x: F.when(F.size(x) > 0, _back(
            (at(x, (F.size(x) - 1) / 2) + at(x, F.size(x) / 2)) / 2)))
    log = F.log1p(floor0(F.col("pred")))
    return preds.groupBy(*keys).agg(*_carried(preds, keys), _back(F.median(log)).alias("pred"))


def band(preds: DataFrame, keys=KEYS, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Inter-seed quantile band per window."""
    q = F.percentile("pred", F.array(F.lit(low), F.lit(high)))
    out = preds.groupBy(*keys).agg(*_carried(preds, keys), q.alias("_q"))
    return out.withColumns({"lo": F.col("_q")[0], "hi": F.col("_q")[1]}).drop("_q")


def inside():
    return F.col("y").between(F.col("lo"), F.col("hi")).cast("double")


def pooled_coverage(bands: DataFrame, by=()) -> DataFrame:
    """Share of fire-active windows inside the band, both ends included."""
    return bands.filter("fire_active").groupBy(*by).agg(
        F.avg(inside()).alias("coverage"), F.count(F.lit(1)).alias("n_fire"))


def event_coverage(bands: DataFrame, splits=None) -> DataFrame:
    """Coverage and widths per series on fire-active windows (see ``conformal.interval_report``)."""
    from panelcast.plans.conformal import interval_report

    return interval_report(bands.filter("fire_active"), ["series_id"], splits)


def event_coverage_with_mean(bands: DataFrame) -> DataFrame:
    per = event_coverage(bands).withColumn("event", F.col("series_id").cast("string"))
    return with_mean_rows(per, [], ["coverage", "width_mean", "width_median", "width_mean_frac", "width_median_frac"])


def seed_summary(preds: DataFrame) -> DataFrame:
    """Per seed the event-mean skill, then mean and deviation (ddof 1) over seeds."""
    per_seed = cross_event(event_skill(preds, ("seed", "series_id")), by=("seed",))
    return per_seed.agg(F.avg("mean").alias("cross_seed_mean"), F.stddev_samp("mean").alias("cross_seed_std"),
                        F.count("mean").alias("n_seeds"))


def require_seeds(preds: DataFrame, seeds) -> DataFrame:
    """Predictions, or an error when an expected seed has no rows."""
    wanted = preds.sparkSession.createDataFrame([(int(s),) for s in seeds], "seed int")
    lost = [r.seed for r in missing_seeds(preds, wanted).collect()]
    if lost:
        raise FileNotFoundError(f"no predictions for seeds {sorted(lost)}")
    return preds


def missing_seeds(preds: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(preds.select("seed").distinct(), "seed", "left_anti")
