"""Forecast metrics.  All are sums and counts per key, so they combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.columns import log_hybrid
from panelcast.schema import HORIZON, HORIZON_WEIGHTS

def _fire() -> Column:
    return F.col("fire_active")


def mae(pred: str, y: str = "y", where: Column | None = None) -> Column:
    e = F.abs(F.col(pred) - F.col(y))
    return F.avg(F.when(where, e) if where is not None else e)


def skill(model: Column, reference: Column) -> Column:
    """1 - model / reference; null when the reference error is 0 or nothing burned."""
    return F.lit(1.0) - model / F.nullif(reference, F.lit(0.0))


def event_skill(rows: DataFrame, by=("series_id",), pred: str = "pred", reference: str = "persistence",
                expected: DataFrame | None = None) -> DataFrame:
    """Per-series skill on fire-active windows; ``expected`` keeps listed series without rows."""
    out = rows.groupBy(*by).agg(
        F.count_if(_fire()).alias("n_fire"),
        mae(pred, where=_fire()).alias("mae_model"),
        mae(reference, where=_fire()).alias("mae_pers"),
    )
    if expected is not None:
        out = expected.select(*by).join(out, list(by), "left").withColumn(
            "n_fire", F.coalesce("n_fire", F.lit(0)))
    return out.withColumn("ss", skill(F.col("mae_model"), F.col("mae_pers")))


def cross_event(per_event: DataFrame, by=(), value: str = "ss", exclude=(), single_std: float | None = 0.0) -> DataFrame:
    """Mean, deviation (ddof 1) and count over series; nulls leave the mean.

    ``single_std`` is the deviation reported for one value (0.0 or null).
    """
    rows = per_event.filter(~F.col("series_id").isin(list(exclude))) if exclude else per_event
    n, std = F.count(value), F.stddev_samp(value)
    single = F.lit(single_std).cast("double")
    return rows.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.when(n > 1, std).when(n == 1, single).alias("std"),
        n.alias("n_events"),
    )


def persistence_mae(rows: DataFrame, pred: str = "prior") -> DataFrame:
    """Mean absolute error of persistence per (series, lead) on fire-active windows."""
    return rows.filter(_fire()).groupBy("series_id", "lead").agg(mae(pred).alias("mae_pers"))


def lead_metrics(rows: DataFrame, by=("series_id", "lead"), pred: str = "pred") -> DataFrame:
    sq = (F.col(pred) - F.col("y")) * (F.col(pred) - F.col("y"))
    return rows.groupBy(*by).agg(
        mae(pred).alias("mae_all"),
        mae(pred, where=_fire()).alias("mae_fire"),
        F.sqrt(F.avg(sq)).alias("rmse"),
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(_fire()).alias("n_fire"),
    )


def cross_event_by_lead(metrics: DataFrame, by=("lead",)) -> DataFrame:
    return metrics.groupBy(*by).agg(
        F.avg("mae_all").alias("mae_all_mean"), F.stddev_samp("mae_all").alias("mae_all_std"),
        F.avg("mae_fire").alias("mae_fire_mean"), F.stddev_samp("mae_fire").alias("mae_fire_std"),
    )


def skill_curve(metrics: DataFrame, reference: str = "persistence") -> DataFrame:
    """Ratio of means per lead: 1 - mean(MAE) / mean(MAE of the reference baseline).

    Reads per-(baseline, series, lead) metrics once; the reference row travels in
    the same aggregation as an array by baseline.
    """
    means = metrics.groupBy("lead", "baseline").agg(F.avg("mae_fire").alias("m"))
    ref = means.filter(F.col("baseline") == reference).select("lead", F.col("m").alias("ref"))
    return means.filter(F.col("baseline") != reference).join(ref, "lead").select(
        "baseline", "lead", skill(F.col("m"), F.col("ref")).alias("ss"))


def baseline_skill(metrics: DataFrame, lead: int = 6, exclude=(), reference: str = "persistence") -> DataFrame:
    """Mean, deviation and mean-without-excluded skill per baseline; the reference scores 0."""
    at = metrics.filter(F.col("lead") == lead)
    ref = at.filter(F.col("baseline") == reference).select("series_id", F.col("mae_fire").alias("ref"))
    per = at.join(ref, "series_id").withColumn("ss", skill(F.col("mae_fire"), F.col("ref")))
    keep = ~F.col("series_id").isin(list(exclude)) if exclude else F.lit(True)
    is_ref = F.col("baseline") == reference
    zero = lambda c: F.when(is_ref, F.lit(0.0)).otherwise(c)
    return per.groupBy("baseline").agg(
        F.avg("ss").alias("m"), F.stddev_samp("ss").alias("s"), F.avg(F.when(keep, F.col("ss"))).alias("x"),
    ).select("baseline", zero(F.col("m")).alias("ss_mean"), zero(F.col("s")).alias("ss_std"),
             zero(F.col("x")).alias("ss_excl"))


def horizon_weights(horizon: int = HORIZON, weights=HORIZON_WEIGHTS) -> dict[int, float]:
    kept = {k: v for k, v in weights.items() if 1 <= k <= horizon}
    total = sum(kept.values())
    return {k: v / total for k, v in kept.items()} if total > 0 else kept


def weight_of(lead: Column, weights: dict[int, float]) -> Column:
    out = F.lit(0.0)
    for k, v in weights.items():
        out = F.when(lead == k, F.lit(v)).otherwise(out)
    return out


def skill_aligned_score(rows: DataFrame, table: DataFrame, by=(), pred: str = "pred",
                        horizon: int = HORIZON, weights=HORIZON_WEIGHTS) -> DataFrame:
    """Mean over series of the horizon-weighted error relative to the persistence table.

    Series without a table entry are skipped; 0 when no fire-active series is left.
    """
    per_lead = rows.filter(_fire()).groupBy(*by, "series_id", "lead").agg(mae(pred).alias("m"))
    ratio = F.col("m") / (F.col("mae_pers") + F.lit(1e-6))
    per_event = (
        per_lead.join(table, ["series_id", "lead"])
        .groupBy(*by, "series_id")
        .agg(F.sum(ratio * weight_of(F.col("lead"), horizon_weights(horizon, weights))).alias("term"))
    )
    return per_event.groupBy(*by).agg(
        F.coalesce(F.avg("term"), F.lit(0.0)).alias("skill_term"), F.count("term").alias("n_events"))


def log_score(rows: DataFrame, by=(), pred: str = "pred", alpha: float = 0.5, fire_weight: float = 7.0) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.avg(log_hybrid(F.col(pred), F.col("y"), _fire(), alpha, fire_weight)).alias("log_anchor"))


def total_score(rows: DataFrame, table: DataFrame, by: tuple, w_skill: float = 1.0, w_log: float = 0.2,
                pred: str = "pred") -> DataFrame:
    a = skill_aligned_score(rows, table, by, pred)
    b = log_score(rows, by, pred)
    return b.join(a, list(by), "left").select(
        *by, F.coalesce("skill_term", F.lit(0.0)).alias("skill_term"), "log_anchor",
        (w_skill * F.coalesce("skill_term", F.lit(0.0)) + w_log * F.col("log_anchor")).alias("loss"),
        F.coalesce("n_events", F.lit(0)).alias("n_events"))


def trajectories(rows: DataFrame, by=("series_id", "lead"), **columns: str) -> DataFrame:
    """Mean trajectory per key of every named column over fire-active windows."""
    return rows.filter(_fire()).groupBy(*by).agg(*[F.avg(c).alias(n) for n, c in columns.items()],
                                                F.count(F.lit(1)).alias("n_fire"))


def with_mean_rows(per_event: DataFrame, by: list[str], values: list[str], count: str = "n_fire",
                   label: str = "event", name: str = "MEAN") -> DataFrame:
    """Per-event rows plus one row per group: mean of event values, summed count.

    This is a mean of event results, not of samples, so it is not a rollup.
    """
    means = per_event.groupBy(*by).agg(F.sum(count).alias(count), *[F.avg(v).alias(v) for v in values])
    cols = [*by, label, count, *values]
    return per_event.select(*cols).unionByName(means.withColumn(label, F.lit(name)).select(*cols))
