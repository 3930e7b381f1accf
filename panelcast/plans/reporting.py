"""Run selection, tables and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.plans import ensembles as E
from panelcast.plans.evaluation import cross_event, event_skill
from panelcast.schema import REPORT_LEADS


def _known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def best_epoch(history: DataFrame, run: str = "seed", score: str = "val_SS_paper") -> DataFrame:
    """Highest score per run, unknown scores skipped, first epoch on ties."""
    return history.filter(_known(score)).groupBy(run).agg(
        F.max(F.struct(F.col(score).alias("s"), (-F.col("epoch")).alias("e"))).alias("_b")
    ).select(run, (-F.col("_b.e")).alias("best_epoch"), F.col("_b.s").alias(f"best_{score}"))


def stop_epoch(history: DataFrame, run: str = "seed", score: str = "val_SS_paper", patience: int = 5,
               min_epochs: int = 2) -> DataFrame:
    """Epoch at which training would stop: ``patience`` epochs without a new best (one run is a few rows)."""
    w = Window.partitionBy(run).orderBy("epoch")
    s = F.when(_known(score), F.col(score))
    before = F.max(s).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumn("_better", s.isNotNull() & (before.isNull() | (s > before)))
    last = F.max(F.when(F.col("_better"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_wait", F.col("epoch") - F.coalesce(last, F.lit(0)))
    stop = (F.col("epoch") >= min_epochs) & (F.col("_wait") >= patience) & ~F.col("_better")
    return rows.groupBy(run).agg(
        F.coalesce(F.min(F.when(stop, F.col("epoch"))), F.max("epoch")).alias("stopped_at"))


def paper_table(summary: DataFrame, skill: DataFrame, leads=REPORT_LEADS) -> DataFrame:
    """One row per baseline: error mean and deviation at the report leads, and skill."""
    aggs = []
    for k in leads:
        at = F.col("lead") == k
        aggs += [F.max(F.when(at, F.col("mae_fire_mean"))).alias(f"MAE_fire_t{k}_mean"),
                 F.max(F.when(at, F.col("mae_fire_std"))).alias(f"MAE_fire_t{k}_std")]
    return summary.filter(F.col("lead").isin(list(leads))).groupBy("baseline").agg(*aggs).join(skill, "baseline")


def deltas(table: DataFrame, key: str, reference: str, value: str, name: str) -> DataFrame:
    """Difference to one reference row, read as a scalar subquery."""
    ref = table.filter(F.col(key) == reference).agg(F.max(value)).scalar()
    return table.withColumn(name, F.col(value) - ref)


def leaderboard(preds: DataFrame, reference: str, exclude=()) -> DataFrame:
    """Ensemble skill, skill without excluded series, cross-seed mean and deviation, delta per config."""
    per_seed = cross_event(event_skill(preds, ("config", "seed", "series_id")), by=("config", "seed"))
    seeds = per_seed.groupBy("config").agg(F.avg("mean").alias("cross_seed_mean"), F.stddev_samp("mean").alias(
        "cross_seed_std"), F.count("mean").alias("n_seeds"))
    ens = event_skill(E.log_mean(preds, ("config", "series_id", "slot_utc")), ("config", "series_id"))
    keep = ~F.col("series_id").isin(list(exclude)) if exclude else F.lit(True)
    ens = ens.groupBy("config").agg(F.avg("ss").alias("ensemble_val_SS"),
                                    F.avg(F.when(keep, F.col("ss"))).alias("ensemble_val_SS_excl"))
    return deltas(ens.join(seeds, "config"), "config", reference, "ensemble_val_SS", "delta")


def compare_versions(v1: DataFrame, v2: DataFrame, v3: DataFrame, value: str = "ss_mean", key: str = "baseline") -> DataFrame:
    """Result versions side by side by baseline; absent ones are null; delta of the last two."""
    pick = lambda t, n: t.select(key, F.col(value).alias(n))
    out = pick(v1, "v1").join(pick(v2, "v2"), key, "full").join(pick(v3, "v3"), key, "full")
    return out.withColumn("delta", F.col("v3") - F.col("v2"))


def best_baseline(summary: DataFrame, metrics: DataFrame, series, lead: int = 6) -> DataFrame:
    """The baseline with the lowest mean error at one lead, and one series against the mean of the others."""
    best = summary.filter(F.col("lead") == lead).agg(F.min_by("baseline", F.struct("mae_fire_mean", "baseline")).alias("b"))
    rows = metrics.filter(F.col("baseline") == best.scalar())
    one = F.col("series_id") == series
    return rows.groupBy("baseline", "lead").agg(
        F.max(F.when(one, F.col("mae_fire"))).alias("series_mae"),
        F.avg(F.when(~one, F.col("mae_fire"))).alias("others_mae"))


def lags_beat_weather(skill: DataFrame, lags: str = "ar_ridge", weather: str = "weather_ridge") -> DataFrame:
    """Attach whether the lag model outscores the weather-only model (null when one is absent)."""
    at = lambda n: skill.filter(F.col("baseline") == n).agg(F.max("ss_mean")).scalar()
    return skill.withColumn("lags_beat_weather", at(weather) < at(lags))
