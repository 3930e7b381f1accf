"""Training-only normalisation and window-weighted statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.columns import floor0, zscore
from panelcast.operators.features import add_features, add_windows, open_panel
from panelcast.operators.layout import Layout
from panelcast.schema import FEATURES, LOOKBACK, SCALED, WIND_FEATURES

Params = dict[str, tuple[float, float]]


def unpivot(df: DataFrame, by: list[str], features, stats: list[str], label: str = "feature") -> DataFrame:
    """One-row-per-group statistics named ``<feature>__<stat>`` to one row per feature."""
    rows = ", ".join(
        f"named_struct('{label}', '{f}', " + ", ".join(f"'{s}', `{f}__{s}`" for s in stats) + ")" for f in features)
    return df.select(*by, F.expr(f"inline(array({rows}))"))


def norm_table(rows: DataFrame, features=SCALED, split: str = "train") -> DataFrame:
    """(feature, mean, std) over training rows, ddof 0, nulls skipped, in one aggregation."""
    train = rows.filter(F.col("split") == split)
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std")]
    return unpivot(train.agg(*aggs), [], features, ["mean", "std"])


def norm_params(table: DataFrame) -> Params:
    """The parameters on the driver (one pair per feature); zero-deviation features are left out."""
    return {r.feature: (r.mean, r.std) for r in table.collect() if r.std}


def kept_features(params: Params, features=FEATURES, scaled=SCALED) -> list[str]:
    return [f for f in features if f not in scaled or f in params]


def apply_norm(df: DataFrame, params: Params) -> DataFrame:
    return df.withColumns({f: zscore(F.col(f), m, s) for f, (m, s) in params.items() if f in df.columns})


def weighted_moments(df: DataFrame, by: list[str], value: Column, weight: Column):
    """Mean and deviation (ddof 0) of weighted rows; null without any weight."""
    n, s, q = F.sum(weight), F.sum(weight * value), F.sum(weight * value * value)
    mean = F.try_divide(s, n)
    square = F.try_divide(q, n) - mean * mean
    return mean, F.sqrt(F.when(square < 0, 0.0).otherwise(square))


def window_statistics(weighted: DataFrame, by: list[str], features) -> DataFrame:
    """Mean, deviation over all cells of all windows plus min/max over rows, per feature.

    Each row counts once per window that contains it; no window is expanded.
    """
    w = F.col("window_weight")
    aggs = [F.sum(w).alias("n_cells")]
    for f in features:
        mean, std = weighted_moments(weighted, by, F.col(f), w)
        aggs += [mean.alias(f"{f}__mean"), std.alias(f"{f}__std"), F.min(f).alias(f"{f}__lo"), F.max(f).alias(f"{f}__hi")]
    return unpivot(weighted.groupBy(*by).agg(*aggs), by, features, ["mean", "std", "lo", "hi"])


def wind_statistics(panel: DataFrame, layout: Layout | None = None, split: str = "train",
                    rows: int = 12, lookback: int = LOOKBACK, features=FEATURES) -> DataFrame:
    """Statistics of the wind features over every step of every training window.

    Inside a window the trailing frames stop at its first step, so the first
    ``rows - 1`` steps see clipped frames.  Each panel row therefore carries one
    value per distinct frame length with the number of windows that use it.
    """
    pw = open_panel(panel, layout)
    df = add_windows(add_features(pw), pw, features, lookback)
    w, anchor = pw.w, F.col("is_anchor").cast("long")
    entries = []
    for step in range(rows):
        frame = w.rowsBetween(-step, 0)
        df = df.withColumns({
            f"_var{step}": F.stddev_pop("u10").over(frame) + F.stddev_pop("v10").over(frame),
            f"_max{step}": F.max("wind_speed_850").over(frame),
            # The row is step number ``step`` of the window that ends lookback-1-step rows later;
            # the longest frame serves all later steps.
            f"_n{step}": F.coalesce(
                F.lead(anchor, lookback - 1 - step).over(w) if step < rows - 1
                else F.sum(anchor).over(w.rowsBetween(0, lookback - rows)), F.lit(0)),
        })
        entries.append(F.struct(F.col(f"_n{step}").cast("double").alias("n"), F.col(f"_var{step}").alias("wind_var_12h"),
                                F.col(f"_max{step}").alias("ws850_max_12h")))
    df = pw.close(df).filter(F.col("split") == split).select(
        (F.col("wind_speed_850") - F.col("wind_speed_10m")).alias("shear_signed"),
        (F.col("vpd_kPa") * F.col("wind_speed_10m")).alias("hdw_product"),
        (F.col("wind_speed_850") * floor0(F.col("frp_lag_1h"))).alias("wind_frp_coupling"),
        F.explode(F.array(*entries)).alias("_e"),
    ).select("shear_signed", "hdw_product", "wind_frp_coupling", "_e.*").filter("n > 0")
    aggs = []
    for f in WIND_FEATURES:
        mean, std = weighted_moments(df, [], F.col(f), F.col("n"))
        aggs += [mean.alias(f"{f}__mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias(f"{f}__std")]
    return unpivot(df.agg(*aggs), [], WIND_FEATURES, ["mean", "std"])
