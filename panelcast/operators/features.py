"""Series features and forecast windows.

Every frame counts rows after gaps were dropped, never hours.  All columns of
one stage share one window definition, so a build is a single exchange and sort
on the series however many features are asked for; unused ones are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions import columns as C
from panelcast.operators.layout import Layout, PanelWindows
from panelcast.schema import FEATURES, HORIZON, LAGS, LOOKBACK, require

ROWS_BACK = LOOKBACK - 1 + max(LAGS)
ROWS_AHEAD = LOOKBACK - 1 + HORIZON
WIND_ROWS = 12


def open_panel(panel: DataFrame, layout: Layout | None = None) -> PanelWindows:
    """Open a panel with running totals attached, wide enough for every frame below."""
    require(panel, "series_id", "slot_utc", "slot_type", "frp_sum_mw")
    layout = layout or Layout.detect(panel)
    return PanelWindows(
        panel, layout, ROWS_BACK, ROWS_AHEAD,
        sums={"cumulative_frp": F.col("frp_sum_mw")},
        mins={"_first_fire": F.when(F.col("slot_type") == "fire", F.col("slot_utc"))},
    )


def lag_columns(w) -> dict[str, Column]:
    return {f"frp_lag_{k}h": F.lag("frp_sum_mw", k).over(w) for k in LAGS}


def rolling_columns(w) -> dict[str, Column]:
    """Six-row mean, sample deviation (null on one row) and least-squares slope.

    With six equally spaced rows the slope is a fixed combination of the values;
    a missing one makes it null, which is the wanted gate.
    """
    last6 = w.rowsBetween(-5, 0)
    v = F.col("frp_sum_mw")
    back = lambda k: F.lag(v, k).over(w)
    slope = (5.0 * (v - back(5)) + 3.0 * (back(1) - back(4)) + (back(2) - back(3))) / 35.0
    return {
        "frp_rolling_6h_mean": F.avg(v).over(last6),
        "frp_rolling_6h_std": F.stddev_samp(v).over(last6),
        "frp_trend_6h": slope,
    }


def since_first_fire() -> Column:
    """Hours since the first fire so far, 0 before it and in series without fire."""
    return F.coalesce(F.timestamp_diff("SECOND", F.col("_first_fire"), F.col("slot_utc")) / 3600.0, F.lit(0.0))


def wind_columns(w, rows: int = WIND_ROWS) -> dict[str, Column]:
    recent = w.rowsBetween(-(rows - 1), 0)
    return {
        "shear_signed": F.col("wind_speed_850") - F.col("wind_speed_10m"),
        "wind_var_12h": F.stddev_pop("u10").over(recent) + F.stddev_pop("v10").over(recent),
        "ws850_max_12h": F.max("wind_speed_850").over(recent),
        "hdw_product": F.col("vpd_kPa") * F.col("wind_speed_10m"),
        "wind_frp_coupling": F.col("wind_speed_850") * C.floor0(F.col("frp_lag_1h")),
    }


def add_features(pw: PanelWindows, wind: bool = False) -> DataFrame:
    df = pw.df.withColumns({
        **C.calendar(),
        "log_frp": F.log1p("frp_sum_mw"),
        "is_fire": C.fire_flag(),
        **lag_columns(pw.w),
        **rolling_columns(pw.w),
        "hours_since_first_fire": since_first_fire(),
    })
    return df.withColumns(wind_columns(pw.w)) if wind else df


def null_flag(features) -> Column:
    """1 when any feature is null, else 0 (one flat CASE: cheap to plan and to run)."""
    flag = F
    for f in features:
        flag = flag.when(F.col(f).isNull(), 1)
    return flag.otherwise(0)


def add_windows(df: DataFrame, pw: PanelWindows, features=FEATURES,
                lookback: int = LOOKBACK, horizon: int = HORIZON) -> DataFrame:
    """Mark rows at which a complete window ends and attach its targets.

    Input completeness over lookback x features cells is one flag per row and one
    windowed sum; the inputs themselves are not copied into every window.
    """
    w, v = pw.w, F.col("frp_sum_mw")
    ahead = w.rowsBetween(1, horizon)
    df = df.withColumn("_bad", null_flag(features))
    df = df.withColumns({
        "_bad_inputs": F.sum("_bad").over(w.rowsBetween(-(lookback - 1), 0)),
        "_good_targets": F.count(v).over(ahead),
        "input_start_utc": F.lag("slot_utc", lookback - 1).over(w),
        "target_end_utc": F.lead("slot_utc", horizon).over(w),
        "targets": F.array(*[F.lead(v, k).over(w) for k in range(1, horizon + 1)]),
        "target_mean_frp": F.avg(v).over(ahead),
        "target_max_frp": F.max(v).over(ahead),
    })
    ok = (F.col("row_no") >= lookback) & (F.col("_bad_inputs") == 0) & (F.col("_good_targets") == horizon)
    return df.withColumns({
        "is_anchor": ok,
        "fire_active": F.coalesce(F.col("target_max_frp") > 0, F.lit(False)),
    }).drop("_bad", "_bad_inputs", "_good_targets")


def build_rows(panel: DataFrame, layout: Layout | None = None, features=FEATURES, wind: bool = False) -> DataFrame:
    """All panel rows with features and window columns."""
    pw = open_panel(panel, layout)
    return pw.close(add_windows(add_features(pw, wind), pw, features))


def feature_rows(panel: DataFrame, layout: Layout | None = None, wind: bool = False) -> DataFrame:
    pw = open_panel(panel, layout)
    return pw.close(add_features(pw, wind))


def anchors(panel: DataFrame, layout: Layout | None = None, features=FEATURES, wind: bool = False) -> DataFrame:
    """One row per window: the last input row, its features, and 12 targets."""
    return build_rows(panel, layout, features, wind).filter("is_anchor")


def input_windows(panel: DataFrame, layout: Layout | None = None, features=FEATURES,
                  lookback: int = LOOKBACK) -> DataFrame:
    """Windows with their inputs as an array of structs, for models and the sample store.

    This repeats every row up to ``lookback`` times; use it only where a consumer
    needs the whole tensor.
    """
    pw = open_panel(panel, layout)
    df = add_windows(add_features(pw), pw, features)
    step = F.struct(*[F.col(f) for f in features])
    df = df.withColumn("inputs", F.collect_list(step).over(pw.w.rowsBetween(-(lookback - 1), 0)))
    return pw.close(df).filter("is_anchor")


def weighted_rows(panel: DataFrame, layout: Layout | None = None, features=FEATURES,
                  lookback: int = LOOKBACK) -> DataFrame:
    """Feature rows with ``window_weight``: how many windows contain the row.

    Statistics over all cells of all windows are weighted row statistics.
    """
    pw = open_panel(panel, layout)
    df = add_windows(add_features(pw), pw, features)
    weight = F.sum(F.col("is_anchor").cast("long")).over(pw.w.rowsBetween(0, lookback - 1))
    return pw.close(df.withColumn("window_weight", weight))


SUMMARY_ROWS = 1024  # windows summarised at once: their inputs are what a task holds beside a block of rows


def _summaries(features, keep: list[str], lookback: int):
    """Over the rows of one series (or block of it): sliding statistics of all features at the marked rows."""
    import numpy as np
    import pyarrow as pa

    step = np.arange(lookback) - (lookback - 1) / 2.0
    slope_weights = step / (step @ step)  # a complete window is evenly spaced in rows

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("row_no")
        x = np.stack([t.column(f"_x{i}").to_numpy() for i in range(len(features))])
        at = np.flatnonzero(t.column("_mine").to_numpy(zero_copy_only=False))
        stats: dict[str, list] = {"mean": [], "std": [], "last": [], "slope": []}
        for lo in range(0, len(at), SUMMARY_ROWS):
            some = at[lo:lo + SUMMARY_ROWS]
            cells = x[:, some[:, None] + np.arange(1 - lookback, 1)].transpose(1, 0, 2)
            for name, value in (("mean", cells.mean(axis=2)), ("std", cells.std(axis=2)), ("last", cells[:, :, -1]), ("slope", cells @ slope_weights)):
                stats[name].append(value.ravel())
        edges = pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(features))
        flat = lambda v: pa.ListArray.from_arrays(edges, pa.array(np.concatenate(v) if v else np.zeros(0)))
        return pa.table([t.column(c).take(pa.array(at)) for c in keep] + [flat(v) for v in stats.values()], names=[*keep, *stats])
    return run


def window_summary(panel: DataFrame, layout: Layout | None = None, features=FEATURES,
                   lookback: int = LOOKBACK) -> DataFrame:
    """Per window and feature: mean, deviation (ddof 0), last value and slope over the inputs.

    The rows of a series are already together (and bounded by the layout); array arithmetic inside the task gives all
    features of all its windows, without an exchange, and only the results become one row per window and feature. (Sliding
    aggregates of 32 features in one window pass took four times as long, 32 rows per panel row twice.)
    """
    pw = open_panel(panel, layout)
    df = add_windows(add_features(pw), pw, features, lookback)
    blocked = pw.layout.blocked
    mine = F.col("is_anchor") & (F.col("_block") == F.col("_home")) if blocked else F.col("is_anchor")
    keep = [*pw.layout.keys, "split", "slot_utc"]
    rows = df.select(*keep, "row_no", *(["_block"] if blocked else []), mine.alias("_mine"), *[F.col(f).alias(f"_x{i}") for i, f in enumerate(features)])
    schema = T.StructType([*[rows.schema[c] for c in keep], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("mean", "std", "last", "slope")]])
    found = rows.groupBy(*pw.layout.keys, *(["_block"] if blocked else [])).applyInArrow(_summaries(features, keep, lookback), schema)
    names = F.array(*[F.lit(f) for f in features])
    cells = F.arrays_zip(names.alias("feature"), "mean", "std", "last", "slope")
    return found.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.feature", "_c.mean", "_c.std", "_c.last", "_c.slope")


def at_lead(windows: DataFrame, lead: int) -> DataFrame:
    """One lead as plain columns, without exploding the other eleven."""
    return windows.withColumns({"y": F.col("targets")[lead - 1], "lead": F.lit(lead)})


def long_form(windows: DataFrame, *keep: str) -> DataFrame:
    """One row per (window, lead)."""
    keep = keep or ("series_id", "split", "slot_utc", "fire_active")
    return windows.select(*keep, F.posexplode("targets").alias("_i", "y")).withColumn(
        "lead", F.col("_i") + 1).drop("_i")


def gap_runs(obs: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Runs of missing slots with the slot that ends each (the last slot when trailing).

    A run starts where the previous slot is not missing; the running start time
    names the run, and a run's rows are counted in one aggregation.
    """
    layout = layout or Layout.detect(obs)
    gap = F.col("slot_type") == "missing"
    # A flag per row first: starts need one row back, the running maximum carries prefixes.
    pw = PanelWindows(obs.select("series_id", "slot_utc", "slot_type"), layout, 1, 1)
    first = F.coalesce(F.lag("slot_type").over(pw.w) != "missing", F.lit(True))
    flagged = pw.close(pw.df.withColumns({
        "_end": F.coalesce(F.lead("slot_utc").over(pw.w), F.col("slot_utc")),
        "_is_start": gap & first,
    })).drop("row_no")
    run = PanelWindows(flagged, layout, 0, 0, sums={"_run": F.col("_is_start").cast("long")})
    return (
        run.close(run.df).filter(gap)
        .groupBy("series_id", "_run")
        .agg(F.min("slot_utc").alias("gap_start"), F.max("_end").alias("gap_end"),
             F.count(F.lit(1)).alias("n_slots"))
        .drop("_run")
    )
