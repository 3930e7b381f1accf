"""The model-ready dataset: scaling fitted on training rows, and windows of z-scored inputs with the wind channels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.columns import zscore
from panelcast.operators.features import WIND_ROWS, add_features, add_windows, feature_rows, open_panel
from panelcast.operators.layout import Layout
from panelcast.plans import normalise as N
from panelcast.schema import LOOKBACK, WIND_FEATURES
from panelcast.session import cut

CLIPPED = ("wind_var_12h", "ws850_max_12h")  # their frames stop at the first step of a window


@dataclass(frozen=True)
class Scaling:
    """What a dataset was scaled by: one pair per scaled channel. ``features`` are the kept ones, in their order; what had no
    deviation in training is in neither."""

    features: tuple[str, ...]
    params: dict[str, tuple[float, float]]
    wind: dict[str, tuple[float, float]]

    @property
    def channels(self) -> tuple[str, ...]:
        return self.features + tuple(self.wind)

    def scaled(self, name: str, c: Column | None = None) -> Column:
        c = F.col(name) if c is None else c
        at = self.params.get(name) or self.wind.get(name)
        return zscore(c, *at) if at else c

    def raw(self, name: str, c: Column) -> Column:
        at = self.params.get(name) or self.wind.get(name)
        return c * F.lit(float(at[1])) + F.lit(float(at[0])) if at else c


def fit(panel: DataFrame, layout: Layout | None = None, wind: bool = True, lookback: int = LOOKBACK) -> Scaling:
    """Scaling from training rows (and, for wind channels, from all steps of all training windows)."""
    params = N.norm_params(N.norm_table(feature_rows(panel, layout)))
    kept = tuple(N.kept_features(params))
    table = N.wind_statistics(panel, layout, lookback=lookback, features=kept).collect() if wind else []
    stats = {r.feature: (r.mean, r.std) for r in table if r.mean is not None}
    return Scaling(kept, params, {f: stats[f] for f in WIND_FEATURES if f in stats})


WINDOW_ROWS = 512  # windows cut out at once: what a task holds beside the rows of a series (or block)


def _deviation(x: np.ndarray) -> np.ndarray:
    """Deviation (ddof 0) of each line over its known values; NaN without any."""
    known = ~np.isnan(x)
    n = known.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(known, x, 0.0).sum(axis=1) / n
        return np.sqrt((np.where(known, x - mean[:, None], 0.0) ** 2).sum(axis=1) / n)


def _cut_windows(scaling: Scaling, keep: list[str], lookback: int):
    """Over the rows of one series (or block): the windows that end at its marked rows, some at a time.

    The first steps of a window see trailing wind frames that stop at its first row; these few steps are worked out for each
    window, every other channel of a step is that of its row.
    """
    early = min(WIND_ROWS - 1, lookback)
    wind = scaling.wind

    def clipped(raw: dict, at) -> dict:
        """Per clipped channel its first steps, window by window; a row without the value counts for nothing."""
        first = at[:, :early]
        u, v, speed = (raw[c][first] for c in ("u10", "v10", "wind_speed_850"))
        spread, most = np.full(first.shape, np.nan), np.full(first.shape, np.nan)
        for s in range(first.shape[1]):
            spread[:, s] = _deviation(u[:, :s + 1]) + _deviation(v[:, :s + 1])
        np.fmax.accumulate(speed, axis=1, out=most)
        return {CLIPPED[0]: spread, CLIPPED[1]: most}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("row_no").combine_chunks()
        ends = np.flatnonzero(t.column("_mine").to_numpy(zero_copy_only=False))
        columns = [t.column(f"_x{i}").combine_chunks() for i in range(len(scaling.channels))]
        raw = {c: t.column(f"_raw_{c}").to_numpy() for c in ("u10", "v10", "wind_speed_850")} if wind else {}
        for lo in range(0, len(ends), WINDOW_ROWS):
            some = ends[lo:lo + WINDOW_ROWS]
            at = some[:, None] + np.arange(1 - lookback, 1)
            own = clipped(raw, at) if wind else {}
            steps = []
            for name, column in zip(scaling.channels, columns):
                if name not in own and not column.null_count:  # whole stretches are copied
                    steps.append(pa.array(sliding_window_view(column.to_numpy(), lookback)[at[:, 0]].ravel()))
                    continue
                x = column.take(pa.array(at.ravel()))
                if name in own:
                    values, lost = (a.to_numpy(zero_copy_only=False).reshape(at.shape).copy() for a in (x, x.is_null()))
                    mean, std = wind[name]
                    values[:, :early], lost[:, :early] = (own[name] - mean) / std, np.isnan(own[name])
                    x = pa.array(values.ravel(), mask=lost.ravel())
                steps.append(x)
            inputs = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * lookback),
                                              pa.StructArray.from_arrays(steps, names=list(scaling.channels)))
            kept = [t.column(c).combine_chunks().take(pa.array(some)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, inputs], names=[*keep, "inputs"])
    return run


WINDOW_COLUMNS = ("split", "slot_utc", "row_no", "input_start_utc", "target_end_utc", "target_mean_frp", "target_max_frp", "fire_active", "targets")


def scaled_windows(panel: DataFrame, scaling: Scaling, layout: Layout | None = None, lookback: int = LOOKBACK) -> DataFrame:
    """Windows with ``inputs``: one struct of all channels per step, z-scored; series by series, in order of time."""
    return map_windows(panel, scaling, None, None, layout, lookback)


def map_windows(panel: DataFrame, scaling: Scaling, run: Callable | None, fields: T.StructType | None, layout: Layout | None = None,
                lookback: int = LOOKBACK, keep=WINDOW_COLUMNS) -> DataFrame:
    """``run`` over the windows of ``scaled_windows`` (Arrow batches of ``keep`` and ``inputs`` in, batches of ``fields`` out; the
    windows themselves without ``run``) in the task that cuts them out: only results leave it.

    Rows are scaled once. Those of a series are already together (and bounded by the layout), so its windows are cut out inside
    the task by array arithmetic, without an exchange, and nothing wide is ever ordered.
    """
    pw = open_panel(panel, layout)
    df = add_windows(add_features(pw, wind=bool(scaling.wind)), pw, scaling.features, lookback)
    blocked = pw.layout.blocked
    mine = F.col("is_anchor") & (F.col("_block") == F.col("_home")) if blocked else F.col("is_anchor")
    keep = [*pw.layout.keys, *keep]
    by = [*pw.layout.keys, *(["_block"] if blocked else [])]
    raw = [F.col(c).cast("double").alias(f"_raw_{c}") for c in ("u10", "v10", "wind_speed_850")] if scaling.wind else []
    channels = [scaling.scaled(f).cast("double").alias(f"_x{i}") for i, f in enumerate(scaling.channels)]
    rows = df.select(*dict.fromkeys([*keep, *by, "row_no"]), F.coalesce(mine, F.lit(False)).alias("_mine"), *raw, *channels)
    step = T.StructType([T.StructField(f, T.DoubleType()) for f in scaling.channels])
    windows = T.StructType([*[rows.schema[c] for c in keep], T.StructField("inputs", T.ArrayType(step))])
    cut_out = _cut_windows(scaling, keep, lookback)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(cut_out(batches)) if run else cut_out(batches)

    return rows.groupBy(*by).applyInArrow(whole, fields or windows)


def scaled_rows(panel: DataFrame, scaling: Scaling, layout: Layout | None = None, lookback: int = LOOKBACK) -> DataFrame:
    """Panel rows with z-scored kept features, window columns and ``window_weight``: every statistic over all cells of all
    windows is a weighted statistic of these rows."""
    pw = open_panel(panel, layout)
    df = add_windows(add_features(pw), pw, scaling.features, lookback)
    weight = F.sum(F.col("is_anchor").cast("long")).over(pw.w.rowsBetween(0, lookback - 1))
    df = pw.close(df.withColumn("window_weight", weight))
    return df.withColumns({f"raw_{f}": F.col(f) for f in scaling.features if f in scaling.params}).withColumns(
        {f: scaling.scaled(f) for f in scaling.params})


def feature_statistics(rows: DataFrame, scaling: Scaling, split: str = "train") -> DataFrame:
    """Mean and deviation over all cells of all windows of a split, and the range over its rows, of the scaled features."""
    return N.window_statistics(rows.filter(F.col("split") == split), [], scaling.features)


def cells_of(windows: DataFrame, channels) -> DataFrame:
    """Per window: how many cells are null or NaN, and how many steps and channels there are."""
    bad = F.aggregate("inputs", F.lit(0), lambda n, x: n + sum(
        (F.when(x[c].isNull() | F.isnan(x[c]), 1).otherwise(0) for c in channels), F.lit(0)))
    return windows.select(bad.cast("long").alias("bad"), F.size("inputs").alias("steps"))


def stored(panel: DataFrame, layout: Layout | None = None, scaling: Scaling | None = None) -> tuple[DataFrame, Scaling]:
    """Scaled windows, written once, with their scaling."""
    scaling = scaling or fit(panel, layout)
    return cut(scaled_windows(panel, scaling, layout)), scaling

