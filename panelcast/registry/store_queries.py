"""The scaled dataset: 37-channel windows, the sample store with its metadata, and what a constant feature does to them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators import features as feat
from panelcast.plans import dataset as D
from panelcast.plans import scoring as SC
from panelcast.registry.base import query, rc, register_table, sql
from panelcast.registry.util import rd, rounded
from panelcast.schema import FEATURES, HORIZON, LOOKBACK, SCALED, WIND_FEATURES
from panelcast.session import cut, stage_path
from panelcast.sources import adapter as src
from panelcast.sources import readers, writers

CHANNELS = FEATURES + WIND_FEATURES
CONSTANT = "blh_m"  # held at one value in the queries about a feature without deviation


def dataset(spark, d):
    lay = src.layout(spark, d)
    panel = src.panel(spark, d, lay)
    return panel, lay, D.fit(panel, lay)


def constant_panel(spark, d):
    lay = src.layout(spark, d)
    return src.panel(spark, d, lay).withColumn(CONSTANT, F.lit(500.0)), lay


# ----------------------------------------------------------------- windows

register_table("wstat", "wwind", "\n  UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg({f}) AS mean, CASE WHEN stddev_pop({f}) < 1e-6 THEN 1 ELSE stddev_pop({f}) END AS std FROM wwind"
    for f in WIND_FEATURES))


def _z(f: str, table: str, expr: str | None = None) -> str:
    return f"({expr or f} - (SELECT mean FROM {table} WHERE feature = '{f}')) / (SELECT std FROM {table} WHERE feature = '{f}') AS {f}"


_row_wind = {"shear_signed": "shear_signed", "hdw_product": "hdw_product", "wind_frp_coupling": "wind_frp_coupling",
             "wind_var_12h": "stddev_pop(u10) OVER w + stddev_pop(v10) OVER w", "ws850_max_12h": "max(wind_speed_850) OVER w"}
register_table("zwin", "wcell wstat norm", f"""
  SELECT series_id, asplit AS split, anchor_utc AS slot_utc, step, {', '.join(_z(f, 'norm') if f in SCALED else f for f in FEATURES)},
    {', '.join(_z(f, 'wstat', _row_wind[f]) for f in WIND_FEATURES)}
  FROM wcell WINDOW w AS (PARTITION BY series_id, anchor_utc ORDER BY step ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
_early = (0, 1, 5, 10, 11, 47)
_digest_sql = ", ".join(
    [rc(f"sum({c})", f"{c}_sum", 4) for c in CHANNELS] + [rc(f"sum((step + 1) * {c})", f"{c}_moment", 3) for c in CHANNELS]
    + [rc(f"max({c}) FILTER (step = {s})", f"{c}_{s}") for c in D.CLIPPED for s in _early])


def _total(x, lost):
    """Line by line: the sum of what is known, null without any."""
    return pa.array(x.sum(axis=1)) if lost is None else pa.array(np.where(lost, 0.0, x).sum(axis=1), mask=lost.all(axis=1))


def digester(channels=CHANNELS, moments=True):
    """Per window and channel: the sum over steps, and with ``moments`` the sum weighted by step and the clipped channels at some
    steps. The steps of a window are in its row, so array arithmetic takes them batch by batch. With the names of the columns."""
    names = [f"{c}_sum" for c in channels]
    if moments:
        names += [f"{c}_moment" for c in channels] + [f"{c}_{s}" for c in D.CLIPPED for s in _early]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            steps = batch.column("inputs").flatten()
            size = len(steps) // batch.num_rows
            weight = np.arange(1, size + 1)
            sums, weighted, single = [], [], []
            for c in channels:
                cells = steps.field(c)
                x = cells.to_numpy(zero_copy_only=False).reshape(-1, size)
                lost = cells.is_null().to_numpy(zero_copy_only=False).reshape(-1, size) if cells.null_count else None
                sums.append(_total(x, lost))
                if moments:
                    weighted.append(_total(x * weight, lost))
                    if c in D.CLIPPED:
                        single += [cells.take(pa.array(np.arange(batch.num_rows) * size + s)) for s in _early]
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), batch.column("slot_utc"), pa.array(np.full(batch.num_rows, size)),
                                              *sums, *weighted, *single], names=["series_id", "slot_utc", "n_steps", *names])
    return run, names


def _digest_fields(rows, names):
    return T.StructType([rows.schema["series_id"], rows.schema["slot_utc"], T.StructField("n_steps", T.LongType()),
                         *[T.StructField(n, T.DoubleType()) for n in names]])


def _digest_rounded(cells, names):
    digits = lambda n: 4 if n.endswith("_sum") else 3 if n.endswith("_moment") else 6
    return cells.select("series_id", "slot_utc", "n_steps", *[rd(n, digits(n)).alias(n) for n in names])


def digest(windows, channels=CHANNELS):
    """The digest of stored windows."""
    run, names = digester(channels)
    cells = windows.select("series_id", "slot_utc", "inputs").mapInArrow(run, _digest_fields(windows, names))
    return _digest_rounded(cells, names)


def built_digest(panel, scaling, lay, channels=CHANNELS, moments=True):
    """The digest of windows where they are built."""
    run, names = digester(channels, moments)
    return _digest_rounded(D.map_windows(panel, scaling, run, _digest_fields(panel, names), lay, keep=("slot_utc",)), names)


@query("window_inputs_scaled", "W1 N1 N2 F8 F9", sql("zwin", f"""
SELECT series_id, slot_utc, count(*) AS n_steps, {_digest_sql} FROM zwin GROUP BY 1, 2"""))
def _(spark, d):
    panel, lay, scaling = dataset(spark, d)
    return built_digest(panel, scaling, lay)


@query("sample_store", "IO4 IO6", sql("zwin anc", f"""
SELECT z.*, t.y1, t.y12 FROM (SELECT series_id, slot_utc, count(*) AS n_steps, {_digest_sql} FROM zwin WHERE split = 'val' GROUP BY 1, 2) z
JOIN (SELECT series_id, slot_utc, {rc('targets[1]', 'y1')}, {rc('targets[12]', 'y12')} FROM anc) t ON t.series_id = z.series_id AND t.slot_utc = z.slot_utc"""))
def _(spark, d):
    """The whole store is written (all splits, all channels) and one split read back."""
    panel, lay, scaling = dataset(spark, d)
    path = stage_path(spark)
    writers.write_samples(D.scaled_windows(panel, scaling, lay), path, in_order=True)
    val = readers.read_split(spark, path, "val")
    ends = val.select(F.col("series_id").alias("s"), F.col("slot_utc").alias("t"), rd(F.col("targets")[0]).alias("y1"), rd(F.col("targets")[11]).alias("y12"))
    out = digest(val)
    return out.join(ends, (F.col("series_id") == F.col("s")) & (F.col("slot_utc") == F.col("t"))).drop("s", "t")


_meta = ", ".join(f"({i}, '{c}', '{'norm' if c in SCALED else 'wstat' if c in WIND_FEATURES else ''}')" for i, c in enumerate(CHANNELS))


@query("store_metadata", "IO9", sql("wstat norm anc", f"""
SELECT CAST(c.i AS INTEGER) AS position, c.name AS channel, {rc("CASE c.kind WHEN 'norm' THEN n.mean WHEN 'wstat' THEN w.mean END", 'mean')},
  {rc("CASE c.kind WHEN 'norm' THEN n.std WHEN 'wstat' THEN w.std END", 'std')}, {LOOKBACK} AS lookback, {HORIZON} AS horizon,
  (SELECT count(DISTINCT series_id) FROM anc WHERE split = 'train') AS n_train, (SELECT count(DISTINCT series_id) FROM anc WHERE split = 'val') AS n_val,
  (SELECT count(DISTINCT series_id) FROM anc WHERE split = 'test') AS n_test
FROM (VALUES {_meta}) c(i, name, kind) LEFT JOIN norm n ON n.feature = c.name LEFT JOIN wstat w ON w.feature = c.name"""))
def _(spark, d):
    """What the store says about itself: channels in order with their scaling, window sizes, series per split."""
    panel, lay, scaling = dataset(spark, d)
    path = stage_path(spark)
    windows = cut(feat.anchors(panel, lay, scaling.features).select("split", "series_id"))
    writers.write_metadata(spark, path, scaling.params | scaling.wind, scaling.channels)
    writers.write_store_series(windows, path)
    meta = readers.read_metadata(spark, path)
    per = readers.read_store_series(spark, path).groupBy().agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")])
    rows = meta.select(F.posexplode("feature_names").alias("position", "channel"), "normalization_params",
                       F.col("LOOKBACK").alias("lookback"), F.col("HORIZON").alias("horizon"))
    at = F.col("normalization_params")[F.col("channel")]
    return rows.select("position", "channel", rd(at["mean"]).alias("mean"), rd(at["std"]).alias("std"), "lookback", "horizon",
                       *[per.select(f"n_{s}").scalar().alias(f"n_{s}") for s in ("train", "val", "test")])


_held = [f for f in CHANNELS if f != CONSTANT]
register_table("normc", "norm panel", f"""
  SELECT feature, mean, std FROM norm WHERE feature <> '{CONSTANT}'
  UNION ALL SELECT '{CONSTANT}', avg(CAST(500 AS DOUBLE)), stddev_pop(CAST(500 AS DOUBLE)) FROM panel WHERE split = 'train'""")
_names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CHANNELS))


@query("constant_feature_dropped", "N1 P6", sql("normc wstat", f"""
SELECT CAST(row_number() OVER (ORDER BY c.i) - 1 AS INTEGER) AS position, c.name AS channel, {rc('coalesce(n.mean, w.mean)', 'mean')}, {rc('coalesce(n.std, w.std)', 'std')}
FROM (VALUES {_names}) c(i, name) LEFT JOIN normc n ON n.feature = c.name LEFT JOIN wstat w ON w.feature = c.name
WHERE n.feature IS NULL OR n.std <> 0"""))
def _(spark, d):
    """Channels of a panel in which one feature never changes in training: it is left out of the store, order kept."""
    panel, lay = constant_panel(spark, d)
    path = stage_path(spark)
    scaling = D.fit(panel, lay)
    writers.write_metadata(spark, path, scaling.params | scaling.wind, scaling.channels)
    rows = readers.read_metadata(spark, path).select(F.posexplode("feature_names").alias("position", "channel"), "normalization_params")
    at = F.col("normalization_params")[F.col("channel")]
    return rows.select("position", "channel", rd(at["mean"]).alias("mean"), rd(at["std"]).alias("std"))


@query("constant_feature_windows", "N1 W1", sql("zwin", f"""
SELECT series_id, slot_utc, count(*) AS n_steps, {len(_held)} AS n_channels, {', '.join(rc(f'sum({c})', f'{c}_sum', 4) for c in _held)}
FROM zwin GROUP BY 1, 2"""))
def _(spark, d):
    panel, lay = constant_panel(spark, d)
    scaling = D.fit(panel, lay)
    return built_digest(panel, scaling, lay, scaling.channels, moments=False).withColumn("n_channels", F.lit(len(scaling.channels)))


register_table("trainz", "zwin feat zfeat", "\n  UNION ALL ".join(
    f"SELECT '{f}' AS feature, (SELECT avg({f}) FROM zwin WHERE split = 'train') AS mean, (SELECT stddev_pop({f}) FROM zwin WHERE split = 'train') AS std, "
    f"min({f}) AS lo, max({f}) AS hi FROM {'zfeat' if f in SCALED else 'feat'} WHERE split = 'train'" for f in FEATURES))


@query("train_feature_statistics", "A12", sql("trainz", f"SELECT feature, {', '.join(rc(c, c) for c in ('mean', 'std', 'lo', 'hi'))} FROM trainz"))
def _(spark, d):
    """Over all cells of the scaled training windows, and the range of the scaled training rows."""
    panel, lay, scaling = dataset(spark, d)
    s = D.feature_statistics(D.scaled_rows(panel, scaling, lay), scaling)
    return s.select("feature", *rounded("mean", "std", "lo", "hi"))


# ----------------------------------------------------------------- models

@query("model_scoring", "B9", sql("zwin anc", f"""
SELECT a.series_id, a.slot_utc, {rc('a.pers * (1 - 1 / 24.0::DOUBLE)', 'p1')}, {rc('a.pers * 0.5', 'p12')}, {rc('z.calm', 'p2')}
FROM anc a JOIN (SELECT series_id, slot_utc, greatest(max(ws850_max_12h) FILTER (step = 0) + avg(wind_var_12h), 0) AS calm FROM zwin GROUP BY 1, 2) z
  ON z.series_id = a.series_id AND z.slot_utc = a.slot_utc"""))
def _(spark, d):
    """A user model on whole scaled windows of 37 channels: the prior fading with the lead, and one lead from wind channels."""
    panel, lay, scaling = dataset(spark, d)
    at = {c: i for i, c in enumerate(scaling.channels)}
    mean, std = scaling.params["frp_lag_1h"]

    def model(x):
        out = np.maximum(x[:, -1, at["frp_lag_1h"]] * std + mean, 0.0)[:, None] * (1.0 - np.arange(1, HORIZON + 1) / 24.0)[None, :]
        out[:, 1] = np.maximum(x[:, 0, at["ws850_max_12h"]] + x[:, :, at["wind_var_12h"]].mean(axis=1), 0.0)
        return out

    p = D.map_windows(panel, scaling, SC.scorer(model, scaling.channels), SC.forecast_fields(panel), lay, keep=("slot_utc",))
    return p.select("series_id", "slot_utc", *[rd(F.col("preds")[k - 1]).alias(f"p{k}") for k in (1, 2, 12)])

