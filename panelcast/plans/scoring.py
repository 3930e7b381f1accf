"""Scoring windows with a user's model, batch by batch inside tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelcast.operators.features import input_windows
from panelcast.operators.layout import Layout
from panelcast.schema import FEATURES


def predict_windows(windows: DataFrame, model: Callable[[np.ndarray], np.ndarray], features=FEATURES,
                    keep=("series_id", "slot_utc"), batch_size: int = 256) -> DataFrame:
    """``model`` maps a (batch, lookback, features) array to (batch, horizon) forecasts.

    Arrow batches become arrays column by column; no Python object per cell.
    """
    return windows.select(*keep, "inputs").mapInArrow(scorer(model, features, keep, batch_size), forecast_fields(windows, keep))


def forecast_fields(rows: DataFrame, keep=("series_id", "slot_utc")) -> T.StructType:
    return T.StructType([*[rows.schema[k] for k in keep], T.StructField("preds", T.ArrayType(T.DoubleType()))])


def scorer(model, features=FEATURES, keep=("series_id", "slot_utc"), batch_size: int = 256):
    """What ``predict_windows`` does to Arrow batches; ``dataset.map_windows`` takes it to the tasks that build the windows."""
    names = tuple(features)

    def score(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            steps = batch.column(batch.schema.get_field_index("inputs")).flatten()
            x = np.stack([steps.field(f).to_numpy(zero_copy_only=False) for f in names], axis=-1)
            x = x.reshape(n, -1, len(names))
            out = np.concatenate([np.asarray(model(x[i:i + batch_size]), dtype=np.float64) for i in range(0, n, batch_size)])
            preds = pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), out.ravel())
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, preds], names=[*keep, "preds"])

    return score


def predict_panel(panel: DataFrame, model, features=FEATURES, layout: Layout | None = None, batch_size: int = 256) -> DataFrame:
    return predict_windows(input_windows(panel, layout, features), model, features, batch_size=batch_size)
