"""Hand-made panels for tests."""

from __future__ import annotations

import numpy as np
import pandas as pd

from panelcast.schema import COVARIATES

START = pd.Timestamp("2024-02-20 00:00:00")


def series(name, n, seed=0, split="train", gap=0.2, fire=0.3, start=START):
    """``n`` present hourly rows with random gaps between them."""
    rng = np.random.default_rng(seed)
    hours = np.cumsum(1 + rng.geometric(1 - gap, n) - 1)
    burning = rng.random(n) < fire
    df = pd.DataFrame({
        "series_id": name, "slot_utc": start + pd.to_timedelta(hours, unit="h"),
        "slot_type": np.where(burning, "fire", "no_fire"),
        "frp_sum_mw": np.where(burning, rng.gamma(2.0, 40.0, n), 0.0),
        "sat_fraction": np.where(burning, rng.random(n), 0.0), "split": split,
    })
    for i, c in enumerate(COVARIATES):
        df[c] = rng.normal(i, 1 + i / 3, n)
    return df


def frame(spark, pdf):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pdf)
    return df.withColumn("slot_utc", F.col("slot_utc").cast("timestamp_ntz"))
