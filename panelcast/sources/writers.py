"""Writing the sample store, manifest and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.plans.manifest import MANIFEST
from panelcast.schema import FEATURES, HORIZON, LOOKBACK


OPEN_FILES = 16  # parts that a task keeps open instead of ordering its windows by split; with more splits Spark orders them


def write_samples(windows: DataFrame, folder: str, mode: str = "error", in_order: bool = False) -> None:
    """Windows with ``inputs`` and ``targets``, one partition folder per split, each file ordered by series and time: a reader of
    one series skips the other files and row groups by their limits.

    ``in_order`` says that the windows come series by series in time order, as ``scaled_windows`` leaves them; then nothing is
    sorted, each split of a task goes to its own open file. Neighbouring windows share most of their steps: written plainly,
    without dictionaries, the repeats lie at whole bytes and compress away.
    """
    conf, name = windows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    rows = windows.select("split", "series_id", "slot_utc", "inputs", "targets")
    rows = rows if in_order else rows.sortWithinPartitions("split", "series_id", "slot_utc")
    writer = rows.write.mode(mode).partitionBy("split").option("compression", "zstd").option("parquet.enable.dictionary", "false")
    try:
        conf.set(name, OPEN_FILES if in_order else before)
        writer.parquet(f"{folder}/samples")
    finally:
        conf.set(name, before)


def write_metadata(spark: SparkSession, folder: str, norm: dict, features=FEATURES, mode: str = "error") -> None:
    """One row: channels in order, their scaling, window sizes."""
    row = (list(features), {k: {"mean": m, "std": s} for k, (m, s) in norm.items()}, LOOKBACK, HORIZON)
    schema = "feature_names array<string>, normalization_params map<string, struct<mean: double, std: double>>, LOOKBACK int, HORIZON int"
    spark.createDataFrame([row], schema).coalesce(1).write.mode(mode).parquet(f"{folder}/metadata")


def write_store_series(windows: DataFrame, folder: str, mode: str = "error") -> None:
    """Which series each split of the store holds."""
    windows.select("split", "series_id").distinct().write.mode(mode).parquet(f"{folder}/series")


def write_manifest(manifest: DataFrame, path: str, mode: str = "error") -> None:
    manifest.select(*MANIFEST).write.mode(mode).option("header", True).csv(path)


def write_norm_params(params: DataFrame, path: str, mode: str = "error") -> None:
    params.select("feature", "mean", "std").write.mode(mode).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Tidy CSV; unknown values are empty."""
    df.write.mode(mode).option("header", True).csv(path)


def write_report(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; nested columns stay nested."""
    df.write.mode(mode).json(path)


def write_series_files(df: DataFrame, folder: str, name: str, suffix: str) -> None:
    """CSV part folders whose name carries the series, as ``read_*`` expect them."""
    df.withColumn("f", F.concat(F.col(name), F.lit(f"{suffix}.csv"))).drop(name).write.mode("append").partitionBy(
        "f").option("header", True).csv(folder)


def write_predictions(df: DataFrame, folder: str, mode: str = "error") -> None:
    """Seed forecasts, a folder of parts per seed under the names ``readers.read_predictions`` looks for."""
    name = F.format_string("seed_%03d_valpreds.parquet", F.col("seed"))
    df.withColumn("f", name).drop("seed").write.mode(mode).partitionBy("f").parquet(folder)


def params_json(norm: dict) -> str:
    return json.dumps({k: {"mean": m, "std": s} for k, (m, s) in norm.items()}, indent=2)
