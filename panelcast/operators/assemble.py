"""Joining observation, covariate and catalogue tables into a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions import columns as C
from panelcast.schema import COVARIATES, require


def join_covariates(obs: DataFrame, cov: DataFrame) -> DataFrame:
    """Inner join on time within a series."""
    return obs.join(cov, ["series_id", "slot_utc"], "inner")


def drop_gaps(df: DataFrame) -> DataFrame:
    return df.filter(C.present())


def fill_saturation(df: DataFrame) -> DataFrame:
    return df.withColumn("sat_fraction", C.filled_saturation())


def attach_split(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Split on every row; Spark broadcasts the catalogue when its size allows."""
    return df.join(catalogue.select("series_id", "split"), "series_id", "inner")


def assemble(obs: DataFrame, cov: DataFrame, catalogue: DataFrame) -> DataFrame:
    require(cov, *COVARIATES)
    joined = join_covariates(drop_gaps(obs), cov)
    return attach_split(fill_saturation(joined), catalogue)


def series_without_data(catalogue: DataFrame, *tables: DataFrame) -> DataFrame:
    """Catalogue series that lack rows in any of the tables."""
    out = None
    for i, t in enumerate(tables):
        part = catalogue.select("series_id").join(t.select("series_id").distinct(), "series_id", "left_anti")
        part = part.withColumn("table_no", F.lit(i + 1))
        out = part if out is None else out.unionByName(part)
    return out


def check_complete(catalogue: DataFrame, *tables: DataFrame) -> None:
    """Stop when a catalogue series has no data; ``series_without_data`` lists them all."""
    lost = series_without_data(catalogue, *tables).agg(F.count_distinct("series_id").alias("n"), F.min("series_id").alias("first")).first()
    if lost.n:
        raise ValueError(f"{lost.n} series without data, {lost.first} first; series_without_data lists them")


def leaked_series(rows: DataFrame) -> DataFrame:
    """Series of the held-out splits that also occur in training."""
    train = rows.filter("split = 'train'").select("series_id").distinct()
    held = rows.filter("split <> 'train'").select("series_id", "split").distinct()
    return held.join(train, "series_id", "left_semi")


def stack_series(parts: list[DataFrame]) -> DataFrame:
    """One table from per-series tables, by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
