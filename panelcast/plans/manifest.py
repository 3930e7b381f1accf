"""One row per window with a dense global index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.layout import dense_number, order_value, splitters, value_range
from panelcast.schema import SPLITS
from panelcast.session import cut

MANIFEST = ("sample_idx", "series_id", "split", "input_start_utc", "target_end_utc", "target_mean_frp", "target_max_frp")


def split_rank():
    out = F.lit(len(SPLITS))
    for i, s in enumerate(SPLITS):
        out = F.when(F.col("split") == s, i).otherwise(out)
    return out


def series_offsets(windows: DataFrame, order: str = "series_id", splits: list[float] | None = None) -> DataFrame:
    """Windows before each series, in split order and then by ``order`` (text by its md5).

    Prefix sums on two levels: series fall into even ranges of their order (``splitters``), each (split, range) is summed
    on its own, and gets the total of those before it. The only ordered pass over everything has one row per split and range.
    """
    counts = windows.groupBy("split", "series_id", *([order] if order != "series_id" else [])).agg(
        F.count(F.lit(1)).alias("_n"))
    inner, coarse = order_value(counts, order)
    counts = cut(counts.withColumns({"_s": split_rank(), "_v": coarse}))
    ranged = value_range(counts, "_v", splitters(counts, "_v") if splits is None else splits, "_c")
    ranges = ranged.groupBy("_s", "_c").agg(F.sum("_n").alias("_m"))
    earlier = Window.orderBy("_s", "_c").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_s", "_c", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_s", "_c").orderBy(inner).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(ranges, ["_s", "_c"]).select(
        "series_id", "split", (F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_offset"))


def with_sample_index(windows: DataFrame, order: str = "series_id") -> DataFrame:
    """``sample_idx`` from 0: train, val, test, then series, then time; no global sort."""
    day = F.datediff(F.col("slot_utc").cast("date"), F.lit("1970-01-01").cast("date"))
    rows = dense_number(windows, ["split", "series_id"], F.floor(day / 28), ["slot_utc"], "_i", 0)
    return rows.join(series_offsets(windows, order), ["split", "series_id"]).withColumn(
        "sample_idx", F.col("_offset") + F.col("_i")).drop("_i", "_offset")


def manifest(windows: DataFrame, order: str = "series_id") -> DataFrame:
    return with_sample_index(windows, order).select(*MANIFEST)
