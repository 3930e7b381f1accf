"""Deterministic sampling of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.layout import dense_number, hash_number
from panelcast.plans.bootstrap import md5_int
from panelcast.session import cut


def distinct_draws(size: Column, count: int, *label) -> Column:
    """``count`` different numbers below ``size`` as an array, drawn by hash.

    The j-th draw is a number below size - j, moved past the numbers already
    taken: uniform, without ranking the whole pool.  Needs size >= count.
    """
    raw = F.array(*[md5_int(*label, F.lit(str(j))) % F.greatest(size - j, F.lit(1)) for j in range(count)])
    none = F.array().cast("array<bigint>")
    return F.aggregate(raw, none, lambda taken, x: F.array_sort(F.array_append(
        taken, F.aggregate(taken, x, lambda v, t: F.when(v >= t, v + 1).otherwise(v)))))


def repeated_draws(size: Column, count: int, *label) -> Column:
    return F.array(*[md5_int(*label, F.lit(str(j))) % size for j in range(count)])


def event_balanced_batches(windows: DataFrame, events_per_batch: int = 8, samples_per_event: int = 8,
                           num_batches: int | None = None, seed: int = 0) -> DataFrame:
    """(batch, series_id, slot_utc): K series per batch, M windows per series.

    Pools are fire-active windows; series without any stay out.  A pool smaller
    than M is drawn from with replacement.  Numbers are drawn per batch and per
    (batch, series) and then joined to numbered series and windows, so the work
    grows with the batches, not with batches times pool.
    """
    from pyspark.sql.types import StructType

    spark = windows.sparkSession
    pool = windows.filter("fire_active").select("series_id", "slot_utc")
    month = F.datediff(F.col("slot_utc").cast("date"), F.lit("1970-01-01").cast("date"))
    pool = cut(dense_number(pool, ["series_id"], F.floor(month / 28), ["slot_utc"], "pick", 0))
    sizes = pool.groupBy("series_id").agg(F.count(F.lit(1)).alias("pool_size"))
    sizes = cut(hash_number(sizes, "series_id", "series_no"))
    n, total = sizes.agg(F.count(F.lit(1)), F.sum("pool_size")).first()
    if not n:
        return spark.createDataFrame([], StructType(windows.select("series_id", "slot_utc").schema.fields)).withColumn("batch", F.lit(0).cast("long"))
    if num_batches is None:
        num_batches = max(1, total // (events_per_batch * samples_per_event))
    k, label = min(events_per_batch, n), F.lit(str(seed))
    batches = spark.range(num_batches).withColumnRenamed("id", "batch")
    chosen = batches.withColumn("series_no", F.explode(distinct_draws(
        F.lit(n).cast("long"), k, label, F.lit("s"), F.col("batch").cast("string"))))
    chosen = chosen.join(sizes, "series_no")
    named = (label, F.lit("w"), F.col("batch").cast("string"), F.col("series_id").cast("string"))
    size = F.col("pool_size")
    picks = F.when(size >= samples_per_event, distinct_draws(size, samples_per_event, *named)).otherwise(
        repeated_draws(size, samples_per_event, *named))
    picked = chosen.select("batch", "series_id", F.explode(picks).alias("pick"))
    return picked.join(pool, ["series_id", "pick"]).select("batch", "series_id", "slot_utc")


def spot_sample(manifest: DataFrame, per_split: int = 5, seed: int = 42) -> DataFrame:
    """At most ``per_split`` windows per split, smallest hashes first (a per-split top-k)."""
    from pyspark.sql import Window

    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("series_id").cast("string"), F.col("slot_utc").cast("string")))
    w = Window.partitionBy("split").orderBy("_h")
    return manifest.withColumn("_h", order).withColumn("_rn", F.row_number().over(w)).filter(
        F.col("_rn") <= per_split).drop("_h", "_rn")
