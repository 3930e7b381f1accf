"""Bootstrap of a mean over series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.layout import exact_quantiles, hash_number
from panelcast.session import cut


def md5_int(*parts) -> F.Column:
    """A 60-bit integer from the text of its parts; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])), 1, 15), 16, 10).cast("long")


def indexed(per_event: DataFrame, value: str = "ss") -> DataFrame:
    """(idx, value), idx from 0 in md5 order of the series."""
    rows = per_event.filter(F.col(value).isNotNull()).select("series_id", F.col(value).alias("value"))
    return hash_number(rows, "series_id", "idx").select("idx", "value")


def resample_means(values: DataFrame, n: int, n_boot: int = 10_000, seed: int = 42, method: str = "draws") -> DataFrame:
    """(b, m): the mean of each resample of n values.

    ``draws``: ``n_boot`` resamples drawn by hash.  ``exact``: every one of the n**n
    resamples, for tables that are small by nature.  The caller chooses; the number of
    values never does.  Draws reach their values by an equi-join on the index.
    """
    spark = values.sparkSession
    if method not in ("draws", "exact"):
        raise ValueError("method is draws or exact")
    total = n ** n if method == "exact" else n_boot
    draws = spark.range(total * n).select(F.floor(F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("i"))
    if method == "exact":
        place = F.element_at(F.array(*[F.lit(n ** i) for i in range(n)]), (F.col("i") + 1).cast("int"))
        idx = (F.floor(F.col("b") / place) % n).cast("long")
    else:
        idx = md5_int(F.lit(seed).cast("string"), F.col("b").cast("string"), F.col("i").cast("string")) % n
    return draws.withColumn("idx", idx).join(values, "idx").groupBy("b").agg(F.avg("value").alias("m"))


def interval(means: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval and whether it excludes zero."""
    q = exact_quantiles(means, [], "m", {"ci_lo": low, "ci_hi": high})
    return q.withColumn("ci_excludes_zero", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


def bootstrap(per_event: DataFrame, value: str = "ss", n_boot: int = 10_000, seed: int = 42,
              method: str = "draws") -> DataFrame:
    values = cut(indexed(per_event, value))
    n = values.count()
    if n == 0:
        raise ValueError("no series with a value")
    return interval(cut(resample_means(values, n, n_boot, seed, method)))
