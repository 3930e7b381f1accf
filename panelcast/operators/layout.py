"""How a panel is laid out for row-frame windows, and exact ranks without hot tasks.

Row frames want one task per series.  That is right while a series is short,
and wrong once one series can hold a large share of all rows.  ``Layout`` makes
the choice from a proven bound: with unique (series, slot) rows no series can be
longer than the time span divided by the slot length.  Beyond the limit the
series is cut into row blocks that carry the neighbouring rows their frames
need, so results stay the same and no task sees a whole series.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.session import cut

SERIES_ROW_LIMIT = 250_000
RANGE_ROWS = 500_000  # of a value range that one task orders


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...] = ("series_id",)
    time: str = "slot_utc"
    blocked: bool = False
    block_rows: int = 8192
    chunk_days: int = 28

    @classmethod
    def detect(cls, df: DataFrame, time: str = "slot_utc", slot_seconds: int = 3600,
               limit: int | None = None, **kw) -> "Layout":
        """Pick the layout from the time span (min and max of one column).

        The span bounds a series' rows because (series, slot) rows are unique.
        """
        limit = SERIES_ROW_LIMIT if limit is None else limit
        span = df.select(F.timestamp_diff("SECOND", F.min(time), F.max(time))).first()[0]
        return cls(blocked=(span or 0) // slot_seconds + 1 > limit, **kw)


@dataclass
class PanelWindows:
    """A panel opened for row-frame windows.

    ``df``/``w`` are the rows and the window to compute on; ``close`` drops the
    borrowed neighbour rows.  ``sums`` and ``mins`` name running aggregates from
    the series start, which no bounded frame can give.  Sums of doubles are added as
    decimals of 12 places, so that they are the same to the last bit in any layout.
    """

    source: DataFrame
    layout: Layout
    lookback: int
    lookahead: int
    sums: dict[str, Column] = field(default_factory=dict)
    mins: dict[str, Column] = field(default_factory=dict)

    def __post_init__(self):
        self._real = {n: isinstance(self.source.select(c.alias(n)).schema[n].dataType, T.DoubleType) for n, c in self.sums.items()}
        self.sums = {n: c.cast("decimal(38,12)") if self._real[n] else c for n, c in self.sums.items()}
        if self.layout.blocked:
            self._open_blocks()
        else:
            self._open_series()

    def _open_series(self):
        lay = self.layout
        self.w = Window.partitionBy(*lay.keys).orderBy(lay.time)
        upto = self.w.rowsBetween(Window.unboundedPreceding, 0)
        self.df = self.source.withColumns({
            "row_no": F.row_number().over(self.w).cast("long"),
            **{n: self._out(n, F.sum(c).over(upto)) for n, c in self.sums.items()},
            **{n: F.min(c).over(upto) for n, c in self.mins.items()},
        })

    def _held(self, name: str, part: Column) -> Column:
        return part.cast("decimal(36,12)") if self._real[name] else part  # two of these add without loss of places

    def _out(self, name: str, total: Column) -> Column:
        return total.cast("double") if self._real[name] else total

    def _open_blocks(self):
        lay, size = self.layout, self.layout.block_rows
        if size < max(self.lookback, self.lookahead):
            raise ValueError("block_rows must cover the frames")
        keys = [*lay.keys, "_chunk"]
        chunk = F.floor(F.datediff(F.col(lay.time).cast("date"), F.lit("1970-01-01").cast("date")) / lay.chunk_days)
        src = self.source.withColumn("_chunk", chunk)

        # One small row per (series, time chunk); its running totals are the carried prefixes.
        totals = src.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.sum(c).alias(f"_s_{n}") for n, c in self.sums.items()],
            *[F.min(c).alias(f"_m_{n}") for n, c in self.mins.items()],
        )
        earlier = Window.partitionBy(*lay.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *keys,
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
            *[F.sum(f"_s_{n}").over(earlier).alias(f"_s0_{n}") for n in self.sums],
            *[F.min(f"_m_{n}").over(earlier).alias(f"_m0_{n}") for n in self.mins],
        )
        here = Window.partitionBy(*keys).orderBy(lay.time)
        upto = here.rowsBetween(Window.unboundedPreceding, 0)
        numbered = src.join(carried, keys).withColumns({
            "row_no": (F.col("_n0") + F.row_number().over(here)).cast("long"),
            **{n: self._out(n, _plus(self._held(n, F.col(f"_s0_{n}")), self._held(n, F.sum(c).over(upto)))) for n, c in self.sums.items()},
            **{n: F.least(F.col(f"_m0_{n}"), F.min(c).over(upto)) for n, c in self.mins.items()},
        }).drop("_chunk", "_n0", *[f"_s0_{n}" for n in self.sums], *[f"_m0_{n}" for n in self.mins])

        pos = (F.col("row_no") - 1) % size
        home = F.floor((F.col("row_no") - 1) / size)
        copies = F.array(
            home,
            F.when(pos >= size - self.lookback, home + 1),
            F.when((pos < self.lookahead) & (home > 0), home - 1),
        )
        self.df = (
            numbered.withColumn("_home", home)
            .withColumn("_block", F.explode(F.array_compact(copies)))
        )
        self.w = Window.partitionBy(*lay.keys, "_block").orderBy("row_no")

    def close(self, df: DataFrame) -> DataFrame:
        if not self.layout.blocked:
            return df
        return df.filter("_block = _home").drop("_block", "_home")


def _plus(a: Column, b: Column) -> Column:
    """a + b where a missing side counts as nothing, and two missing sides as null."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def dense_number(df: DataFrame, keys: list[str], chunk: Column, order: list, name: str, start: int = 1) -> DataFrame:
    """Gap-free numbers per key in ``order``; ``chunk`` is a coarser, monotone part of the order.

    Only per-chunk counts meet in one window; the rows are numbered chunk by chunk.
    """
    rows = df.withColumn("_chunk", chunk)
    counts = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    here = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        rows.join(offsets, [*keys, "_chunk"])
        .withColumn(name, (F.col("_n0") + F.row_number().over(here) + (start - 1)).cast("long"))
        .drop("_chunk", "_n0")
    )


def hash_order(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def order_value(df: DataFrame, key: str, hashed: bool | None = None) -> tuple[Column, Column]:
    """The order of a key, and a double that never falls along it: numbers in their own order, text (or any key with
    ``hashed``) by its md5."""
    if isinstance(df.schema[key].dataType, T.StringType) if hashed is None else hashed:
        return hash_order(key), F.conv(F.substring(hash_order(key), 1, 13), 16, 10).cast("double")
    return F.col(key), F.col(key).cast("double")


def splitters(df: DataFrame, value: str, parts: int | None = None, share: int = RANGE_ROWS) -> list[float]:
    """Values that cut the rows into even ranges: at least as many as shuffle partitions, and so many that a range
    has ``share`` rows at most (and a tenth more; equal values always fall together).

    The quantile sketch is off by a twentieth of a range; if the count that comes with it says that the ranges are
    too few for the rows, it is asked again for as many as are needed.
    """
    parts = parts or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while True:
        probs = [i / parts for i in range(1, parts)]
        v = F.col(value).cast("double")
        n, got = df.select(F.count(v), F.percentile_approx(v, probs, parts * 20)).first()
        if n <= parts * share:
            return sorted({x for x in got or [] if isfinite(x)})
        parts = -(-n // share)


def hash_number(df: DataFrame, key: str, name: str, start: int = 0) -> DataFrame:
    """Gap-free numbers of all rows in md5 order of a key, by even ranges of it."""
    order, coarse = order_value(df, key, hashed=True)
    rows = cut(df.withColumn("_v", coarse))
    return dense_number(value_range(rows, "_v", splitters(rows, "_v"), "_r"), [], F.col("_r"), [order], name, start).drop("_v", "_r")


def value_range(df: DataFrame, value: str, splits: list[float], name: str) -> DataFrame:
    """Number of the value range a row falls in (binary search in the JVM)."""
    if not splits:
        return df.withColumn(name, F.lit(0.0))
    from pyspark.ml.feature import Bucketizer

    edges = [float("-inf"), *splits, float("inf")]
    return Bucketizer(splits=edges, inputCol=value, outputCol=name).transform(df)


def cumulative_cells(df: DataFrame, keys: list[str], value: str, splits: list[float]) -> DataFrame:
    """Distinct values per key with their counts and the count of smaller rows.

    Equal values collapse before the shuffle, then each (key, value range) is
    summed on its own and gets the total of the ranges before it.
    Columns: keys, value, _range, n, below, total.
    """
    cells = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    cells = value_range(cells, value, splits, "_range")
    ranges = cells.groupBy(*keys, "_range").agg(F.sum("n").alias("_m"))
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        *keys, "_range",
        F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_below"),
        F.sum("_m").over(by_key).alias("total"),
        F.col("_m"),
    )
    here = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return cells.join(ranges, [*keys, "_range"]).withColumn(
        "below", F.col("_below") + F.coalesce(F.sum("n").over(here), F.lit(0))
    ).drop("_below")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    parts: int | None = None, splits: list[float] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per key; no task holds a whole key.

    ``probs`` maps output column to probability.  Only the value ranges that hold
    a wanted rank are ordered row by row.
    """
    if splits is None:
        splits = splitters(df, value, parts)
    cells = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    cells = value_range(cells, value, splits, "_range")
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        cells.groupBy(*keys, "_range").agg(F.sum("n").alias("_m"))
        .select(
            *keys, "_range", "_m",
            F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_below"),
            F.sum("_m").over(by_key).alias("_total"),
        )
    )
    at = {c: F.lit(float(p)) * (F.col("_total") - 1) for c, p in probs.items()}
    inside = [
        (r >= F.col("_below")) & (r < F.col("_below") + F.col("_m"))
        for a in at.values() for r in (F.floor(a), F.ceil(a))
    ]
    wanted = ranges.filter(reduce(lambda x, y: x | y, inside)).drop("_m")
    here = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.join(wanted, [*keys, "_range"]).withColumn(
        "_from", F.col("_below") + F.coalesce(F.sum("n").over(here), F.lit(0))
    )

    def value_at(rank: Column) -> Column:
        hit = (F.col("_from") <= rank) & (rank < F.col("_from") + F.col("n"))
        return F.max(F.when(hit, F.col(value)))

    parts_agg = []
    for c, a in at.items():
        parts_agg += [value_at(F.floor(a)).alias(f"_lo_{c}"), value_at(F.ceil(a)).alias(f"_hi_{c}")]
    out = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *parts_agg)

    def between(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        # Equal ends stay as they are, also when both are infinite.
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at[c] - F.floor(at[c])))

    return out.select(*keys, *[between(c).alias(c) for c in probs])
