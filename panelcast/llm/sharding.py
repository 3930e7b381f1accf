"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import cut

#: numpy's own sampler takes populations below this.
NUMPY_LIMIT = 1_000_000_000
POSITION_BITS = 33  # of monotonically_increasing_id


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Number of good ones in ``sample`` draws without return, for populations of any size.

    Beyond numpy's limit it inverts the distribution, normalised over 12 standard deviations
    around the mean; what lies outside is below the resolution of a double.
    """
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    mean = sample * (good / total)
    sd = np.sqrt(mean * (bad / total) * ((total - sample) / max(1, total - 1)))
    lo = max(0, sample - bad, int(mean - 12 * sd) - 2)
    hi = min(good, sample, int(mean + 12 * sd) + 2)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max())
    return lo + min(int(np.searchsorted(np.cumsum(p), rng.random() * p.sum())), hi - lo)


def draw_cells(rng: np.random.Generator, free: np.ndarray, rows: int) -> np.ndarray:
    """How many of ``rows`` fall into each cell, when all places left in the cells are equally likely."""
    total = int(free.sum())
    if rows == 0 or rows == total:
        return free.copy() if rows else np.zeros_like(free)
    if total < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(free, rows, method="marginals")
    out = np.zeros_like(free)
    for i, f in enumerate(free):
        if rows == 0:
            break
        total -= int(f)
        out[i] = hypergeometric(rng, int(f), total, rows) if total else rows
        rows -= int(out[i])
    return out


class CommunicationMatrix:
    """Rows: source partitions; columns: destination cells. A task draws only its own row.

    The matrix is drawn by halving the range of partitions: a node of that tree splits the places its partitions fill
    between its halves, with a generator seeded by the node. So every task that walks to its leaf sees the same draws,
    and no task or driver holds the whole matrix.
    """

    def __init__(self, counts: list[int], cells: np.ndarray, seed: int):
        self.before = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])
        self.cells, self.seed = cells, seed

    def row(self, p: int) -> np.ndarray:
        lo, hi, free = 0, len(self.before) - 1, self.cells
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = draw_cells(np.random.default_rng([self.seed, lo, hi]), free, int(self.before[mid] - self.before[lo]))
            lo, hi, free = (lo, mid, left) if p < mid else (mid, hi, free - left)
        return free


def cell_table(rows: int, n_shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Capacity, shard and first slot of each cell: shards differ by one row at most, and are cut into near-equal cells."""
    sizes, shards, starts = [], [], []
    for s in range(n_shards):
        size = rows // n_shards + (s < rows % n_shards)
        parts = max(1, -(-size // block_rows))
        edges = [size * i // parts for i in range(parts + 1)]
        for a, b in zip(edges, edges[1:]):
            sizes.append(b - a)
            shards.append(s)
            starts.append(a)
    return np.array(sizes, dtype=np.int64), np.array(shards, dtype=np.int32), np.array(starts, dtype=np.int64)


def shard(df: DataFrame, n_shards: int = 24, seed: int = 17, block_rows: int = 1 << 14) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: a uniformly random order dealt into shards whose sizes differ by one row at most.

    1. The rows are written once, each with its source partition and its place there, so that retried tasks see the same order.
    2. The hypergeometric matrix says how many rows each partition sends to each cell (a run of slots of a shard).
    3. Each partition permutes its list of destinations (one small integer a row, never the rows).
    4. One exchange by cell; within a cell rows are numbered in a second random order. A cell has ``block_rows`` rows at most.

    The driver holds one count per source partition. Nulls, empty and long texts and equal rows are rows like any other
    (equal rows get slots of their own); an empty table gives an empty result. Columns already named ``shard`` or ``slot``
    are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = df.sparkSession
    source = cut(df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")))
    part, place = F.shiftright("at", POSITION_BITS), F.col("at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    found = sorted((r["part"], r["n"]) for r in source.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    counts = [n for _, n in found]
    index = {p: i for i, (p, _) in enumerate(found)}
    sizes, shards, starts = cell_table(sum(counts), n_shards, block_rows)
    shared = spark.sparkContext.broadcast((CommunicationMatrix(counts, sizes, seed), index, shards, starts))

    @F.pandas_udf("struct<shard int, start long>")
    def cell(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        matrix, where, shard_of, start_of = shared.value
        last, destinations = None, np.zeros(0, dtype=np.int32)
        for parts, places in batches:
            to = np.zeros(len(parts), dtype=np.int32)
            for p in parts.unique():
                if p != last:
                    row = matrix.row(where[p])
                    destinations = np.random.default_rng([seed, int(p), 1 << 20]).permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))
                    last = p
                mine = (parts == p).to_numpy()
                to[mine] = destinations[places.to_numpy()[mine]]
            yield pd.DataFrame({"shard": shard_of[to], "start": start_of[to]})

    order = Window.partitionBy("cell.shard", "cell.start").orderBy(F.xxhash64(F.lit(seed), "at"), "at")
    dealt = source.withColumn("cell", cell(part, place)).withColumn("rank", F.row_number().over(order))
    return dealt.select(
        *[F.col("row").getField(c).alias(c) for c in df.columns if c not in ("shard", "slot")],
        F.col("cell.shard").alias("shard"),
        (F.col("cell.start") + F.col("rank") - 1).alias("slot"),
    )
