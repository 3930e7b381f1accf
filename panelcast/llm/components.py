"""Connected components of a link table by contraction: neighbours merge in rounds, each of a few exchanges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut

CHUNK = 1 << 20  # links that a task thins at a time
LINKS = "u long, v long"


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what the given ones do: each id with the least one that it reaches, without loops."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[:len(u)], at[len(u):]
    root = np.arange(len(ids))
    while True:
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
    tied = np.flatnonzero(root != np.arange(len(ids)))
    return ids[tied], ids[root[tied]]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u, v)], ["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield out(held)
            held, n = [], 0
    if n:
        yield out(held)


def _rank(node: Column, turn: int) -> Column:
    """The order that decides in a round which neighbour a node joins: the ids themselves, or a hash of them."""
    return F.struct((F.xxhash64(node, F.lit(turn)) if turn % 2 else F.lit(0)).alias("r"), node.alias("to"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``id``, ``component``): for each id in a link, the smallest id its links reach (itself included).

    Direction, repeats and loops do not matter; links with a null end are ignored; no link gives an empty table.

    In a round each node joins the first of itself and its neighbours; the links are then drawn between what they joined, and thinned inside
    the tasks to a forest. Rounds go by id (stars around small ids end in one) and by a fresh hash in turn: the latter leave three quarters of
    the nodes at most, on average, whatever the shape, so rounds grow with the logarithm of the nodes. The neighbours of a hub are
    aggregated before the shuffle. Nothing but "is a link left" reaches the driver.
    """
    u, v = F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")
    pairs = cut(links.select(u, v).filter("u <> v").mapInArrow(_thin, LINKS))
    joined, turn = None, 0
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(_rank(F.col("v"), turn)).alias("n"))
        step = cut(first.select("u", F.least("n", _rank(F.col("u"), turn))["to"].alias("to")))
        new_u, new_v = step.select("u", F.col("to").alias("nu")), step.select(F.col("u").alias("v"), F.col("to").alias("nv"))
        drawn = pairs.join(new_u, "u").join(new_v, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v")).filter("u <> v")
        pairs = cut(drawn.mapInArrow(_thin, LINKS))
        if joined is None:
            joined = step
        else:
            on = step.select(F.col("u").alias("to"), F.col("to").alias("next"))
            joined = joined.join(on, "to", "left").select("u", F.coalesce("next", "to").alias("to"))
        turn += 1
    if joined is None:
        return pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    if turn > 1:
        joined = cut(joined)
        joined = joined.join(joined.groupBy("to").agg(F.min("u").alias("least")), "to").select("u", F.col("least").alias("to"))
    return joined.select(F.col("u").alias("id"), F.col("to").alias("component"))
