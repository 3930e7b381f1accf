"""Near-duplicate vectors: sorted projection passes, as many as a label's size and crowding ask for; verified pairs are united."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.components import components
from panelcast.session import cut

HASH_BITS = 40
SWEPT = {"seam": pa.int32(), "side": pa.int32(), "pass": pa.int32(), "label": pa.int64(), "dim": pa.int32(), "key": pa.int64(),
         "id": pa.int64(), "vec": pa.binary(), "root": pa.int64()}
SEED = 97
SAMPLE = 512  # vectors of a label that say how crowded it is
MOST_PASSES = 100_000  # a label that asks for more is an error: a wider window serves it


def _tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null where a vector cannot be compared."""
    for b in batches:
        out = []
        for v in b.column(2).to_pylist():
            x = None if not v or any(e is None for e in v) else np.array(v, dtype=np.float64)
            out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])


def unit_rows(blobs: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(blobs), dtype=np.float64).reshape(len(blobs), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no square over- or underflows
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def projection_keys(m: np.ndarray, passes: int) -> np.ndarray:
    """(rows, passes): signs on HASH_BITS random directions of each pass, concatenated to one number."""
    rng = np.random.default_rng([SEED, m.shape[1]])
    out = np.empty((len(m), passes), dtype=np.int64)
    for p in range(passes):
        bits = m @ rng.standard_normal((m.shape[1], HASH_BITS)) > 0
        out[:, p] = bits @ (1 << np.arange(HASH_BITS - 1, -1, -1, dtype=np.int64))
    return out


def passes_for(sample: np.ndarray, centre: np.ndarray, n: int, window: int, least: float, recall: float) -> int:
    """Passes over ``n`` vectors, of which ``sample`` (unit rows) is one, that see a pair at ``least`` with the recall asked for.

    A pair agrees in j signs with a chance of p ** j. It is seen where the rows that agree in as many signs with one of it are no
    more than half a window; how many do, and so j, is read off the sample for each of its rows, and the recall is the mean over them.
    Rows that a row is linked with do not count as its crowd. A recall that MOST_PASSES do not reach is an error, never lowered.
    """
    c = sample - centre
    size = np.sqrt((c * c).sum(axis=1))
    size[size == 0] = 1.0
    same = 1 - np.arccos(np.clip((c @ c.T) / np.outer(size, size), -1, 1)) / np.pi
    same[sample @ sample.T >= least] = 0.0
    p = 1 - np.arccos(np.clip((least - 2 * sample @ centre + centre @ centre) / size**2, -1, 1)) / np.pi
    j, crowd = np.full(len(sample), HASH_BITS), np.ones_like(same)
    for k in range(HASH_BITS):
        j = np.where((j == HASH_BITS) & (n * crowd.sum(axis=1) / len(sample) <= window / 2), k, j)
        crowd = crowd * same
    missed = np.log1p(-np.minimum(p**j, 1 - 1e-12))
    if 1 - np.exp(missed * MOST_PASSES).mean() < recall:
        raise ValueError(f"{n} vectors of one label are too alike for a recall of {recall} in {MOST_PASSES} passes: take a wider window than {window}")
    lo, hi = 1, MOST_PASSES
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if 1 - np.exp(missed * mid).mean() >= recall else (mid + 1, hi)
    return lo


def _plan(window: int, least: float, recall: float):
    """Centre and number of passes of a label, from a sample of it."""
    def run(t: pa.Table) -> pa.Table:
        m, n = unit_rows(t.column("vec").to_pylist()), t.column("rows")[0].as_py()
        centre = m.mean(axis=0)
        return pa.table({
            "label": t.column("label").slice(0, 1), "dim": t.column("dim").slice(0, 1), "centre": pa.array([centre.tobytes()], pa.binary()),
            "passes": pa.array([passes_for(m, centre, n, window, least, recall)], pa.int32())})
    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each vector and pass of its label, with the key of the centred vector."""
    for b in batches:
        if not b.num_rows:
            continue
        labels, sizes, todo = b.column(1).to_numpy(), b.column(3).to_numpy(), b.column(5).to_numpy()
        for label, size in sorted(set(zip(labels.tolist(), sizes.tolist()))):
            at = np.flatnonzero((labels == label) & (sizes == size))
            part, passes = b.take(pa.array(at)), int(todo[at[0]])
            keys = projection_keys(unit_rows(part.column(2).to_pylist()) - np.frombuffer(part.column(4)[0].as_py(), dtype=np.float64), passes)
            for p in range(passes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), p, np.int32)), part.column(1), part.column(3), pa.array(keys[:, p]), part.column(0), part.column(2)],
                    ["pass", "label", "dim", "key", "id", "vec"])


class _Unions(dict):
    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self[max(x, y)] = min(x, y)


def _near(rows: list[tuple], window: int, least: float, seam: int | None, unions: _Unions) -> None:
    """Compares each row with the ``window`` rows after it of the same pass, label and size, and unites the pairs that pass.
    With ``seam``, only pairs that lie on both sides of it."""
    group = [r[:3] for r in rows]
    begin = 0
    for end in range(1, len(rows) + 1):
        if end < len(rows) and group[end] == group[begin]:
            continue
        m, ids = unit_rows([r[5] for r in rows[begin:end]]), [r[4] for r in rows[begin:end]]
        for o in range(1, min(window, len(ids) - 1) + 1):
            cos = np.einsum("ij,ij->i", m[:-o], m[o:])
            for i in np.flatnonzero(cos >= least):
                if seam is None or begin + i < seam <= begin + i + o:
                    unions.join(ids[i], ids[i + o])
        begin = end


def _sweep(window: int, least: float):
    """Over one sorted range: ids with their roots for united vectors, and the rows at both ends for the seams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tail: list[tuple] = []
        unions = _Unions()
        seen = 0
        head: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * len(SWEPT)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, SWEPT.values())], list(SWEPT))

        for b in batches:
            for i in range(0, b.num_rows, 4096):
                rows = list(zip(*[c.to_pylist() for c in b.slice(i, 4096).columns]))
                if seen < window:
                    head += rows[:window - seen]
                seen += len(rows)
                _near(tail + rows, window, least, None, unions)
                tail = (tail + rows)[-window:]
        yield batch([(part - 1, 1, *r, None) for r in head] + [(part, 0, *r, None) for r in tail])
        yield batch([(None, None, None, None, None, None, x, None, unions.root(x)) for x in list(unions)])
    return run


def _seams(window: int, least: float):
    def run(t: pa.Table) -> pa.Table:
        rows = list(zip(*[t.column(c).to_pylist() for c in ("pass", "label", "dim", "key", "id", "vec", "side")]))
        rows.sort(key=lambda r: (r[6], *r[:5]))
        unions = _Unions()
        _near([r[:6] for r in rows], window, least, sum(r[6] == 0 for r in rows), unions)
        linked = [(x, unions.root(x)) for x in list(unions)]
        return pa.table({"id": pa.array([x for x, _ in linked], pa.int64()), "root": pa.array([r for _, r in linked], pa.int64())})
    return run


def _count(least: float):
    """Links between two blocks of a component (or within one): per vector, the copies of the classes it links with."""
    def run(t: pa.Table) -> pa.Table:
        side, ids = np.array(t.column("side").to_pylist()), np.array(t.column("id").to_pylist(), dtype=np.int64)
        copies, blobs = np.array(t.column("copies").to_pylist(), dtype=np.int64), t.column("vec").to_pylist()
        dims = np.array([len(x) for x in blobs])
        total = np.zeros(len(ids), dtype=np.int64)
        for d in np.unique(dims):
            left, right = np.flatnonzero((side == 0) & (dims == d)), np.flatnonzero((side == 1) & (dims == d))
            if not len(left):
                continue
            m = unit_rows([blobs[i] for i in left])
            if len(right):
                hit = m @ unit_rows([blobs[i] for i in right]).T >= least
                total[left] += hit @ copies[right]
                total[right] += copies[left] @ hit
            elif not (side == 1).any():
                hit = m @ m.T >= least
                np.fill_diagonal(hit, False)
                total[left] += hit @ copies[left]
        return pa.table({"id": pa.array(ids), "n": pa.array(total)})
    return run


def near_duplicates(
    df: DataFrame, least: float = 0.93, recall: float = 0.9995, window: int = 32, block: int = 512,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id`` (smallest id that links reach), ``kept``.

    Vectors of one label whose cosine (in doubles) is at least ``least`` are linked. Equal vectors are one class. A pass
    orders the classes of a label by the concatenated signs of the centred vectors on random directions, and compares each with the
    ``window`` classes after it; ranges are sorted apart, and the seams between them are compared too. A label has as many passes
    as its size and a sample of it say the ``recall`` of a pair at the threshold takes (``passes_for``), whatever its size; where a label has
    fewer classes than half a window one pass sees every pair. Verified pairs are united, so a pair that no pass sees is lost
    only where no other links connect its ends. Links are then counted exactly inside each component, block by block.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null label, link with nothing;
    so do vectors of different length. Rows with a null id are never linked (``component_id`` null, kept). Repeated rows
    count as further vectors; other columns are not read; an empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    tidy = cut(rows.mapInArrow(_tidy, "vec_id long, label long, vec binary").withColumn("class", F.sha2("vec", 256)))
    usable = tidy.filter("vec_id is not null and label is not null and vec is not null")
    classes = cut(usable.groupBy("label", "class").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")))
    firsts = cut(usable.join(classes.withColumnRenamed("first", "vec_id"), ["label", "class", "vec_id"])
                 .groupBy("label", "class", "vec_id").agg(F.first("vec").alias("vec"), F.first("copies").alias("copies")))

    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sized = firsts.select(F.col("vec_id").alias("id"), "label", "vec", (F.octet_length("vec") / 8).cast("int").alias("dim"))
    rows_of = cut(sized.groupBy("label", "dim").agg(F.count("*").alias("rows")))
    some = sized.join(rows_of, ["label", "dim"]).filter(F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.col("rows")) < SAMPLE)
    plan = cut(some.groupBy("label", "dim").applyInArrow(_plan(window, least, recall), "label long, dim int, centre binary, passes int"))

    hashed = sized.join(plan, ["label", "dim"]).select("id", "label", "vec", "dim", "centre", "passes").mapInArrow(
        _hashed, "pass int, label long, dim int, key long, id long, vec binary")
    order = ["pass", "label", "dim", "key", "id"]
    swept = cut(hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        _sweep(window, least), "seam int, side int, pass int, label long, dim int, key long, id long, vec binary, root long"))
    seams = swept.filter("root is null and seam >= 0")  # ranges are numbered in order: a tail and the next head share a seam
    seam_links = seams.groupBy("seam").applyInArrow(_seams(window, least), "id long, root long")
    links = swept.filter("root is not null").select("id", "root").unionByName(seam_links)
    groups = cut(components(links, "id", "root"))

    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    members = groups.join(sizes, "component").join(firsts.select(F.col("vec_id").alias("id"), "vec", "copies"), "id")
    blocks = F.greatest(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(SEED)), blocks).cast("int")
    placed = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select(
        "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "copies", "vec")
    counted = placed.groupBy("component", "i", "j").applyInArrow(_count(least), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))

    found = classes.join(groups.withColumnRenamed("id", "first"), "first", "left").join(counted.withColumnRenamed("id", "first"), "first", "left")
    found = cut(found.select("label", "class", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id")))
    linked = usable.join(found, ["label", "class"]).select("vec_id", "n_links", "component_id")
    alone = tidy.filter("vec_id is null or label is null or vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
