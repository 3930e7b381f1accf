"""Near-duplicate documents: MinHash signatures joined under a Hamming threshold by a multi-index, links confirmed exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import shingles
from panelcast.llm.components import components
from panelcast.session import cut

# A signature has CHUNKS x WIDTH symbols of 16 bits. A pair that differs in less than 2 * CHUNKS symbols has a chunk with one
# difference at most; so each chunk is filed once per symbol left out, and such pairs meet. At a similarity of 0.8 the
# differences are binomial (40, 0.2): the chance of 20 or more is 3.6e-5, and falls fast above 0.8.
CHUNKS, WIDTH, BITS = 10, 4, 16
SEED = 20_261
FINE = 216  # further symbols, of 8 bits, that tell texts below the threshold from those above it; only for pairs left after the pivots
BLOCK, BLOCK_BYTES = 1024, 8_000_000  # members of a bucket, and bytes of their packed words, that meet another block in one task


def index_keys(sigs: np.ndarray) -> np.ndarray:
    """(n, CHUNKS * WIDTH) keys: which chunk, which symbol is left out, and the other symbols, without loss."""
    n = len(sigs)
    chunks = sigs.astype(np.int64).reshape(n, CHUNKS, WIDTH)
    out = np.empty((n, CHUNKS, WIDTH), dtype=np.int64)
    for left_out in range(WIDTH):
        key = np.arange(CHUNKS, dtype=np.int64) * WIDTH + left_out
        key = np.broadcast_to(key, (n, CHUNKS)).copy()
        for j in range(WIDTH):
            if j != left_out:
                key = (key << BITS) | chunks[:, :, j]
        out[:, :, left_out] = key
    return out.reshape(n, CHUNKS * WIDTH)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        known, perms = shingles.WordHashes(), shingles.permutations(CHUNKS * WIDTH, SEED)
        for b in batches:
            classes, sizes, sigs = [], [], []
            for t in b.column(1).to_pylist():
                ws = shingles.words(t)
                s = shingles.shingle_set(known.of(ws), k)
                sizes.append(len(s))
                classes.append(hashlib.blake2b(b" ".join(ws), digest_size=16).digest() if ws else None)
                sigs.append(shingles.minhash(s, perms, BITS).astype("<u2").tobytes() if ws else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())],
                ["doc_id", "class", "n_shingles", "sig"])
    return run


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 2048):
            part = b.slice(i, 2048)
            keys = index_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<u2").reshape(-1, CHUNKS * WIDTH))
            ids = np.repeat(part.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text, compressed: smaller than its shingles, and whole."""
    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        packed = [press.compress(b" ".join(shingles.words(t))) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["id", "words"])


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_ = shingles.WordHashes(), zstandard.ZstdDecompressor().decompress
        last: tuple = (None, None)

        def full(blob: bytes) -> np.ndarray:
            return shingles.shingle_set(known.of(open_(blob).split()), k)

        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if last[0] != x:
                    last = (x, full(x))
                keep[i] = similar(last[1], full(y), percent)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))
    return run


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Exact: 100 * intersection >= percent * union, of sets with something in common."""
    shared = len(np.intersect1d(s, t, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(s) + len(t) - shared)


def most_differences(percent: int, symbols: int) -> int:
    """Symbols in which a pair at the threshold differs, with a chance of about 1e-5 of more."""
    p = 1 - percent / 100
    return int(np.ceil(symbols * p + 4.5 * np.sqrt(symbols * p * (1 - p))))


def _fine_sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_ = shingles.WordHashes(), zstandard.ZstdDecompressor().decompress
        coarse, fine = shingles.permutations(CHUNKS * WIDTH, SEED), shingles.permutations(FINE, SEED + 1)
        for b in batches:
            sigs = []
            for blob in b.column(1).to_pylist():
                s = shingles.shingle_set(known.of(open_(blob).split()), k)
                sigs.append(shingles.minhash(s, coarse, BITS).astype("<u2").tobytes() + shingles.minhash(s, fine, 8, 2048).astype("u1").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, pa.binary()), b.column(1)], ["id", "sig", "words"])
    return run


def close_pairs(key: int | None, coarse: np.ndarray, fine: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``left`` and ``right`` of different components whose signatures are close; with a ``key`` of the multi-index, those
    pairs alone of which it is the first key that they share."""
    for r in range(0, len(left), 64):
        some = left[r:r + 64]
        apart = (coarse[some][:, None, :] != coarse[right][None, :, :]).sum(axis=2)
        x, y = np.nonzero((apart < 2 * CHUNKS) & (c[some][:, None] != c[right][None, :]))
        x, y, apart = some[x], right[y], apart[x, y]
        near = apart + (fine[x] != fine[y]).sum(axis=1) <= most
        x, y = x[near], y[near]
        if key is not None:
            equal = (coarse[x] == coarse[y]).reshape(len(x), CHUNKS, WIDTH)
            chunk = (equal.sum(axis=2) >= WIDTH - 1).argmax(axis=1)
            mine = equal[np.arange(len(x)), chunk]
            left_out = np.where(mine.all(axis=1), 0, mine.argmin(axis=1))
            first = chunk * WIDTH + left_out == key >> BITS * (WIDTH - 1)
            x, y = x[first], y[first]
        yield x, y


def uniting_links(xs: np.ndarray, ys: np.ndarray, label: np.ndarray, full, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs, similar on their full sets (``full`` by row), that unite labels; a pair whose labels agree by then is not compared.

    The shingles of all rows concerned are numbered once; a row then marks its own and counts the marks of all its partners at once.
    """
    if not len(xs):
        return
    rows, at = np.unique(np.concatenate([xs, ys]), return_inverse=True)
    label = label[rows]
    sets = [full(r) for r in rows]
    size = np.array([len(s) for s in sets])
    begin = np.cumsum(size) - size
    number = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    del sets
    mark = np.zeros(int(number.max()) + 1, dtype=bool)
    order = np.argsort(at[:len(xs)], kind="stable")
    x, y = at[:len(xs)][order], at[len(xs):][order]
    for lo, hi in zip((edges := np.flatnonzero(np.append(True, x[1:] != x[:-1]))), np.append(edges[1:], len(x))):
        one, others = x[lo], y[lo:hi]
        others = others[label[others] != label[one]]
        if not len(others):
            continue
        own = number[begin[one]:begin[one] + size[one]]
        mark[own] = True
        n = size[others]
        first = np.cumsum(n) - n
        shared = np.add.reduceat(mark[number[np.repeat(begin[others] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
        mark[own] = False
        for other in others[(shared > 0) & (100 * shared >= percent * (size[one] + n - shared))]:
            p, q = label[one], label[other]
            if p != q:
                label[label == q] = p
                yield int(rows[one]), int(rows[other])


def _meet(k: int, percent: int, most: int, indexed: bool):
    """Over rows sorted by (key, i, j): two blocks of a bucket, or one with itself, held at a time. Pairs with close signatures are
    confirmed on full sets and united at once, unless other links already connect them; what comes out is the uniting links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_ = shingles.WordHashes(), zstandard.ZstdDecompressor().decompress

        def links(t: pa.Table) -> pa.RecordBatch:
            key, i, j, side, ids, c = (t.column(n).to_numpy() for n in ("key", "i", "j", "side", "id", "c"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            coarse, fine = np.ascontiguousarray(sig[:, :-FINE]).view("<u2"), sig[:, -FINE:]
            words = t.column("words")

            def full(row: int) -> np.ndarray:
                return shingles.shingle_set(known.of(open_(words[int(row)].as_py()).split()), k)

            edges = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            a, b = [], []
            for lo, hi in zip([0, *edges], [*edges, len(ids)]):
                here = np.arange(lo, hi)
                left, right = (here, here) if i[lo] == j[lo] else (here[side[lo:hi] == 0], here[side[lo:hi] == 1])
                if not len(left):
                    continue
                xs, ys = map(np.concatenate, zip(*close_pairs(int(key[lo]) if indexed else None, coarse, fine, c, left, right, most)))
                if i[lo] == j[lo]:
                    xs, ys = xs[xs < ys], ys[xs < ys]
                for x, y in uniting_links(xs, ys, c, full, percent):
                    a.append(min(ids[x], ids[y]))
                    b.append(max(ids[x], ids[y]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held = None
        for part in batches:
            t = pa.Table.from_batches([part])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if not len(t):
                continue
            key, i, j = (t.column(n).to_numpy() for n in ("key", "i", "j"))
            last = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield links(t.slice(0, whole))
            held = t.slice(whole)
        if held is not None and len(held):
            yield links(held)
    return run


def meetings(here: DataFrame, packed: DataFrame, k: int, percent: int, indexed: bool = True) -> DataFrame:
    """(``a``, ``b``): confirmed links that unite the components of buckets' members (``key``, ``id``, ``c``).

    ``packed`` has compressed ``words`` by ``id``; the members that are left get longer signatures. A bucket is cut into blocks of BLOCK members
    and BLOCK_BYTES of words; each two blocks meet in one task, which puts out fewer links than it holds members. ``indexed``: keys are those
    of the multi-index, which tell the bucket that a pair is to be compared in; otherwise each bucket compares its own.
    """
    left = packed.join(here.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("words").alias("words"))
    sigs = cut(left.mapInArrow(_fine_sketches(k), "id long, sig binary, words binary"))
    sized = here.join(sigs.select("id", F.octet_length("words").alias("bytes")), "id")
    sizes = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(SEED)), blocks).cast("int")
    placed = here.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "c")
    dealt = placed.join(sigs, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select("key", "i", "j", "side", "id", "c", "sig", "words").mapInArrow(
        _meet(k, percent, most_differences(percent, CHUNKS * WIDTH + FINE), indexed), "a long, b long")


class HammingJoin:
    """Candidate pairs of a key table (``key``, ``id``), without writing out the pairs of a bucket.

    A bucket compares its members with one pivot, its least id; members confirmed or linked elsewhere share its component and need no
    pair of their own. Further rounds, if asked for, take other pivots of buckets whose members still lie in several components. After
    ``pivots`` rounds what is left - members of one bucket in different components, not compared yet - is given to ``meet``, which
    puts out confirmed links. So every pair of a bucket is either
    compared or already known to be connected.
    """

    def __init__(self, filed: DataFrame, confirm, meet, pivots: int = 1):
        self.confirm, self.pivots, self.meet = confirm, pivots, meet
        shared = cut(filed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("p")).filter("n > 1").select("key", "p"))
        self.filed = cut(filed.join(shared, "key"))

    def members(self) -> DataFrame:
        return self.filed.select("id").distinct()

    def _open(self, groups: DataFrame) -> DataFrame:
        """Members, with components, of the buckets that lie in several components."""
        here = cut(self.filed.join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")))
        several = here.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
        return cut(here.join(several, "key"))

    def _pairs(self, turn: int, groups: DataFrame) -> DataFrame:
        if not turn:
            return self.filed.filter("id <> p").select(F.col("p").alias("a"), F.col("id").alias("b")).distinct()
        here = self._open(groups)
        pivot = here.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("r"), "id", "c")).alias("p"))
        pairs = here.join(pivot.select("key", F.col("p.id").alias("p"), F.col("p.c").alias("pc")), "key").filter("id <> p and c <> pc")
        return pairs.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()

    def components(self) -> DataFrame:
        spark = self.filed.sparkSession
        links = tried = spark.createDataFrame([], "a long, b long")
        groups = spark.createDataFrame([], "id long, component long")
        for turn in range(self.pivots):
            fresh = self._pairs(turn, groups)
            fresh = cut(fresh.join(tried, ["a", "b"], "left_anti") if turn else fresh)
            links = cut(links.unionByName(self.confirm(fresh)))
            tried = tried.unionByName(fresh)
            groups = cut(components(links))
        here = self._open(groups)
        if not here.isEmpty():
            links = cut(links.unionByName(self.meet(here)))
            groups = cut(components(links))
        return groups


def near_duplicates(
    df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", pivots: int = 1,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links), ``kept``.

    Texts whose k-word shingle sets have 100 * intersection >= percent * union are linked. Equal word sequences are one
    class, found by hash, and only the smallest id of a class is searched for further links; so copies never become pairs.
    The other classes are filed by the multi-index, compared as ``HammingJoin`` says, and confirmed on their full sets; after
    the pivot round, members of a bucket meet by blocks on longer signatures (``meetings``), and close ones that nothing connects
    yet are confirmed and united inside the task.

    Null and empty texts and texts of white space have no shingles and link with nothing. Rows without an id are never linked
    (``component_id`` null, kept). Repeated rows come back as often as they came; an id with several texts takes the links
    of all of them. Other columns are not read; an empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = cut(docs.mapInArrow(_sketches(k), "doc_id long, class binary, n_shingles long, sig binary"))
    named = sketched.filter("doc_id is not null and class is not null")
    firsts = cut(named.groupBy("class").agg(F.min("doc_id").alias("first")))
    searched = named.join(firsts.select(F.col("first").alias("doc_id"), "class"), ["doc_id", "class"], "left_semi")
    filed = searched.select("doc_id", "sig").mapInArrow(_file, "key long, id long")

    def confirm(pairs: DataFrame) -> DataFrame:
        b = pairs.join(packed.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
        both = b.join(packed.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
        return both.select("a", "b", "wa", "wb").mapInArrow(_confirm(k, percent), "a long, b long")

    def meet(here: DataFrame) -> DataFrame:
        return meetings(here, packed, k, percent)

    join = HammingJoin(filed, confirm, meet, pivots)
    needed = cut(join.members().select(F.col("id").alias("doc_id")))
    packed = cut(docs.filter("doc_id is not null").mapInArrow(_pack, "id long, words binary").join(needed.select(F.col("doc_id").alias("id")), "id", "left_semi"))
    groups = join.components()

    rows = sketched.select("doc_id", "class", "n_shingles")
    linked = rows.filter("doc_id is not null and class is not null").join(firsts, "class")
    linked = linked.join(groups, linked["first"] == groups["id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id"))
    alone = rows.filter("doc_id is null or class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
