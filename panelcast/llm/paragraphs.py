"""Substring dedup by paragraphs: MinHash bands find paragraphs to compare, exact Jaccard links them, components say what goes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm import shingles
from panelcast.llm.neardup import HammingJoin, _confirm, meetings
from panelcast.llm.shingles import LOWER, P1, P2, P3, mixed
from panelcast.session import cut

PASSAGE, PARAGRAPH = 0, 1
REACH = 4  # words on either side that a cut inside a paragraph depends on
BATCH_BYTES = 4_000_000
SEED = 4_409
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def recall(similarity: float, bands: int, rows: int) -> float:
    return 1 - (1 - similarity ** rows) ** bands


def tune(similarity: float = 0.8, least_recall: float = 0.999, most_bands: int = 10) -> tuple[int, int]:
    """(bands, rows): as many rows as a pair at the threshold allows - so that few other pairs collide - with the recall asked for."""
    best = None
    for rows in range(1, 33):
        bands = next((b for b in range(1, most_bands + 1) if recall(similarity, b, rows) >= least_recall), None)
        if bands is None:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall with so few bands")
    return best


class Words:
    """The words of some texts: where they stand (in bytes), which text and line they belong to, and their hashes."""

    def __init__(self, texts: list[bytes]):
        b = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        space = SPACES[b]
        start = np.flatnonzero(~space & np.append(True, space[:-1]))
        end = np.flatnonzero(~space & np.append(space[1:], True)) + 1
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.text = np.searchsorted(begin, start, side="right") - 1
        self.start, self.end = start - begin[self.text], end - begin[self.text]
        self.line = np.cumsum(b == 10)[start]  # the mark between texts is a line break, too
        n = end - start
        low = np.frombuffer(b.tobytes().translate(LOWER), dtype=np.uint8)[~space].astype(np.uint64)
        first = np.cumsum(n) - n
        place = (np.arange(len(low)) - np.repeat(first, n)).astype(np.uint64)
        self.hash = mixed(np.add.reduceat(mixed((low + np.uint64(1)) * P1 + place * P2), first)) if len(n) else np.zeros(0, np.uint64)

    def line_starts(self) -> np.ndarray:
        return np.flatnonzero(np.append(True, self.line[1:] != self.line[:-1])[:len(self.line)])

    def passage_starts(self) -> np.ndarray:
        """Starts of lines, and inside them the words before which pairs of words hash lowest within REACH on either side."""
        lines = self.line_starts()
        n = len(self.hash)
        if n < 2 * REACH + 2:
            return lines
        pair = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
        pair[1:] = mixed(self.hash[:-1] * P2 + self.hash[1:])
        around = np.lib.stride_tricks.sliding_window_view(pair, 2 * REACH + 1)
        middle = np.arange(REACH, n - REACH)
        lowest = (around.argmin(axis=1) == REACH) & (self.line[middle - REACH] == self.line[middle + REACH]) & (middle - REACH > 0)
        lowest &= self.line[np.maximum(middle - REACH - 1, 0)] == self.line[middle]
        return np.union1d(lines, middle[lowest])

    def names(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each run of words."""
        n = np.diff(np.append(starts, len(self.hash)))
        place = (np.arange(len(self.hash)) - np.repeat(starts, n)).astype(np.uint64)
        one = np.add.reduceat(mixed(self.hash * P1 + place * P3), starts)
        two = np.add.reduceat(mixed((self.hash ^ P2) * P3 + place * P1 + np.uint64(1)), starts)
        return mixed(one + n.astype(np.uint64)).view(np.int64), mixed(two ^ n.astype(np.uint64)).view(np.int64)

    def band_keys(self, starts: np.ndarray, ends: np.ndarray, k: int, bands: int, rows: int) -> np.ndarray:
        """(paragraphs, bands) keys: a mix of the least shingle values of a band; for paragraphs of k words or more."""
        s = np.full(max(0, len(self.hash) - k + 1), np.uint64(k), dtype=np.uint64)
        for j in range(k):
            s = mixed(s * P2 + self.hash[j:len(self.hash) - k + 1 + j])
        edge = np.stack([starts, ends - k + 1], axis=1).ravel()
        if len(edge) and edge[-1] >= len(s):
            edge = edge[:-1]
        a, b = shingles.permutations(bands * rows, SEED)
        out = np.repeat((np.arange(1, bands + 1, dtype=np.uint64) * P1)[None, :], len(starts), axis=0)
        for i in range(bands * rows):
            least = np.minimum.reduceat(s * a[i] + b[i], edge)[::2]
            out[:, i // rows] = mixed(out[:, i // rows] * P2 + mixed(least))
        return out


def _units(k: int, bands: int, rows: int, least_line: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(row, ids, texts) -> Iterator[pa.RecordBatch]:
            w = Words(texts)
            if not len(w.hash):
                return
            for kind, starts in ((PASSAGE, w.passage_starts()), (PARAGRAPH, w.line_starts())):
                one, two = w.names(starts)
                ends = np.append(starts[1:], len(w.hash))
                if kind == PARAGRAPH:
                    long = ends - starts >= max(least_line, k)
                    starts, ends, one, two = starts[long], ends[long], one[long], two[long]
                    if not len(starts):
                        continue
                    keys = w.band_keys(starts, ends, k, bands, rows).astype("<u8").tobytes()
                    size = 8 * bands
                    keys = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.arange(0, len(keys) + 1, size, dtype=np.int32)), pa.py_buffer(keys)])
                else:
                    keys = pa.nulls(len(starts), pa.binary())
                own = w.text[starts]
                base = np.searchsorted(w.text, np.arange(len(texts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), kind, np.int32)), pa.array(one), pa.array(two), pa.array(row[own]), pa.array(ids[own]),
                     pa.array((starts - base[own]).astype(np.int32)), pa.array((ends - starts).astype(np.int32)),
                     pa.array(w.start[starts]), pa.array(w.end[ends - 1]), keys],
                    ["kind", "one", "two", "row", "doc_id", "word", "words", "start", "end", "bands"])

        for b in batches:
            row, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts, lo, held = [], 0, 0
            for i, t in enumerate(b.column(2)):
                texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held > BATCH_BYTES or i == b.num_rows - 1:
                    yield from out(row[lo:], ids[lo:], texts)
                    texts, lo, held = [], i + 1, 0
    return run


def _file(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<i8")
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column(0).to_numpy(), bands))], ["key", "id"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts, compressed for the way to the lines that are wanted of them."""
    press = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        texts = [press((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], ["doc_id", "text"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words, compressed, of the lines wanted of each text (``id``, ``one``, ``two``, ``start``, ``end``). A line counts if the two
    hashes that name it fit, as texts with equal ids may differ."""
    press, open_ = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress

    def out(cuts: list[bytes], wanted: list[pa.StructArray]) -> pa.RecordBatch:
        ids, one, two = (np.concatenate([x.field(f).to_numpy() for x in wanted]) for f in ("id", "one", "two"))
        w = Words(cuts)
        starts = w.line_starts()
        ends = np.append(starts[1:], len(w.hash))[:len(starts)]
        own = w.text[starts]
        if len(starts):
            names = w.names(starts)
            fits = (names[0] == one[own]) & (names[1] == two[own])
            starts, ends, own = starts[fits], ends[fits], own[fits]
        where = zip(own.tolist(), w.start[starts].tolist(), w.end[ends - 1].tolist())
        packed = [press(b" ".join(cuts[c][lo:hi].translate(LOWER).split())) for c, lo, hi in where]
        return pa.RecordBatch.from_arrays([pa.array(ids[own], pa.int64()), pa.array(packed, pa.binary())], ["id", "words"])

    for b in batches:
        cuts, wanted, held = [], [], 0
        for i, (text, lines) in enumerate(zip(b.column(0), b.column(1))):
            t = open_(text.as_py())
            wanted.append(lines.values)
            for lo, hi in zip(lines.values.field("start").to_numpy().tolist(), lines.values.field("end").to_numpy().tolist()):
                cuts.append(t[lo:hi])
                held += hi - lo
            if held > BATCH_BYTES or i == b.num_rows - 1:
                yield out(cuts, wanted)
                cuts, wanted, held = [], [], 0


def repeats(
    df: DataFrame, k: int = 5, percent: int = 80, least_words: int = 20, least_line: int = 5, least_recall: float = 0.999,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(``doc_id``, ``start``, ``end``, ``n_words``, ``kept_doc_id``, ``kept_start``, ``kept_doc_ids``): stretches to remove from
    each document, in bytes of its UTF-8 text, ends exclusive, where the copy of its beginning stays, and all documents that
    keep a copy of some part.

    Paragraphs are lines of ``least_line`` words (and ``k``) or more. Those that collide in a band (``tune``) are compared: sets of k-word
    shingles with 100 * intersection >= percent * union are linked, and of each component the first paragraph (by document and
    place) stays. Repeats may begin or end inside a line; so lines are also cut into passages at places that depend on the
    words around them only, and of equal passages the first stays. What goes is joined into stretches; stretches of fewer than
    ``least_words`` words without a whole paragraph stay, as common phrases and lines of a few words do.

    Equal paragraphs are one class, found by a 128-bit hash with map-side aggregation; only one of each class is searched.
    Only lines that meet another in a band are cut out of the texts. What the pivots of a bucket leave meets by blocks; close pairs are confirmed and united inside the task (``meetings``). Null and empty texts hold no paragraph; rows without an id are left
    alone; repeated rows are documents of their own (of equal ones all but one lose their paragraphs); other columns are not read;
    no rows give no rows.
    """
    bands, rows = tune(percent / 100, least_recall)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    schema = "kind int, one long, two long, row long, doc_id long, word int, words int, start long, end long, bands binary"
    units = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_units(k, bands, rows, least_line), schema))
    name = ["one", "two"]
    place = F.struct("doc_id", "row", "start")

    several = cut(units.groupBy("kind", *name).agg(F.min(place).alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    lines = units.filter(F.col("kind") == PARAGRAPH).drop("kind")
    line_classes = several.filter(F.col("kind") == PARAGRAPH).drop("kind")
    first = lines.join(line_classes, name, "left").filter(F.col("kept").isNull() | (F.col("kept") == place))
    first = cut(first.select(F.monotonically_increasing_id().alias("id"), *name, place.alias("place"), "end", "bands"))

    def confirm(pairs: DataFrame) -> DataFrame:
        b = pairs.join(packed.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
        both = b.join(packed.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
        return both.select("a", "b", "wa", "wb").mapInArrow(_confirm(k, percent), "a long, b long")

    def meet(here: DataFrame) -> DataFrame:
        return meetings(here, packed, k, percent, indexed=False)

    join = HammingJoin(first.select("id", "bands").mapInArrow(_file(bands), "key long, id long"), confirm, meet)
    needed = first.select("id", *name, F.col("place.doc_id").alias("doc_id"), F.col("place.start").alias("start"), "end")
    wanted = needed.join(join.members(), "id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("id", *name, "start", "end")).alias("lines"))
    texts = docs.mapInArrow(_pack, "doc_id long, text binary").join(wanted, "doc_id").select("text", "lines")
    packed = cut(texts.mapInArrow(_lines, "id long, words binary").groupBy("id").agg(F.first("words").alias("words")))
    groups = join.components()

    linked = cut(first.join(groups, "id").select(*name, "place", "component"))
    stays = linked.groupBy("component").agg(F.min("place").alias("kept"))
    near = linked.join(stays, "component").select(*name, "kept")
    equal = several.join(near.select(F.lit(PARAGRAPH).alias("kind"), *name), ["kind", *name], "left_anti")
    told = cut(equal.select("kind", *name, "kept").unionByName(near.select(F.lit(PARAGRAPH).alias("kind"), *name, "kept")))

    goes = units.drop("bands").join(told, ["kind", *name]).filter(place != F.col("kept"))
    so_far = Window.partitionBy("row").orderBy("word", F.col("words").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("row").orderBy("word", F.col("words").desc()).rowsBetween(Window.unboundedPreceding, 0)
    apart = F.coalesce(F.col("word") > F.max(F.col("word") + F.col("words")).over(so_far), F.lit(True))
    runs = goes.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(whole)).groupBy("row", "run").agg(
        F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"),
        (F.max(F.col("word") + F.col("words")) - F.min("word")).cast("long").alias("n_words"), F.min(F.struct("word", "kept")).alias("head"),
        F.max(F.col("kind") == PARAGRAPH).alias("whole_line"),
        F.sort_array(F.collect_set("kept.doc_id")).alias("kept_doc_ids"))
    return runs.filter((F.col("n_words") >= least_words) | F.col("whole_line")).select(
        "doc_id", "start", "end", "n_words", F.col("head.kept.doc_id").alias("kept_doc_id"), F.col("head.kept.start").alias("kept_start"), "kept_doc_ids")
