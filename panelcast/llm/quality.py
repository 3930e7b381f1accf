"""Quality scores by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut

FEATURES = 1 << 14  # half for words in lower case, half for their outlines
KEPT = 500_000


def _shape(word: bytes) -> bytes:
    """The word's outline: runs of small letters, capitals, digits, bytes beyond ASCII, and its marks as they are."""
    out = bytearray()
    for c in word:
        k = 97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
        if not out or out[-1] != k:
            out.append(k)
    return bytes(out[:12])


class TermIndex(dict):
    """word -> its two feature numbers in one integer: the word in lower case, and its outline."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        half = FEATURES // 2
        got = self[word] = xxhash.xxh3_64_intdigest(word.lower()) % half << 32 | half + xxhash.xxh3_64_intdigest(_shape(word)) % half
        return got


def term_counts(text: str | None, index: TermIndex) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a whole text and how often each occurs."""
    ws = (text or "").encode("utf-8", "surrogatepass").split()
    both = np.fromiter(map(index.__getitem__, ws), dtype=np.int64, count=len(ws))
    counts = np.bincount(np.concatenate([both >> 32, both & 0xFFFFFFFF]), minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float32)


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


class Space:
    """Term weights and the projection to the latent dimensions; bounded by FEATURES x dimensions."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray):
        self.idf, self.axes = idf, axes

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(self.axes.shape[1], np.float32)
        x = weights(counts) * self.idf[at]
        v = (x / max(1e-9, float(np.sqrt(x @ x)))) @ self.axes[at]
        return v / max(1e-9, float(np.sqrt(v @ v)))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many documents each feature occurs, over all documents: a task sums its own, then features are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, df, n = TermIndex(), np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df[term_counts(t, index)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["f", "n"])

    rows = docs.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(FEATURES), 0
    for r in rows:  # FEATURES + 1 rows at most
        if r["f"] < 0:
            total = r["n"]
        else:
            df[r["f"]] = r["n"]
    return np.log((1 + total) / (1 + df)) + 1


def fit_space(rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, dimensions: int, seed: int) -> Space:
    """Truncated singular vectors of the weighted term matrix, by randomised subspace iteration over its sparse rows."""
    rng = np.random.default_rng(seed)
    docs = [(at, (x := weights(c) * idf[at]) / max(1e-9, float(np.sqrt(x @ x)))) for at, c in rows if len(at)]
    width = dimensions + 16
    q = rng.standard_normal((FEATURES, width)).astype(np.float32)
    for _ in range(4):
        y = np.zeros((FEATURES, width), np.float32)
        for at, x in docs:
            y[at] += np.outer(x, x @ q[at])
        q, _ = np.linalg.qr(y)
    b = np.stack([x @ q[at] for at, x in docs]) if docs else np.zeros((1, width), np.float32)
    _, _, vt = np.linalg.svd(b, full_matrices=False)
    return Space(idf.astype(np.float32), (q @ vt[:dimensions].T).astype(np.float32))


def nearest(cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k columns of greatest value in each row, and the values, rounded at nine decimals; the lower column first among equals."""
    least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None]
    row, column = np.nonzero(cos >= least - 2e-9)  # all that rounding can bring among the first k
    value = np.round(cos[row, column], 9)
    order = np.lexsort((column, -value, row))
    begin = np.searchsorted(row, np.arange(len(cos)))
    order = order[np.arange(len(row)) - begin[row] < k].reshape(len(cos), k)
    return column[order], value[order]


def _vote(labelled: np.ndarray, good: np.ndarray, prior: float, neighbours: int, sharpness: float, block: int):
    """Exact cosines of a block of documents with all labelled vectors, in doubles and rounded at nine decimals so that they do not
    depend on the block; the nearest vote, weighted by similarity."""
    k, across = min(neighbours, len(labelled)), labelled.T.astype(np.float64)

    def score(vectors: np.ndarray) -> np.ndarray:
        out = np.full(len(vectors), prior)
        if not k:
            return out
        for i in range(0, len(vectors), block):
            near, cos = nearest(vectors[i:i + block].astype(np.float64) @ across, k)
            w = np.maximum(cos, 0) ** sharpness
            total = w.sum(axis=1)
            votes = (w * good[near]).sum(axis=1)
            out[i:i + block] = np.where(total > 0, np.round((votes + 0.5 * prior) / (total + 0.5), 9), prior)
        return out
    return score


def score(
    df: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
    max_labelled: int = 8_000, dimensions: int = 48, neighbours: int = 15, sharpness: float = 4.0, seed: int = 5,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted``, and the
    columns named in ``keep``.

    Documents become vectors of hashed words and word outlines, weighted by term and document frequency (counted over all
    documents) and projected on the leading singular directions of the labelled ones. Each document is multiplied with every
    labelled vector, in blocks; the nearest vote with their similarity (of equally near ones those that come first in the order of
    their terms). Only the text enters a score; equal texts have equal scores.

    Labels are learned from ids with crc32(id as text) mod 5 <> 0. At most about ``max_labelled`` labelled documents (by a hash of
    the id) are used: the bound of what the driver and a broadcast hold. Every other step covers all rows.

    Null and empty texts have no term and get the share of label 1 among the labelled. Without any usable label every score
    is 0.5. A null id is not held out and carries no label. Labels that are null or contradict each other for an id are left
    out. Repeated rows are scored each for itself; an empty table gives an empty result.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c) for c in keep if c != text_col])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
             .filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", "quality"))
    # The chosen ids: a hash threshold that leaves about max_labelled of them, whatever the size of the table.
    n = known.count()
    if n > max_labelled:
        share = int(max_labelled / n * (1 << 31))
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 31)) < share)
    chosen = spark.sparkContext.broadcast({r["doc_id"]: r["quality"] for r in known.collect()})

    def labelled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TermIndex()
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                if i in chosen.value:
                    at, c = term_counts(t.as_py(), index)
                    out.append((chosen.value[i], at.astype("<i4").tobytes(), c.astype("<f4").tobytes()))
            q, a, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(a, pa.binary()), pa.array(c, pa.binary())], ["q", "at", "c"])

    idf = document_frequencies(docs)
    rows = docs.select("doc_id", "text").mapInArrow(labelled_terms, "q int, at binary, c binary").collect() if n else []
    rows.sort(key=lambda r: (r["at"], r["c"], r["q"]))
    terms = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["c"], "<f4")) for r in rows]
    good = np.array([r["q"] for r in rows], dtype=np.float64)
    space = fit_space(terms, idf, dimensions, seed)
    vectors = np.array([space.vector(*t) for t in terms], dtype=np.float32).reshape(len(terms), dimensions)
    model = spark.sparkContext.broadcast((space, vectors, good, float(good.mean()) if len(good) else 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, vectors, good, prior = model.value
        vote, index = _vote(vectors, good, prior, neighbours, sharpness, block=256), TermIndex()
        for b in batches:
            mine = [space.vector(*term_counts(t.as_py(), index)) for t in b.column(1)]
            scores = vote(np.array(mine, dtype=np.float32).reshape(len(mine), space.axes.shape[1]))
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], [*names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    scored = docs.mapInArrow(run, f"{fields}, score double")
    return scored.select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
        *[F.col("text").alias(c) if c == text_col else F.col(c) for c in keep])
