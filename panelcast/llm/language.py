"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 14  # hashed n-grams
LENGTHS = (1, 2, 3, 4)  # of n-grams, in bytes of words in lower case with a space on either side
BLOCK = 1 << 20  # bytes of a text whose n-grams are held at a time
LANGUAGES_HELD = 256  # whose counts a task sums up before it puts them out
letter = regex.compile(r"\p{L}").search
APART = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))
MIX = np.uint32(0x9E3779B1)
UNKNOWN = "und"


def code_table(classes: int) -> np.ndarray:
    """(classes, bits) of +1 and -1: rows 1, 2, ... of the least Walsh-Hadamard matrix with more rows than classes, without
    columns that are constant. Two codewords of a matrix of order N differ in N / 2 places, whatever the number of classes."""
    order = 1
    while order <= classes:
        order *= 2
    rows, columns = np.arange(1, classes + 1)[:, None], np.arange(1, order)[None, :]
    ones = np.zeros((classes, max(0, order - 1)), dtype=np.int64)
    both = rows & columns
    while both.any():
        ones += both & 1
        both = both >> 1
    table = 1 - 2 * (ones & 1)
    return table[:, (table != table[:1]).any(axis=0)].astype(np.float64)


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    counts = np.zeros(FEATURES, dtype=np.int64)
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(APART).split()) + b" "
    longest = max(LENGTHS)
    for lo in range(0, len(raw), BLOCK):
        b = np.frombuffer(raw[lo:lo + BLOCK + longest - 1], dtype=np.uint8).astype(np.uint32)
        starts = min(BLOCK, len(raw) - lo)
        gram = np.zeros(len(b), dtype=np.uint32)
        for n in range(1, longest + 1):
            size = len(b) - n + 1
            if size <= 0:
                break
            gram = (gram[:size] << np.uint32(8)) | b[n - 1:]
            if n in LENGTHS:
                h = ((gram[:starts] + np.uint32(n)) * MIX) >> np.uint32(32 - 14)
                counts += np.bincount(h, minlength=FEATURES)
    return counts


def profile(text: str) -> np.ndarray:
    """Logarithmic counts, of length 1."""
    x = np.log1p(gram_counts(text).astype(np.float64))
    return x / max(1e-12, float(np.sqrt(x @ x)))


class Decoder:
    """Binary classifiers, one a bit, and the codewords they are read against."""

    def __init__(self, names: list[str], weights: np.ndarray, offsets: np.ndarray, trust: np.ndarray, sharpness: float):
        self.names, self.weights, self.offsets, self.sharpness = names, weights, offsets, sharpness
        self.code = code_table(len(names))
        self.trust = trust

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.offsets

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Of each codeword: the exponential loss of each bit's margin, weighted by how far that bit is to be trusted for it."""
        return (self.trust * np.exp(-np.clip(self.code * margins, -8, 8))).sum(axis=1)

    def read(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and how much nearer its codeword is than the second one (of their sum)."""
        if text is None or not self.names or not letter(text):
            return UNKNOWN, 0.0, 0.0
        if len(self.names) == 1:
            return self.names[0], 1.0, 1.0
        loss = self.losses(self.margins(profile(text)))
        best, second = np.argsort(loss, kind="stable")[:2]
        near = np.exp(-self.sharpness * (loss - loss[best]))
        return self.names[best], round(float(1 / near.sum()), 9), round(float((loss[second] - loss[best]) / (loss[second] + loss[best])), 9)


def _language_counts(rows: DataFrame) -> DataFrame:
    """(``lang``, ``f``, ``n``): in how many learning documents of a language each n-gram occurs; f = -1: how many there are."""

    def told(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(np.where(at == FEATURES, -1, at)), pa.array(held[at])], ["lang", "f", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            if len(sums) > LANGUAGES_HELD:
                yield from told(sums)
                sums = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if letter(text):
                    held = sums.setdefault(lang, np.zeros(FEATURES + 1, dtype=np.int64))
                    held[:-1] += gram_counts(text) > 0
                    held[-1] += 1
        yield from told(sums)

    return rows.mapInArrow(run, "lang string, f long, n long").groupBy("lang", "f").agg(F.sum("n").alias("n"))


def _sample(rows: DataFrame, share: dict[str, float], weights: np.ndarray, seed: int) -> list[tuple[str, list[float]]]:
    """Raw margins of a hash sample of learning documents, of about equal size for every language."""
    spark = rows.sparkSession
    chosen = spark.createDataFrame([(k, int(v * (1 << 31))) for k, v in share.items()], "name string, below long")
    few = rows.join(F.broadcast(chosen), F.col("lang") == F.col("name")).filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 31)) < F.col("below"))
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [(lang, (profile(t) @ shared.value).tolist()) for lang, x in zip(b.column(0).to_pylist(), b.column(1)) if letter(t := x.as_py())]
            langs, margins = zip(*told) if told else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(margins, pa.list_(pa.float64()))], ["lang", "margins"])

    got = few.select("lang", "text").mapInArrow(run, "lang string, margins array<double>").collect()
    return sorted((r["lang"], r["margins"]) for r in got)


def fit(rows: DataFrame, per_language: int, seed: int, sharpness: float) -> Decoder:
    """Counts over all learning documents give each bit's classifier; a sample tells its scale and its trust for each language."""
    totals: dict[str, int] = {}
    held: dict[str, np.ndarray] = {}
    for r in _language_counts(rows).collect():  # languages x FEATURES rows at most
        if r["f"] < 0:
            totals[r["lang"]] = r["n"]
        else:
            held.setdefault(r["lang"], np.zeros(FEATURES))[r["f"]] = r["n"]
    names = sorted(totals)
    if len(names) < 2:
        return Decoder(names, np.zeros((FEATURES, 0)), np.zeros(0), np.zeros((len(names), 0)), sharpness)
    code = code_table(len(names))
    share = np.stack([(held.get(k, np.zeros(FEATURES)) + 0.5) / (totals[k] + 1) for k in names])
    # The logarithm of a group's mean share: languages count alike, however many documents they have.
    weights = np.stack([
        np.log(share[code[:, j] > 0].mean(axis=0)) - np.log(share[code[:, j] < 0].mean(axis=0)) for j in range(code.shape[1])], axis=1)
    found = _sample(rows, {k: min(1.0, per_language / totals[k]) for k in names}, weights, seed)
    own = np.array([names.index(lang) for lang, _ in found], dtype=np.int64)
    raw = np.array([m for _, m in found], dtype=np.float64).reshape(len(found), code.shape[1])
    present = sorted(set(own.tolist()))
    if not present:
        present, own, raw = [0], np.zeros(1, dtype=np.int64), np.zeros((1, code.shape[1]))
    centre = np.stack([raw[own == c].mean(axis=0) for c in present])
    offsets, scale = np.zeros(code.shape[1]), np.ones(code.shape[1])
    for j in range(code.shape[1]):
        up, down = centre[code[present, j] > 0, j], centre[code[present, j] < 0, j]
        if len(up) and len(down) and up.min() > down.max():  # halfway between the nearest languages of the two groups
            offsets[j], scale[j] = -(up.min() + down.max()) / 2, (up.min() - down.max()) / 2
        elif len(up) and len(down):
            offsets[j], scale[j] = -(up.mean() + down.mean()) / 2, max(1e-9, float(raw[:, j].std()))
    weights, offsets = weights / scale, offsets / scale
    right = ((raw / scale + offsets) * code[own] > 0).astype(np.float64)
    hits = np.stack([(right[own == c].sum(axis=0) + 1) / ((own == c).sum() + 2) for c in range(len(names))])
    return Decoder(names, weights, offsets, hits / hits.sum(axis=1, keepdims=True), sharpness)


def identify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2,
    per_language: int = 1_000, sharpness: float = 4.0, least_gap: float = 0.1, seed: int = 12,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (0 to 1), ``gap`` (how much nearer the chosen codeword is
    than the second, 0 to 1) and ``ambiguous`` (the gap is below ``least_gap``).

    Every language gets a codeword (``code_table``), every bit a classifier of hashed character n-grams: log ratios between the languages
    that have the bit and those that have not, of the shares of documents with the n-gram, counted over all learning documents.
    A text's margins are read against all codewords: each bit's exponential loss is weighted by how often that bit was right for that
    language, and the codeword of least loss wins.

    Learning documents have a language, a text with a letter and an id with crc32(id as text) mod ``folds`` <> ``held_fold``. The scale and
    trust of the bits come from about ``per_language`` of them for each language, by a hash of the id: that and the counts
    (languages x FEATURES) are all that the driver and the broadcast hold. Only the text enters a prediction.

    Texts that are null, empty or without a letter are ``und``, score 0 and ambiguous, as is everything where no language was
    learned; with one learned language it is always that. A null id is not held out and teaches nothing. Of equally near codewords the
    language that sorts first wins. Repeated rows get equal results; other columns are not read; no rows give no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))
    learning = docs.filter(F.col("doc_id").isNotNull() & ~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", "doc_id")
    model = df.sparkSession.sparkContext.broadcast(fit(learning, per_language, seed, sharpness))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, gaps = zip(*(model.value.read(t.as_py()) for t in b.column(1))) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gaps, pa.float64())], ["doc_id", "lang_pred", "score", "gap"])

    read = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, gap double")
    return read.select("doc_id", held.alias("held_out"), "lang_pred", "score", "gap", (F.col("gap") < least_gap).alias("ambiguous"))
