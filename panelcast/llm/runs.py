"""Periodic runs of words: Lyndon arrays under both orders by grouping suffixes, their roots extended to runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES = 8_000_000  # of text, in one batch of results


def lyndon_array(symbols: list[int], descending: bool = False) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by the first phase of a grouping suffix sorter.

    All places begin in groups by symbol. Groups are taken from the highest down. A group's context (of length ``clen``) is the
    Lyndon word its members start with, and final. Each member's nearest place to the left in a lower group has a context that
    ends where the member begins, so the member's context is appended to it: those places leave their group for a new one right
    above it, those with more such members higher. No group is taken twice and a place moves at most once per member: linear
    work but for the sorting of members by place.
    """
    n = len(symbols)
    if not n:
        return []
    order = sorted(range(n), key=symbols.__getitem__, reverse=descending)
    at, group, size, clen = [0] * n, [0] * n, [0] * n, [0] * n  # the last two by a group's first slot in ``order``
    first, last = 0, None
    for slot, i in enumerate(order):
        if symbols[i] != last:
            first, last = slot, symbols[i]
            clen[first] = 1
        at[i], group[i] = slot, first
        size[first] += 1
    left = list(range(-1, n - 1))  # a place to the left; no place between it and i is in a lower group
    lyndon = [1] * n
    top = n
    while top:
        start = group[order[top - 1]]
        length = clen[start]
        counts: dict[int, int] = {}
        for i in sorted(order[start:top]) if top - start > 1 else order[start:top]:
            lyndon[i] = length
            j = left[i]
            while j >= 0 and group[j] >= start:
                j = left[j]
            left[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        top = start
        most = max(counts.values(), default=0)
        by_count: list[list[int]] = [[] for _ in range(most + 1)]
        for j, c in counts.items():
            by_count[c].append(j)
        for c in range(most, 0, -1):
            movers = by_count[c]
            if not movers:
                continue
            for j in movers:  # to the end of its group
                g = group[j]
                size[g] -= 1
                slot, mine = g + size[g], at[j]
                other = order[slot]
                order[mine], at[other] = other, mine
                order[slot], at[j] = j, slot
            moved = {g: g + size[g] for g in {group[j] for j in movers}}  # what was moved out of a group is a new one
            grown = [(new, clen[g] + c * length) for g, new in moved.items()]
            for new, context in grown:
                size[new], clen[new] = 0, context
            for j in movers:
                group[j] = moved[group[j]]
                size[group[j]] += 1
    return lyndon


def common(raw: bytes, a: int, b: int, width: int = 4) -> int:
    """How many symbols from a and from b on (a < b) are equal: blocks are compared, doubled while equal, halved at the end."""
    n = len(raw) // width - b
    done, step = 0, 8
    while done < n:
        k = min(step, n - done)
        x, y = (a + done) * width, (b + done) * width
        if raw[x:x + k * width] == raw[y:y + k * width]:
            done += k
            step *= 2
        else:
            n, step = done + k - 1, max(1, k // 2)
    return done


def runs_of(symbols: list[int], least: int, times: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of length >= max(least, times * period), times >= 2.

    A run's root is the longest Lyndon word at its place in one of the two orders; so each place offers two roots, and a
    root is extended by what it has in common with the place one period on, to both sides. A root inside the last run found
    with its period belongs to that run.
    """
    n = len(symbols)
    raw = np.array(symbols, dtype="<u4").tobytes()
    back = np.array(symbols[::-1], dtype="<u4").tobytes()
    found: set[tuple[int, int, int]] = set()
    for descending in (False, True):
        ends: dict[int, int] = {}
        for i, q in enumerate(lyndon_array(symbols, descending)):
            if i + q <= ends.get(q, 0):
                continue
            right = common(raw, i, i + q) if i + q < n and symbols[i] == symbols[i + q] else 0
            before = common(back, n - i - q, n - i) if i and symbols[i - 1] == symbols[i + q - 1] else 0
            length = before + q + right
            if length >= 2 * q:
                ends[q] = i + q + right
                if length >= max(least, times * q):
                    found.add((i - before, length, q))
    return found


def stretches(ids: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Maximal stretches covered by grams (of ``gram`` symbols) that occur more than once, by hash. A run of period q and length
    >= max(2 * gram, 2 * q) repeats a gram at every place of its first (length - q) >= gram symbols and one period on, so it lies
    in one stretch; equal hashes of different grams only make a stretch longer."""
    n = len(ids) - gram + 1
    if n < 2:
        return []
    h = np.zeros(n, dtype=np.uint64)
    wide = ids.astype(np.uint64)
    for j in range(gram):
        h = (h ^ wide[j:n + j]) * MIX
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    places = np.flatnonzero(again)
    edge = np.flatnonzero(np.diff(places) > gram) + 1
    return [(int(p[0]), int(p[-1]) + gram) for p in np.split(places, edge)]


def find_runs(words: list[bytes], least: int = 12, times: int = 2) -> list[tuple[int, int, int]]:
    """All (start, length, period), by start, then period; runs have max(``least``, ``times`` * period) words at least."""
    gram = max(1, -(-least // 2))
    if len(words) < max(least, 2):
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.uint32, count=len(words))
    if len(known) == len(words):
        return []
    out = []
    for lo, hi in stretches(ids, gram):
        _, narrow = np.unique(ids[lo:hi], return_inverse=True)
        out += [(s + lo, length, q) for s, length, q in runs_of(narrow.tolist(), least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def repeat_tail(words: list[bytes], h: int) -> list[bytes]:
    """``words``, made periodic from some place on where the last decimal digit of ``h`` is 0: place and period come from its others."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def periodic_runs(
    df: DataFrame, least: int = 12, times: int = 2, id_col: str = "doc_id", text_col: str = "text", seed_col: str | None = None, texts: bool = True,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``runs`` (array of start, length and period in words, by start, then
    period), ``collapsed_sha256`` and, unless left out, ``collapsed``: the words that no run holds after its first period,
    joined by one space.

    Words are runs of characters other than space and \\x09-\\x0D. A run is a stretch with a smallest period q that has
    max(``least``, ``times`` * q) words or more and that no neighbour extends. ``seed_col`` names a column of numbers by which
    texts are first made periodic (``repeat_tail``); null leaves a text as it is.

    It is a map over the rows without an exchange: a task holds one text at a time and at most BATCH_BYTES of results. Only
    stretches that can hold a run (``stretches``) get suffix groups, so most words cost a hash.

    Null and empty texts and texts of white space have no words and no runs; a null id stays null; repeated rows get equal
    results; a word of any length is one symbol; other columns are not read; no rows give no rows.
    """
    seed = (F.col(seed_col) if seed_col else F.lit(None)).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            ids, n, runs, sums, kept = zip(*rows)
            told = [[{"start": s, "length": length, "period": q} for s, length, q in r] for r in runs]
            cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(told, span), pa.array(sums, pa.string())]
            names = ["doc_id", "n_words", "runs", "collapsed_sha256"]
            if texts:
                cols.append(pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()))
                names.append("collapsed")
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            rows, held = [], 0
            for i, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                words = split(t.as_py())
                words = words if h is None else repeat_tail(words, h)
                runs = find_runs(words, least, times)
                kept = b" ".join(collapse(words, runs))
                rows.append((i, len(words), runs, hashlib.sha256(kept).hexdigest(), kept if texts else None))
                held += (len(kept) if texts else 0) + 64 * (1 + len(runs))
                if held > BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string" + ", collapsed string" * texts
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), seed.alias("seed")).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest (of equal ones the first, then the one of least period), and hashes of all runs and of what is kept."""
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    told = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"),
        F.col("best.period").alias("period"), F.expr("(-1000 * best.shorter) div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), "collapsed_sha256")
