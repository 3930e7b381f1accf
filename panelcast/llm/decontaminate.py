"""Benchmark passages in documents, up to edits: CGK random walks turn edit distance into Hamming distance, repeated bit sampling over
item-sized windows finds candidates, exact edit distance decides."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.shingles import P2, mixed
from panelcast.session import cut

WORDS = re.compile(r"\w+").findall
BLOCK_BYTES = 8_000_000  # of items that one pass holds and broadcasts
TEXT_BYTES = 4_000_000  # of documents searched at once
STEP = 1_000_000  # shared runs held at once
WINDOWS = 8192  # embedded at once
MOST_WALKS, WORK = 16, 128  # walks, and tables of all walks together, that a length may take
WORDS_KEPT = 100_000
PAD = np.uint64(0)
SEED = 7_919


class Hashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str | None) -> np.ndarray:
        ws = WORDS((text or "").lower())
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def allowed_edits(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def least_run(n: int, edits: int) -> int:
    """Among n words with so many edits some run of this many words is untouched."""
    return max(1, -(-(n - edits) // (edits + 1)))


def grams(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the runs of q words."""
    out = np.full(max(0, len(h) - q + 1), np.uint64(q), dtype=np.uint64)
    for j in range(q):
        out = mixed(out * P2 + h[j:len(h) - q + 1 + j]) if len(out) else out
    return out


def walk_coins(n: int, walks: int, seed: int = SEED) -> np.ndarray:
    """(walks, 2 n) odd multipliers: the top bit of word x multiplier says whether a walk moves on at that step."""
    rng = np.random.default_rng([seed, n])
    return rng.integers(0, 1 << 63, (walks, 2 * n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def embed(h: np.ndarray, start: np.ndarray, stop: np.ndarray, coins: np.ndarray) -> np.ndarray:
    """(windows, steps) of one walk: at each step the word it stands on, which it leaves or not by a coin that all windows share
    for the same word and step; past the end (``stop``) it reads padding."""
    at = start.copy()
    out = np.empty((len(coins), len(start)), dtype=np.uint64)
    last = len(h) - 1
    for t, coin in enumerate(coins):
        c = np.where(at < stop, h[np.minimum(at, last)], PAD)
        out[t] = c
        at += ((c * coin) >> np.uint64(63)).astype(np.int64)
    return out.T


def sampled_keys(walked: np.ndarray, places: np.ndarray, none: int) -> np.ndarray:
    """(tables, windows): a hash of the words at each table's places of the walk; ``none`` where one of them is padding."""
    out = np.empty((len(places), len(walked)), dtype=np.uint64)
    for t, at in enumerate(places):
        key = np.full(len(walked), np.uint64(t + 1))
        for p in at:
            key = mixed(key * P2 + walked[:, p])
        key[(walked[:, at] == PAD).any(axis=1)] = none
        out[t] = key
    return out


def edited(rng: np.random.Generator, words: np.ndarray, edits: int, kind: str) -> np.ndarray:
    """``words`` with so many substitutions, insertions or deletions at random places."""
    fresh = rng.integers(1, 1 << 63, len(words) + edits, dtype=np.uint64)
    if kind == "insert":
        return np.insert(words, rng.integers(0, len(words) + 1, edits), fresh[:edits])
    at = rng.choice(len(words), min(edits, len(words)), replace=False)
    if kind == "delete":
        return np.delete(words, at)
    out = words.copy()
    out[at] = fresh[:len(at)]
    return out


KINDS = ("substitute", "insert", "delete")


@lru_cache(maxsize=512)
def sampling_for(n: int, edits: int, recall: float, trials: int = 60) -> tuple[int, int, int]:
    """(walks, tables of each, places of a table) by which a window of n words with so many edits collides with the recall asked for.

    Simulated: texts of different words with edits of each kind, followed by other words. For each walk the share of steps at
    which both agree is measured; tables and walks are added until the worst kind has the recall, with as many places as
    WORK tables allow.
    """
    rng = np.random.default_rng([SEED, n, edits])
    coins = walk_coins(n, MOST_WALKS)
    agree = np.empty((len(KINDS), trials, MOST_WALKS))
    texts = [rng.integers(1, 1 << 63, n, dtype=np.uint64) for _ in range(trials)]
    windows = [np.concatenate([edited(rng, x, edits, kind), rng.integers(1, 1 << 63, n, dtype=np.uint64)])[:n] for kind in KINDS for x in texts]
    h = np.concatenate([*texts, *windows])
    start = np.arange(len(texts) + len(windows), dtype=np.int64) * n
    for w in range(MOST_WALKS):
        both = embed(h, start, start + n, coins[w])
        for k in range(len(KINDS)):
            mine = both[trials * (k + 1):trials * (k + 2)]
            agree[k, :, w] = ((both[:trials] == mine) & (mine != PAD)).mean(axis=1)
    for places in (4, 3, 2, 1):
        for walks in range(1, MOST_WALKS + 1):
            for tables in (4, 8, 16, 32):
                if walks * tables > WORK:
                    break
                missed = ((1 - agree[:, :, :walks] ** places) ** tables).prod(axis=2).mean(axis=1).max()
                if 1 - missed >= recall:
                    return walks, tables, places
    return MOST_WALKS, WORK // MOST_WALKS, 1


def best_ends(item: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Least edit distance of the item to a stretch of the region that ends at each place (0..len)."""
    steps = np.arange(len(region) + 1)
    d = np.zeros(len(region) + 1, dtype=np.int64)
    for i, w in enumerate(item):
        nxt = np.empty_like(d)
        nxt[0] = i + 1
        np.minimum(d[:-1] + (region != w), d[1:] + 1, out=nxt[1:])
        d = np.minimum.accumulate(nxt - steps) + steps
    return d


class Tables:
    """The walks, places and hash tables of all items of one length."""

    def __init__(self, n: int, edits: int, items: list[tuple[int, np.ndarray]], recall: float):
        self.n, self.edits = n, edits
        walks, tables, places = sampling_for(n, edits, recall)
        self.coins = walk_coins(n, walks)
        rng = np.random.default_rng([SEED + 1, n])
        self.places = [np.stack([rng.choice(2 * n, min(places, 2 * n), replace=False) for _ in range(tables)]) for _ in range(walks)]
        who = np.array([k for k, _ in items])
        h = np.concatenate([x for _, x in items])
        start = np.arange(len(items), dtype=np.int64) * n
        self.tables = []
        for keys in self._keys(h, start, start + n, 0):
            order = np.argsort(keys, axis=1, kind="stable")
            self.tables.append((np.take_along_axis(keys, order, axis=1), who[order]))

    def _keys(self, h, start, stop, none: int) -> Iterator[np.ndarray]:
        for coins, places in zip(self.coins, self.places):
            yield sampled_keys(embed(h, start, stop, coins), places, none)

    def collisions(self, h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> set[tuple[int, int]]:
        """(item, start) of windows that share a key with an item."""
        out: set[tuple[int, int]] = set()
        for lo in range(0, len(start), WINDOWS):
            some = slice(lo, lo + WINDOWS)
            for (keys, who), mine in zip(self.tables, self._keys(h, start[some], np.minimum(start[some] + self.n, stop[some]), 1)):
                for t in range(len(keys)):
                    a, b = np.searchsorted(keys[t], mine[t], side="left"), np.searchsorted(keys[t], mine[t], side="right")
                    hit = np.flatnonzero(b > a)
                    n = (b - a)[hit]
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[hit], n)
                    out.update(zip(who[t][at].tolist(), np.repeat(start[some][hit], n).tolist()))
        return out


class Index:
    """A block of items: the runs of words that lead to where their windows may lie, and their hash tables by length."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float, recall: float):
        known = Hashes()
        self.items = [(i, known.of(t)) for i, t in items]
        self.edits = [allowed_edits(len(h), similarity) for _, h in self.items]
        runs: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        sizes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, (_, h) in enumerate(self.items):
            if len(h):
                q = least_run(len(h), self.edits[k])
                runs.setdefault(q, []).append((grams(h, q), len(h), self.edits[k]))
                sizes.setdefault(len(h), []).append((k, h))
        self.by_size = {n: Tables(n, allowed_edits(n, similarity), group, recall) for n, group in sizes.items()}
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.bits = {}
        for q, found in runs.items():
            g = np.concatenate([g for g, _, _ in found])
            size, at = np.repeat([n for _, n, _ in found], [len(g) for g, _, _ in found]), np.concatenate([np.arange(len(g)) for g, _, _ in found])
            order = np.argsort(g, kind="stable")
            self.runs[q] = g[order], size[order], at[order]
            self.bits[q] = np.zeros(1 << 22, dtype=bool)
            self.bits[q][g & np.uint64((1 << 22) - 1)] = True

    def search(self, h: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, end, distance) of the passages found in documents that end at ``ends`` in ``h``."""
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        found: set[tuple[int, int, int]] = set()
        for n, start in self._starts(h, begins, ends).items():
            doc = np.searchsorted(ends, start, side="right")
            hits = self.by_size[n].collisions(h, start, ends[doc])
            found.update((int(np.searchsorted(ends, at, side="right")), k, at) for k, at in hits)
        return self._verify(h, ends, found)

    def _starts(self, h: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
        """By item length: the places at which a window can lie within the distance of an item. It shares a run of words that no edit
        touched (``least_run``) with the item, and starts where the run says, give or take the edits; no other window can."""
        near: dict[int, np.ndarray] = {}
        for q, (runs, size, at) in self.runs.items():
            g = grams(h, q)
            hit = np.flatnonzero(self.bits[q][g & np.uint64((1 << 22) - 1)])
            lo, hi = np.searchsorted(runs, g[hit], side="left"), np.searchsorted(runs, g[hit], side="right")
            hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            cut = np.searchsorted(np.cumsum(n), np.arange(STEP, n.sum() + STEP, STEP)) + 1 if len(n) else []
            for a, b in zip([0, *cut], cut):  # about STEP pairs of a run here and a run of an item at a time
                m, first = n[a:b], hit[a:b]
                place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[a:b], m)
                start, length = np.repeat(first, m) - at[place], size[place]
                doc = np.searchsorted(ends, np.repeat(first, m), side="right")
                for s in np.unique(length):
                    mine, edits = length == s, self.by_size[int(s)].edits
                    count = near.setdefault(int(s), np.zeros(len(h) + 1, dtype=np.int32))
                    np.add.at(count, np.maximum(begins[doc[mine]], start[mine] - edits), 1)
                    np.add.at(count, np.maximum(begins[doc[mine]], np.minimum(ends[doc[mine]], start[mine] + edits + 1)), -1)
        return {s: np.flatnonzero(np.cumsum(count[:-1]) > 0) for s, count in near.items()}

    def _verify(self, h, ends, found) -> list[tuple[int, int, int, int, int]]:
        out = []
        regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for doc, k, start in sorted(found):
            slack, n = self.edits[k] + 2, len(self.items[k][1])
            first = int(ends[doc - 1]) if doc else 0
            a, b = max(first, start - slack), min(int(ends[doc]), start + n + slack)
            spans = regions.setdefault((doc, k), [])
            if spans and spans[-1][1] >= a:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        for (doc, k), spans in regions.items():
            item, first = self.items[k][1], int(ends[doc - 1]) if doc else 0
            for a, b in spans:
                d, taken = best_ends(item, h[a:b]), [0]
                while len(d) and (e := int(d.argmin())) >= 0 and d[e] <= self.edits[k] and e > 0:
                    free = a + max(t for t in taken if t <= e)
                    back = best_ends(item[::-1], h[free:a + e][::-1])
                    d[e] = len(item) + 1
                    if back.min() <= self.edits[k]:
                        start = a + e - int(np.flatnonzero(back == back.min())[0])
                        out.append((doc, k, start - first, a + e - first, int(back.min())))
                        taken.append(e)
                        d[max(0, start - a + 1):e + len(item) - self.edits[k]] = len(item) + 1  # what overlaps it is the same passage
        return out


def passages(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.98, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(``doc_id``, ``item_id``, ``start_word``, ``end_word``, ``distance``): stretches of a document within
    (1 - similarity) x words of the item of a benchmark item in word edits; of overlapping ones the closest.

    Words are runs of letters and digits in lower case. Windows of an item's length are looked at where they share a run
    of words with an item of that length that the allowed edits must leave untouched; no window within the distance lies elsewhere.
    Each is embedded by random walks (``embed``) and filed by words sampled from the walk; a window and an item that share
    a key meet, and edit distance decides. Walks, tables and places are simulated for each length (``sampling_for``), so that at the
    allowed distance the worst of substitutions, insertions and deletions has the ``recall``; closer passages have more.
    Items are held in blocks of ``BLOCK_BYTES``, one pass over the documents for each, whose broadcast goes after it: the item
    set is a stated query set, and neither driver nor tasks hold more than a block. There is no exchange; a task holds about
    TEXT_BYTES of documents (or one longer one) at a time.

    Null and empty texts and items hold no passage; an item without words is never found. Rows and items with a null id come
    back with a null id; repeated documents or items are searched each for itself; other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for k in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted(((r[0], r[1]) for r in mine.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        index = spark.sparkContext.broadcast(Index(rows, similarity, recall))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = Hashes()

            def found(ids: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
                hits = index.value.search(np.concatenate(hashes), np.cumsum([len(x) for x in hashes]))
                cols = list(zip(*[(ids[d], index.value.items[i][0], s, e, x) for d, i, s, e, x in hits])) or [(), (), (), (), ()]
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start_word", "end_word", "distance"])

            for b in batches:
                ids, hashes, held = [], [], 0
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    text = t.as_py() or ""
                    ids.append(i)
                    hashes.append(known.of(text))
                    held += len(text)
                    if held > TEXT_BYTES:
                        yield found(ids, hashes)
                        ids, hashes, held = [], [], 0
                if ids:
                    yield found(ids, hashes)

        found = texts.mapInArrow(run, "doc_id long, item_id long, start_word long, end_word long, distance long")
        if blocks > 1:
            found = cut(found)
            index.unpersist()
        out = found if out is None else out.unionByName(found)
    return out
