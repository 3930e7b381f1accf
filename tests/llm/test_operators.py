"""Each operator against brute force or a round trip, with nulls, empty texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard

import corpus_pipeline
from panelcast import session
from panelcast.llm import bpe, chat, components, decontaminate, neardup, paragraphs, quality, secrets, sharding, shingles, substrings, vectors
from panelcast.llm.queries import ORACLES, QUERIES, tokenizer_path
from panelcast.llm.runindex import RunIndex

DOCS = "doc_id long, text string, shard int, key string"  # two columns with clashing names


def words_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Originals, copies, near copies, a shared passage, and the odd rows."""
    rng = random.Random(3)
    rows, passage = [], words_of(rng, 60)
    for i in range(24):
        rows.append((i, " ".join(words_of(rng, rng.randrange(30, 120))), 0, "x"))
    for i in range(24, 36):
        w = rows[i - 24][1].split()
        w[len(w) // 2] = "changed"
        rows.append((i, " ".join(w), 0, "x"))
    for i in range(36, 40):
        rows.append((i, " ".join(words_of(rng, 20) + passage + words_of(rng, 25)), 0, "x"))
    rows += [(40, rows[5][1], 0, "x"), (41, rows[5][1].upper(), 0, "x"), (42, None, 0, "x"), (43, "", 0, None), (44, "\n \t", 0, "x"),
             (45, "two words", 0, "x"), (46, "two words", 0, "x"), (None, rows[1][1], 0, "x"), (47, "é" * 70, 0, "x"), (48, "é" * 70 + "ü", 0, "x"),
             (49, "ab" * 4000, 0, "x"), (50, "ab" * 4000 + "c", 0, "x"), (40, rows[5][1], 0, "x")]
    return rows


def values(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def roots(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def test_shards_hold_every_row_once(spark, corpus):
    df = spark.createDataFrame(corpus, DOCS)
    got = sharding.shard(df, 7, seed=3, block_rows=4).select("doc_id", "text", "key", "shard", "slot").collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted([(r[0], r[1]) for r in corpus], key=str)
    sizes = [sum(r.shard == s for r in got) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in enumerate(sizes))
    assert sharding.shard(df.limit(0), 3).count() == 0


def test_communication_matrix_keeps_margins():
    cells = np.array([5, 0, 7, 8], dtype=np.int64)
    m = sharding.CommunicationMatrix([3, 0, 9, 8], cells, seed=1)
    rows = np.stack([m.row(p) for p in range(4)])
    assert rows.sum(axis=1).tolist() == [3, 0, 9, 8] and rows.sum(axis=0).tolist() == cells.tolist()


@pytest.mark.parametrize("limit", [0, 1_000_000_000])
def test_communication_matrix_is_hypergeometric(monkeypatch, limit):
    """Both samplers against the exact law: two rows of each of two partitions dealt to cells of two."""
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", limit)
    n = 6000
    seen = Counter(int(sharding.CommunicationMatrix([2, 2], np.array([2, 2], dtype=np.int64), seed).row(0)[0]) for seed in range(n))
    for value, share in ((0, 1 / 6), (1, 4 / 6), (2, 1 / 6)):
        assert abs(seen[value] - n * share) < 4.5 * math.sqrt(n * share * (1 - share))


def test_shards_are_shuffled_uniformly(spark):
    """Source partition against shard, and neighbours in the input against neighbours in the output."""
    n, shards = 12_000, 6
    got = sharding.shard(spark.range(n, numPartitions=5).withColumnRenamed("id", "doc_id"), shards, seed=11, block_rows=500).collect()
    counts = Counter((r.doc_id * 5 // n, r.shard) for r in got)
    expected = n / 5 / shards
    assert sum((counts[p, s] - expected) ** 2 / expected for p in range(5) for s in range(shards)) < 50  # 20 degrees of freedom
    place = {r.doc_id: (r.shard, r.slot) for r in got}
    ranks = np.array([place[i][1] for i in range(n)], dtype=float)
    assert abs(np.corrcoef(ranks, np.arange(n))[0, 1]) < 0.05 and abs(np.corrcoef(ranks[1:], ranks[:-1])[0, 1]) < 0.05
    together = sum(place[i][0] == place[i + 1][0] for i in range(n - 1))
    assert abs(together - n / shards) < 5 * math.sqrt(n / shards)


def test_run_index_gives_matching_statistics():
    rng = np.random.default_rng(1)
    for _ in range(25):
        lanes, letters = int(rng.integers(1, 5)), int(rng.integers(1, 4))
        def strings(n):
            return [bytes(rng.integers(250, 250 + letters, rng.integers(1, 30)).astype(np.uint8)) for _ in range(n)]
        old, new = strings(rng.integers(1, 20)), strings(rng.integers(1, 20))
        old_lanes, new_lanes = rng.integers(0, lanes, len(old)), rng.integers(0, lanes, len(new))
        def flat(x):
            return np.frombuffer(b"".join(x), np.uint8), np.array([len(y) for y in x])
        index = RunIndex(*flat(old), old_lanes)
        assert len(index.head) <= index.size
        got = {}
        for live, place, n in index.statistics(*flat(new), new_lanes):
            got |= {(int(a), int(b)): int(c) for a, b, c in zip(live, place, n)}
        for i, x in enumerate(new):
            mine = [o for o, lane in zip(old, old_lanes) if lane == new_lanes[i]]
            for j in range(len(x)):
                want = next((n for n in range(len(x) - j, 0, -1) if any(x[j:j + n] in o for o in mine)), 0)
                assert got[i, j] == want


def brute_substrings(rows, k):
    rows = [(r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for i, b in sorted(r for r in rows if r[0] is not None):
        for j in range(len(b) - k + 1):
            first.setdefault(b[j:j + k], i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for j in range(len(b) - k + 1 if i is not None else 0):
            if first[b[j:j + k]] < i:
                gone[j:j + k] = b"\1" * k
        spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("k", [50, 20])
def test_substrings_as_brute_force(spark, corpus, k):
    rng = random.Random(k)
    runs = [(100 + i, "".join(rng.choice("ab") * rng.randrange(1, 9) for _ in range(60)), 0, None) for i in range(30)]
    rows = corpus + runs
    assert values(substrings.dedup(spark.createDataFrame(rows, DOCS), length=k), *COLUMNS) == brute_substrings(rows, k)


def test_substrings_small_indexes_and_empty(spark, corpus, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 3000)
    df = spark.createDataFrame(corpus, DOCS)
    got = substrings.dedup(df, length=50)
    assert values(got, *COLUMNS) == brute_substrings(corpus, 50)
    for r in got.collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.removed) == r.n_removed
    assert substrings.dedup(df.limit(0)).count() == 0


def test_pieces_without_a_common_window_stay_out_of_the_index():
    """A common string shorter than a window brings pieces together, but none of them is indexed; an equal window is."""
    rng = random.Random(8)
    noise = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    short, long = noise(45), noise(50)
    pieces = [noise(20) + short + noise(20), noise(20) + short + noise(20), noise(10) + long + noise(10), noise(10) + long + noise(10), noise(90)]
    for anchors, live in (([1, 1, 1, 1, 1], [2, 3]), ([1, 1, 2, 3, 3], [])):
        state = substrings.Earlier(50)
        for i, (a, x) in enumerate(zip(anchors, pieces)):
            state.add(a, x, i)
        sizes = np.array([len(x) for x in pieces])
        got = state._meeting(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes, np.array(anchors))
        assert got.tolist() == live
        assert [np.flatnonzero(m).tolist() for m in state.marks()] == [[], [], [], [10] if live else [], []]
    assert substrings.Earlier(50).marks() == []


def brute_marks(pieces, anchors, docs, k):
    starts = lambda x: range(len(x) - k + 1)
    first = {}
    for x, a, d in zip(pieces, anchors, docs):
        for j in starts(x):
            first[a, x[j:j + k]] = min(d, first.get((a, x[j:j + k]), d))
    return [[j for j in starts(x) if first[a, x[j:j + k]] < d] for x, a, d in zip(pieces, anchors, docs)]


def test_marks_in_shares_turns_and_with_equal_hashes_of_other_windows(monkeypatch):
    """Small indexes, windows taken in turns, and hashes that different windows share leave the marks as they are."""
    rng = random.Random(10)
    body = [bytes(rng.choice(b"abc") for _ in range(14)) for _ in range(5)]
    pieces = sorted({body[i % 5][rng.randrange(3):] + bytes(rng.choice(b"abc") for _ in range(rng.randrange(8))) for i in range(160)})
    anchors = sorted(rng.randrange(4) for _ in pieces)
    docs = [rng.randrange(40) for _ in pieces]
    want = brute_marks(pieces, anchors, docs, 9)
    assert sum(map(len, want)) > 100
    real = substrings.window_hashes
    for name, value in ((None, None), ("KEYS", 50), ("INDEX_BYTES", 60), ("HASH_BYTES", 40), ("window_hashes", lambda b, width: real(b, width) & np.uint64(7))):
        with monkeypatch.context() as patch:
            if name:
                patch.setattr(substrings, name, value)
            state = substrings.Earlier(9)
            for a, x, d in zip(anchors, pieces, docs):
                state.add(a, x, d)
            assert [np.flatnonzero(m).tolist() for m in state.marks()] == want


def test_a_window_is_indexed_and_streamed_once_however_many_pieces_share_an_anchor(monkeypatch):
    """A line that many documents have between words of their own: the work per piece does not grow with their number."""
    rng = random.Random(11)
    noise = lambda n: bytes(rng.choice(b"abcdefghij") for _ in range(n))
    line, done = noise(60), []

    class Counted(substrings.RunIndex):
        def __init__(self, data, lens, lanes):
            done.append(len(data))
            super().__init__(data, lens, lanes)

        def statistics(self, data, lens, lanes):
            done.append(len(data))
            return super().statistics(data, lens, lanes)

    monkeypatch.setattr(substrings, "RunIndex", Counted)
    state = substrings.Earlier(50)
    for doc in range(1000):
        state.add(1, noise(20) + line + noise(20), doc)
    assert all(m[20:31].all() for m in state.marks()[1:])
    assert sum(done) < 1.5 * state.bytes


def test_removals_over_slices_of_any_size(monkeypatch):
    """Classes alone with their anchor are passed over, wherever a batch or slice ends."""
    rng = random.Random(9)
    bodies = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(6)]
    rows = sorted((rng.randrange(25), rng.choice(bodies), rng.randrange(8)) for _ in range(90))
    whole = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows]),
         pa.array(np.zeros(len(rows), np.int32)), pa.array(100 * np.arange(len(rows)))], ["anchor", "piece", "doc_id", "nth", "at"])
    want = {(d, 100 * i + j) for i, (a, x, d) in enumerate(rows) for s in range(3) if any(b == a and e < d and x[s:s + 10] in y for b, y, e in rows) for j in range(s, s + 10)}
    for kinds in (1, 2, 5, 4096):
        monkeypatch.setattr(substrings, "KINDS", kinds)
        for size in (1, 7, 90):
            out = [r for b in substrings._removals(10)(iter([whole.slice(i, size) for i in range(0, len(rows), size)])) for r in b.to_pylist()]
            assert {(r["doc_id"], i) for r in out for i in range(r["start"], r["end"])} == want


def test_shared_anchors_over_batches():
    import pyarrow as pa

    rows = [(1, 5), (1, 5), (2, 5), (2, 6), (3, 7), (3, 7), (3, 7), (4, 1), (5, 1), (5, 2), (5, 1)]
    want = [r for r in rows if len({d for a, d in rows if a == r[0]}) > 1]
    for cut in (1, 2, 3, 20):
        batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows[i:i + cut]], pa.int64()), pa.array([d for _, d in rows[i:i + cut]], pa.int64())],
                                              ["anchor", "doc_id"]) for i in range(0, len(rows), cut)]
        got = [(a, d) for b in substrings._shared(iter(batches)) for a, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert set(got) == set(want)


def test_shared_anchors_in_any_order_held_in_parts(monkeypatch):
    """Rows come unsorted and are sorted in parts; what is known of an anchor outlives its part. Of equal texts the least id may
    not be lost, and every text of an anchor that several texts have is named."""
    rng = random.Random(12)
    name = [rng.randrange(30) for _ in range(60)]
    rows = [(rng.randrange(40), d, name[d]) for d in range(60) for _ in range(3)]
    texts = {a: {w for b, _, w in rows if b == a} for a, _, _ in rows}
    most = {(a, d) for a, d, w in rows if len(texts[a]) > 1}
    least = {(a, min(d for b, d, v in rows if (b, v) == (a, w))) for a, _, w in rows if len(texts[a]) > 1}
    for part, size in ((1, 1), (5, 3), (20, 50), (50, 7), (1000, 60)):
        monkeypatch.setattr(substrings, "ROWS", part)
        rng.shuffle(rows)
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i:i + size]], pa.int64()) for c in range(3)], ["anchor", "doc_id", "name"])
                   for i in range(0, len(rows), size)]
        got = {(a, d) for b in substrings._shared_unsorted(iter(batches)) for a, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        assert least <= got <= most


def test_shuffle_files_go_with_the_stage_they_served(spark):
    """``release`` holds for the one write, and the setting is as before after it."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def left(release):
        names = lambda: {x.toString() for x in (lambda s: [s.apply(i) for i in range(s.size())])(disk.getAllBlocks()) if x.toString().startswith("shuffle_")}
        old = names()
        written = session.cut(spark.range(1000).repartition(3, "id"), release=release)
        new = names() - old
        assert written.count() == 1000
        return new

    for before in (None, "false"):
        if before:
            spark.conf.set(session.RELEASE, before)
        assert not left(True) and spark.conf.get(session.RELEASE, None) == before
        assert left(False)
    spark.conf.unset(session.RELEASE)


def test_window_hashes_are_of_the_bytes_in_the_window():
    rng = np.random.default_rng(13)
    for n in (0, 1, 23, 24, 90):
        b = rng.integers(97, 100, n).astype(np.uint8)
        for width in (1, 2, 3, 24, 50):
            got = substrings.window_hashes(b, width)
            cuts = [bytes(b[i:i + width]) for i in range(n - width + 1)]
            assert len(got) == len(cuts) and len(set(got.tolist())) == len(set(cuts)) == len(set(zip(got.tolist(), cuts)))


def test_anchors_shared_by_copies_only_drop_out():
    rows = [(1, 5, 0), (1, 4, 0), (1, 6, 0), (2, 9, 1), (2, 8, 1), (2, 7, 2), (3, 1, 3), (3, 1, 4), (4, 2, 5), (4, 3, 5)]
    for cut in (1, 2, 3, 20):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i:i + cut]], pa.int64()) for c in range(3)], ["anchor", "doc_id", "name"])
                   for i in range(0, len(rows), cut)]
        got = {(a, d) for b in substrings._shared(iter(batches)) for a, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        assert {(2, 8), (2, 7), (3, 1)} <= got <= {(2, 9), (2, 8), (2, 7), (3, 1)}


def shingle_sets(text, k):
    w = shingles.words(text)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates_as_brute_force(spark, corpus):
    sets = [(r[0], shingle_sets(r[1], 4)) for r in corpus]
    named = [(i, s) for i, s in sets if i is not None and s]
    links = [(a, b) for a, s in named for b, t in named if a < b and 100 * len(s & t) >= 80 * len(s | t)]
    root = roots({i for i, _ in sets}, links)
    want = sorted([(i, len(s), root[i], i is None or root[i] == i) for i, s in sets], key=str)
    df = spark.createDataFrame(corpus, DOCS)
    assert values(neardup.near_duplicates(df, k=4), "doc_id", "n_shingles", "component_id", "kept") == want
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_index_keys_meet_below_the_distance():
    rng = np.random.default_rng(5)
    n = neardup.CHUNKS * neardup.WIDTH
    for _ in range(200):
        a = rng.integers(0, 1 << 16, n)
        b = a.copy()
        at = rng.choice(n, 2 * neardup.CHUNKS - 1, replace=False)
        b[at] = (b[at] + 1) % (1 << 16)
        keys = neardup.index_keys(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    """A group of near copies that block meetings alone must link, against brute force."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(12)
    base = words_of(rng, 150, 5000)
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(0, 14)):
            w[at] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    rows += [(5, "another text of the same id " + " ".join(words_of(rng, 60))), (200, None)]
    sets = [(i, shingle_sets(t, 4)) for i, t in rows]
    links = [(a, b) for a, s in sets for b, t in sets if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    root = roots({i for i, _ in rows}, links)
    assert len(set(root.values())) > 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for pivots in (0, 3):
        got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df, k=4, pivots=pivots).collect()}
        assert got == set(root.items())


def test_close_pairs_come_once():
    rng = np.random.default_rng(3)
    n = neardup.CHUNKS * neardup.WIDTH
    coarse = np.repeat(rng.integers(0, 1 << 16, (1, n)), 30, axis=0)
    hit = rng.random(coarse.shape) < 0.12
    coarse[hit] = rng.integers(0, 1 << 16, hit.sum())
    fine, c, rows = np.zeros((30, neardup.FINE), dtype=np.uint8), np.arange(30), np.arange(30)
    found = []
    for x, keys in enumerate(neardup.index_keys(coarse)):
        for key in keys:
            members = np.array([y for y in rows if y > x and key in neardup.index_keys(coarse[y:y + 1])[0]], dtype=np.int64)
            if len(members):
                [(a, b)] = neardup.close_pairs(int(key), coarse, fine, c, np.array([x]), members, 80)
                found += list(zip(a.tolist(), b.tolist()))
    want = [(x, y) for x in rows for y in rows if x < y and (coarse[x] != coarse[y]).sum() < 2 * neardup.CHUNKS]
    assert sorted(found) == sorted(want) and len(want) > 100


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (8, 9), (7, 7), (3, 1), (20, None)] + [(100, i) for i in range(101, 140)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8} | {i: 100 for i in range(100, 140)}
    assert components.components(spark.createDataFrame([(7, 7), (None, 3)], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_components_of_paths_hubs_and_random_links(spark, monkeypatch, chunk):
    """Links dealt over many tasks and thinned a few at a time, so that rounds by id and by hash have to do the rest."""
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(21)
    links = [(i, i + 1) for i in range(1000, 1120)] + [(2500, 2000 + i) for i in range(300)]
    links += [(3000 + rng.randrange(150), 3000 + rng.randrange(150)) for _ in range(110)]
    rng.shuffle(links)
    ids = {i for x, y in links if x != y for i in (x, y)}
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    assert len(got) == len(ids) and {r["id"]: r["component"] for r in got} == roots(ids, links)


def test_a_forest_connects_what_the_links_do():
    rng = np.random.default_rng(8)
    for n in (1, 5, 40, 400):
        u, v = rng.integers(0, n, n), rng.integers(0, n, n)
        x, y = components.forest(u, v)
        assert len(set(x.tolist())) == len(x) and (y < x).all()
        every, kept = (roots(range(n), list(zip(p.tolist(), q.tolist()))) for p, q in ((u, v), (x, y)))
        assert every == kept


def test_lines_of_a_bucket_meet(spark, monkeypatch):
    """Lines whose bands collide: without a pivot round, block meetings alone must link what all pairs of lines link."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup.HammingJoin.__init__, "__defaults__", (0,))
    rng = random.Random(14)
    base = words_of(rng, 60)
    lines = []
    for i in range(90):
        w = list(base)
        for at in rng.sample(range(60), rng.randrange(4)):
            w[at] = f"x{rng.randrange(10**6)}"
        lines.append(" ".join(w))
    sets = [shingle_sets(t, 5) for t in lines]
    links = [(a, b) for a in range(90) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(range(90), links)
    gone = {r.doc_id for r in paragraphs.repeats(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect() if r.n_words == 60}
    assert 0 < len(links) < 90 * 89 / 2 and {i for i in range(90) if root[i] != i} <= gone


def test_uniting_links_unite_what_all_pairs_do():
    rng = np.random.default_rng(15)
    for _ in range(50):
        sets = [np.unique(rng.integers(0, 14, rng.integers(1, 14)).astype(np.uint64)) for _ in range(25)]
        label = rng.integers(0, 20, 25)
        xs, ys = np.nonzero(np.triu(label[:, None] != label[None, :], 1))
        got = list(neardup.uniting_links(xs, ys, label.copy(), lambda r: sets[int(r)], 60))
        assert all(neardup.similar(sets[x], sets[y], 60) for x, y in got)
        every = [(int(x), int(y)) for x, y in zip(xs, ys) if neardup.similar(sets[x], sets[y], 60)]
        same = [(int(np.flatnonzero(label == v)[0]), int(i)) for i, v in enumerate(label)]
        assert roots(range(25), got + same) == roots(range(25), every + same) and len(got) < 25


def test_paragraphs(spark, corpus):
    rng = random.Random(8)
    lines = [" ".join(words_of(rng, 45)) for _ in range(6)]
    near = lines[0].split()
    near[0] = "other"
    rows = corpus + [
        (60, lines[0] + "\n" + lines[1], 0, None), (61, lines[2] + "\n" + lines[0].upper(), 0, None), (62, " ".join(near) + "\n" + lines[3], 0, None),
        (63, lines[4] + "\nshort shared line", 0, None), (64, lines[5] + "\nshort shared line", 0, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = paragraphs.repeats(df).collect()
    text = {r[0]: r[1] for r in rows}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.n_words >= 20 and (r.kept_doc_id, r.kept_start) <= (r.doc_id, r.start)
        assert len(text[r.doc_id].encode()[r.start:r.end].split()) == r.n_words
    assert 60 not in by and 63 not in by and 64 not in by and 36 not in by and 42 not in by
    assert (by[61][0].start, by[61][0].kept_doc_id) == (len(lines[2]) + 1, 60)
    assert (by[62][0].start, by[62][0].end, by[62][0].kept_doc_id) == (0, len(" ".join(near)), 60)
    assert all(any(36 in r.kept_doc_ids for r in by[i]) for i in (37, 38, 39))
    assert {24 + i for i in range(12) if len(text[i].split()) >= 50} <= set(by) and 40 in by and 41 in by
    assert paragraphs.repeats(df.limit(0)).count() == 0


def test_short_lines_that_repeat(spark):
    rng = random.Random(23)
    nine, near, four = words_of(rng, 9), words_of(rng, 19), "only four words here"
    changed = ["other"] + near[1:]
    rows = [(i, "\n".join([four, " ".join(words_of(rng, 30, 10**6)), " ".join(line), " ".join(words_of(rng, 30, 10**6))]))
            for i, line in enumerate([nine, near, nine, changed, nine])]
    got = {r.doc_id: r for r in paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cut_out = {i: rows[i][1].encode()[r.start:r.end].decode() for i, r in got.items()}
    assert cut_out == {2: " ".join(nine), 3: " ".join(changed), 4: " ".join(nine)}
    assert {i: r.kept_doc_id for i, r in got.items()} == {2: 0, 3: 1, 4: 0} and {r.n_words for r in got.values()} == {9, 19}


def test_banding_is_tuned_to_the_recall():
    bands, rows = paragraphs.tune(0.8, 0.999, 8)
    assert paragraphs.recall(0.8, bands, rows) >= 0.999 > paragraphs.recall(0.8, bands, rows + 1)
    with pytest.raises(ValueError):
        paragraphs.tune(0.1, 0.9999, 2)


TURNS = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|>"), (1, None, "ann", None), (1, 2, "bob", "yo <|im_end|>"),
         (2, 0, "system", "alone"), (None, 0, None, "lost"), (None, 1, "", "souls"), (3, 0, "ann", "é")]


def test_perspectives(spark):
    df = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, part int")
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.perspectives(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (None, "unknown", 0), (3, "ann", 0)}
    ann = got[1, "ann", 0]
    assert ann.text == ("<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
                        + "<|im_start|>user name=bob\nyo <| im_end|><|im_end|>\n" * 2 + "<|im_start|>assistant\n<|im_end|>\n")
    assert [ann.text[s.start:s.end] for s in ann.mask] == ["hi<|im_end|>", "<|im_end|>"] and ann.n_turns == 5
    parts = [r for r in chat.perspectives(df, part_turns=2).orderBy("part").collect() if (r.conv_id, r.perspective) == (1, "ann")]
    assert [r.n_turns for r in parts] == [2, 2, 1] and "".join(r.text for r in parts) == ann.text
    assert chat.perspectives(df.limit(0)).count() == 0


def test_only_wanted_lines_are_cut_out_of_texts():
    """Of texts with equal ids, the one whose line has the wanted name gives it; other lines are not packed."""
    texts = ["First line of Five words\nthe second line has six\n", "first", None, "other words stand at this place\nthe second line has six"]
    packed = list(paragraphs._pack(iter([pa.RecordBatch.from_arrays([pa.array([5, 5, 5, 5]), pa.array(texts)], ["doc_id", "text"])])))
    w = paragraphs.Words([texts[0].encode()])
    one, two = w.names(w.line_starts())
    line = [{"id": 9, "one": int(one[0]), "two": int(two[0]), "start": 0, "end": 24}]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([packed[0].column(1), pa.array([line] * 4, kind)], ["text", "lines"])
    rows = [r for b in paragraphs._lines(iter([batch, batch.slice(0, 0), batch.slice(2)])) for r in b.to_pylist()]
    assert [(r["id"], zstandard.ZstdDecompressor().decompress(r["words"])) for r in rows] == [(9, b"first line of five words")]


def test_bpe_passes_ids_on_in_parts(monkeypatch):
    """A large batch of texts is not held as one batch of ids; rows, order and results stay."""
    monkeypatch.setattr(bpe, "BATCH_BYTES", 400)
    texts = ["one two three " * n for n in (1, 40, 0, 90, 3, 3)] + [None, "last"]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 3, 3, None, 1, 2, 9, 4], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    for tokens in (True, False):
        parts = list(bpe._encoded(tokenizer_path(), tokens)(iter([batch, batch.slice(0, 0), batch.slice(7)])))
        assert len(parts) > 3 and all(sum(p.column("n_tokens").to_pylist()[:-1]) * 4 < 400 for p in parts)
        rows = pa.Table.from_batches(parts)
        assert rows.column("doc_id").to_pylist() == [7, 3, 3, None, 1, 2, 9, 4, 4]
        tok = bpe.load(tokenizer_path())
        ids = [tok.encode(t or "") for t in [*texts, "last"]]
        assert rows.column("ids_sha256").to_pylist() == [hashlib.sha256(x).hexdigest() for x in ids]
        assert rows.column("decoded_sha256").to_pylist() == [hashlib.sha256(tok.decode(x)).hexdigest() for x in ids]
        if tokens:
            assert rows.column("ids").to_pylist() == [np.frombuffer(x, "<u4").tolist() for x in ids]


def test_bpe_takes_transitions_of_many_words_at_once(monkeypatch):
    """New words are not encoded one by one, at less than half the time; the paths are those of single words and of the library."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    tok, library = bpe.load(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    parts = ["the", "ing", "tion", "un", "re", "st", "a", "e", "ou", "th", "qu", "zz", "é", "ß", "ñ", "ł"]
    words = sorted({"".join(rng.choices(parts, k=rng.randrange(1, 7))) for _ in range(20_000)})
    letters = ["".join(map(tok.letters.__getitem__, w.encode())) for w in words]
    begin = time.process_time()
    single = [np.array(tok.auto.encode(w), "<u4").tobytes() for w in letters]
    between = time.process_time()
    assert tok.auto.encode_all(letters) == single
    assert time.process_time() - between < 0.5 * (between - begin)
    odd = ["", "x", *("".join(rng.choices(tok.letters[97] + tok.letters[98] + tok.letters[200] + tok.letters[32], k=n)) for n in (2, 127, 128, 129, 700))]
    with monkeypatch.context() as m:
        m.setattr(bpe, "BLOCK_LETTERS", 50)
        m.setattr(bpe, "PAIR_SLOTS", 2)
        small = bpe.load(tokenizer_path()).auto
        assert small.encode_all(letters[:500] + odd) == single[:500] + [np.array(small.encode(w), "<u4").tobytes() for w in odd]

    def alone(self, letters):
        raise AssertionError(letters)
    monkeypatch.setattr(bpe.MergeAutomaton, "encode", alone)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 3000)
    monkeypatch.setattr(bpe, "WORD_CACHE", 700)
    texts = [" ".join(rng.choices(words, k=rng.randrange(40))) + rng.choice(["", "<|endoftext|>", "日本語 été"]) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], ["doc_id", "text"])
    got = pa.Table.from_batches(bpe._encoded(tokenizer_path(), True)(iter([batch]))).column("ids").to_pylist()
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_words_of_latin_text():
    """The spelled-out pattern cuts like the pattern itself and like the library, whatever two characters meet."""
    import regex
    from tokenizers import Tokenizer

    tok, library = bpe.load(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    with open(tokenizer_path(), encoding="utf-8") as f:
        pattern = next(p for p in json.load(f)["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
    plain = regex.compile(pattern).findall
    kinds = ["a", "1", "'", "-", " ", "s", "é", "²", "'s", "\x85", "\u0307"]
    texts = ["".join(f"{c}{k}{c}x{k}{c}" for k in kinds).lower() for c in map(chr, range(0x250))]
    assert tok.words is not plain and [tok.words(t) for t in texts] == [plain(t) for t in texts]
    texts = [f"a{c}b {c} 1{c}{c}'{c}s" for c in map(chr, range(0x250))]
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode_all(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for other in (r"\p{L}+|\p{N}", r"[\p{L}\p{M}]+", r"(?i:'s)|[\p{L}]+", r"[\p{L}]+\s"):
        assert bpe.latin_words(other)("Éa's 1 b́") == regex.findall(other, "Éa's 1 b́")


def test_bpe_as_the_library(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    odd = ["Hello  World's 12345 <|endoftext|>x", "ÀÉ naïve ß ŉ", "日本語 テキスト", "İstanbul ﬁ é", "a​b \U0001f600\U0001f468", "x" * 5000, "don't we'll"]
    rows = corpus + [(200 + i, t, 0, None) for i, t in enumerate(odd)]
    got = {(r.doc_id, tuple(r.ids), r.decoded_sha256) for r in bpe.encode(spark.createDataFrame(rows, DOCS), tokenizer_path()).collect()}
    want = set()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.add((r[0], tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want


def test_secrets(spark):
    rng = random.Random(4)
    key = "".join(rng.choice("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(40))
    rows = [(1, f'pässword: "{"x" * 12}" Token = abc', 0, ""), (2, "AKIA" + "A1" * 9, 0, ""), (3, "é 0123456789abcdef0 z", 0, ""), (4, None, 0, ""), (5, "", 0, ""),
            (6, f"see {key} here", 0, ""), (7, f"see {key}EXAMPLE here", 0, ""), (8, "a" * 60, 0, ""), (2, "AKIA" + "A1" * 9, 0, ""), (9, f"secret={key}", 0, "")]
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, DOCS))).collect()}
    assert (got[1].n_assign, got[2].n_access, got[3].n_hex, got[4].spans, got[5].spans) == (0, 1, 1, "", "")
    assert got[2].spans.startswith("access:0:22") and got[3].spans.startswith("hex:2:19")
    assert got[6].spans.startswith("entropy_base64:4:") and got[7].spans == "" and got[9].n_assign == 1
    assert got[8].spans == "hex:0:60"
    redacted = {r.doc_id: r.text for r in secrets.redact(secrets.scan(spark.createDataFrame(rows, DOCS))).collect()}
    assert redacted[2] == "[SECRET]" and key not in redacted[9] and redacted[4] is None


def entropy_spans(text, c):
    """Every window of every piece counted from scratch; touching windows joined."""
    allowed = re.compile("[^/=]{0,40}(?i:example|placeholder|changeme|your[_-]?(?:key|token|secret)|abcdefghijklmnop|0123456789abcdef)[^/=]{0,40}")
    out = []
    for m in re.finditer(f"[{c.chars}]{{{c.window},}}", text):
        at, run = 0, m.group()
        for lo, hi in [x.span() for x in allowed.finditer(run)] + [(len(run), len(run))]:
            own = []
            for b in range(at, lo - c.window + 1):
                n = Counter(run[b:b + c.window]).values()
                if sum(round(x * math.log2(x) * 1e6) for x in n) <= round(c.window * math.log2(c.window) * 1e6) - c.least_bits * c.window:
                    if own and b <= own[-1][1]:
                        own[-1][1] = b + c.window
                    else:
                        own.append([b, b + c.window])
            out += [(m.start() + a, c.kind, m.start() + z) for a, z in own]
            at = hi
    return out


def test_secret_windows_against_brute_force(spark):
    """Runs of changing entropy, over more than one stretch of windows, with allow-list matches, separators and odd characters."""
    rng = random.Random(41)
    rows = []
    for i in range(60):
        bits = []
        for _ in range(rng.choice([3, 12, 120])):
            letters = rng.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "ab", "ABCdefG1"])
            bits.append("".join(rng.choice(letters) for _ in range(rng.choice([5, 24, 30, 70]))))
            bits.append(rng.choice(["", "", "", "/", "=", " ", "é", "Example", "0123456789abcdef", "your_key"]))
        rows.append((i, "".join(bits), 0, ""))
    key = "".join(rng.sample("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", 40))
    rows += [(60, f"path/example/deploy_key={key}", 0, ""), (61, f"{key}/example-{key}", 0, "")]
    got = {r.doc_id: r.found for r in secrets.scan(spark.createDataFrame(rows, DOCS)).collect()}
    spans = 0
    for i, text, *_ in rows:
        want = sorted(x for c in secrets.CLASSES for x in entropy_spans(text, c))
        assert sorted((f.start, f.kind, f.end) for f in got[i] if f.rank >= 3) == want
        spans += len(want)
    assert spans > 100
    assert [f for f in got[60] if f.kind == "entropy_base64"][-1].end == 24 + 40 and [f.end for f in got[61] if f.rank >= 3] == [41]


def test_secret_scan_of_a_very_long_run(spark):
    """A run of a million characters takes seconds, as its time grows with its length."""
    rng = random.Random(42)
    text = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=1_000_000))
    began = time.monotonic()
    found = secrets.scan(spark.createDataFrame([(1, text, 0, "")], DOCS)).collect()[0].found
    assert time.monotonic() - began < 60
    spans = [(f.start, f.end) for f in found if f.kind == "entropy_base64"]
    assert sum(z - a for a, z in spans) > 900_000 and all(a >= z for (_, z), (a, _) in zip(spans, spans[1:]))


def test_secret_scan_of_no_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert secrets.digest(secrets.scan(none)).count() == 0 and secrets.redact(secrets.scan(none)).count() == 0


def test_decontamination(spark, corpus):
    rng = random.Random(6)
    item = words_of(rng, 40)
    edited = item[:10] + ["new"] + item[11:25] + item[26:]
    long = " ".join(words_of(rng, 3000) + edited + words_of(rng, 200))
    rows = corpus + [(70, "start " + " ".join(item).upper() + " end", 0, None), (71, long, 0, None), (72, " ".join(item[:20]), 0, None)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (None, "never there at all in any of these")], "item_id long, text string")
    df = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.passages(df, bench).collect()}
    assert set(got) == {(70, 1), (71, 1)}
    assert (got[70, 1].distance, got[70, 1].start_word, got[70, 1].end_word, got[71, 1].distance) == (0, 1, 41, 2)
    assert decontaminate.passages(df.limit(0), bench).count() == 0 and decontaminate.passages(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["s", "d", "i", "sdi"])
def test_decontamination_recall_at_the_allowed_distance(kind):
    """Substitutions, deletions, insertions and mixtures, at even and at random places, for items of 1 to 130 words."""
    rng = random.Random(16)
    items = [(n, [f"i{rng.randrange(10**9)}" for _ in range(n)]) for n in (1, 4, 5, 6, 9, 10, 15, 20, 29, 30, 40, 53, 55, 59, 64, 80, 130)]
    index = decontaminate.Index([(n, " ".join(w)) for n, w in items], 0.8, 0.98)
    known, texts, want = decontaminate.Hashes(), [], set()
    for k, (n, item) in enumerate(items):
        for spread in (False, True, True, True, True, True):
            w, edits = list(item), decontaminate.allowed_edits(n, 0.8)
            where = [(i + 1) * n // (edits + 1) for i in range(edits)] if not spread else rng.sample(range(1, n - 1), edits)
            for at in sorted(where, reverse=True):
                one = rng.choice(kind)
                w[at:at + (one != "i")] = [] if one == "d" else [f"new{rng.randrange(10**9)}"]
            want.add((len(texts), k))
            texts.append(" ".join(words_of(rng, 150) + w + words_of(rng, rng.randrange(90))))
    hashes = [known.of(t) for t in texts]
    got = index.search(np.concatenate(hashes), np.cumsum([len(h) for h in hashes]))
    found = {(d, k) for d, k, *_ in got}
    assert found <= want and len(found) >= 0.95 * len(want)
    assert all(0 <= x <= index.edits[k] for _, k, _, _, x in got)


def least_distance(item, doc):
    """Edit distance of the item to the closest stretch of the document, cell by cell."""
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item):
        nxt = [i + 1]
        for j, x in enumerate(doc):
            nxt.append(min(row[j] + (w != x), row[j + 1] + 1, nxt[j] + 1))
        row = nxt
    return min(row)


def test_decontamination_against_a_scan_of_every_stretch(spark):
    """Words from a small vocabulary, so that near misses abound."""
    rng = random.Random(23)
    items = [(i, words_of(rng, rng.choice([12, 20, 33, 47]), 60)) for i in range(12)]
    docs = []
    for d in range(60):
        w = words_of(rng, rng.randrange(0, 60), 60)
        if d % 2:
            item = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, len(item) // 3)):
                at = rng.randrange(len(item))
                item[at:at + rng.choice([0, 1, 1])] = rng.choice([[], words_of(rng, 1, 60)])
            w += item + words_of(rng, rng.randrange(0, 30), 60)
        docs.append((d, w))
    want = {(d, i) for d, w in docs for i, item in items if least_distance(item, w) <= decontaminate.allowed_edits(len(item), 0.8)}
    df = spark.createDataFrame([(d, " ".join(w), 1, "x") for d, w in docs], "doc_id long, text string, item_id int, start_word string")
    bench = spark.createDataFrame([(i, " ".join(w), 0) for i, w in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.passages(df, bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 15


def test_null_items_keep_their_null(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(None, item), (-1, "a b c d e f g h i j k l"), (-1, "a b c d e f g h i j k l")], "item_id long, text string")
    df = spark.createDataFrame([(1, f"x {item} y"), (None, "a b c d e f g h i j k l"), (None, "a b c d e f g h i j k l")], "doc_id long, text string")
    want = [(1, None)] + [(None, -1)] * 4
    for size in (8_000_000, 20):  # the second takes several passes
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert sorted(((r.doc_id, r.item_id) for r in decontaminate.passages(df, bench).collect()), key=str) == sorted(want, key=str)


def test_decontamination_of_adjacent_copies():
    rng = random.Random(18)
    item = words_of(rng, 40)
    h = decontaminate.Hashes().of(" ".join(item + item[:15] + item[18:] + item))
    index = decontaminate.Index([(1, " ".join(item))], 0.8, 0.98)
    assert sorted(index.search(h, np.array([len(h)]))) == [(0, 0, 0, 40, 0), (0, 0, 40, 77, 3), (0, 0, 77, 117, 0)]


def test_decontamination_in_small_steps(monkeypatch):
    rng = random.Random(17)
    item = words_of(rng, 40)
    index = decontaminate.Index([(1, " ".join(item)), (2, " ".join(item))], 0.8, 0.98)
    hashes = [decontaminate.Hashes().of(" ".join(words_of(rng, i % 7) + (item if i % 3 else []))) for i in range(40)]
    args = np.concatenate(hashes), np.cumsum([len(h) for h in hashes])
    want = index.search(*args)
    assert {d for d, *_ in want} == {i for i in range(40) if i % 3} and len(want) == 2 * len({d for d, *_ in want})
    for step in (1, 100, 1000):
        monkeypatch.setattr(decontaminate, "STEP", step)
        assert index.search(*args) == want


def test_vectors_as_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        base = np.random.default_rng(i % 30).standard_normal(16)
        rows.append((i, (base + rng.standard_normal(16) * 0.15).tolist(), i % 2))
    rows += [(200, [0.0] * 16, 0), (201, None, 0), (202, [float("nan")] + [1.0] * 15, 0), (203, rows[0][1], 0), (204, rows[0][1], None), (None, rows[0][1], 0), (205, [1.0], 0)]
    got = values(vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")), "vec_id", "n_links", "component_id", "kept")
    good = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if i is not None and v and lab is not None and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, (x, p) in good.items() for b, (y, q) in good.items() if a < b and p == q and len(x) == len(y) and float(x @ y) >= 0.93]
    root = roots({r[0] for r in rows}, links)
    assert got == sorted([(i, sum(i in ab for ab in links), root[i], i is None or root[i] == i) for i, _, _ in rows], key=str)


def alike(rng, n, pairs, typical, dim=64, least=0.935):
    """Unit vectors of one label with this typical cosine, and pairs of them just over the threshold."""
    common = np.eye(dim)[0] * np.sqrt(typical)
    m = rng.standard_normal((n, dim))
    m[:, 0] = 0
    m = m / np.linalg.norm(m, axis=1)[:, None] * np.sqrt(1 - typical) + common
    off = rng.standard_normal((pairs, dim))
    off -= (off * m[:pairs]).sum(axis=1)[:, None] * m[:pairs]
    return np.vstack([m, m[:pairs] * least + off / np.linalg.norm(off, axis=1)[:, None] * np.sqrt(1 - least**2)])


@pytest.mark.parametrize("typical", [0.0, 0.5, 0.75])
def test_links_of_a_label_of_alike_vectors(spark, typical):
    """Pairs just over the threshold among vectors alike to this degree: found of all that brute force finds."""
    n, pairs = 4000, 400
    m = alike(np.random.default_rng(21), n, pairs, typical)
    m /= np.linalg.norm(m, axis=1)[:, None]
    close = [(a + i, b) for a in range(0, n + pairs, 1000) for i, b in zip(*np.nonzero(m[a:a + 1000] @ m.T >= 0.93)) if a + i < b]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>, label long, class string, passes int")
    got = vectors.near_duplicates(df).collect()
    found = sum(r.n_links for r in got)
    assert 0.995 * 2 * len(close) <= found <= 2 * len(close) and len(close) >= pairs
    root = roots(range(n + pairs), [(int(a), int(b)) for a, b in close])
    assert sum(root[r.vec_id] != r.component_id for r in got) <= 0.01 * len(close)


def test_a_recall_out_of_reach_is_an_error():
    crowd = np.random.default_rng(3).standard_normal((400, 64)) * 0.045 + np.eye(64)[0]
    crowd /= np.linalg.norm(crowd, axis=1)[:, None]
    with pytest.raises(ValueError, match="window"):
        vectors.passes_for(crowd, crowd.mean(axis=0), 10**9, 32, 0.97, 0.9995)


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label long")).collect() == []


def test_passes_grow_with_rows_and_similarity():
    rng = np.random.default_rng(22)
    plans = {}
    for typical in (0.0, 0.5, 0.75):
        m = alike(rng, 512, 0, typical)
        plans[typical] = [vectors.passes_for(m, m.mean(axis=0), n, 32, 0.93, 0.999) for n in (20_000, 400_000)]
        assert plans[typical][0] < plans[typical][1]
    assert 24 < plans[0.0][1] < plans[0.5][1] < plans[0.75][1] < vectors.MOST_PASSES


def test_quality_learns_and_keeps_rows(spark):
    rng = random.Random(9)
    rows = [(i, " ".join((f"good{rng.randrange(30)}" if i % 2 else f"BAD{rng.randrange(30)}!!") for _ in range(30)), 0, None) for i in range(300)]
    rows += [(900, None, 0, None), (901, "", 0, None), (None, "good1", 0, None), (1, rows[1][1], 0, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(900, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, DOCS)
    got = quality.score(df, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.predicted == r.doc_id % 2 for r in held)
    assert quality.score(df.limit(0), labels).count() == 0
    assert {r.score for r in quality.score(df, labels.limit(0)).collect()} == {0.5}


def test_votes_as_a_plain_search():
    """Cosines and votes row by row, with ties at the last neighbour and blocks of any size."""
    rng = np.random.default_rng(31)
    labelled = rng.integers(-2, 3, (60, 4)).astype(np.float32)
    labelled = labelled[(labelled != 0).any(axis=1)]
    labelled = np.concatenate([labelled, labelled[:20]])  # equal vectors with other labels
    labelled /= np.linalg.norm(labelled, axis=1, keepdims=True)
    good = rng.integers(0, 2, len(labelled)).astype(float)
    docs = np.concatenate([labelled[:30], np.zeros((2, 4), np.float32), labelled[:30]])
    want = []
    for v in docs:
        cos = [round(float(np.dot(v.astype(float), x.astype(float))), 9) for x in labelled]
        best = sorted(range(len(cos)), key=lambda i: (-cos[i], i))[:7]
        w = [max(cos[i], 0) ** 4.0 for i in best]
        want.append((sum(x * good[i] for x, i in zip(w, best)) + 0.5 * 0.4) / (sum(w) + 0.5) if sum(w) else 0.4)
    for block in (1, 3, 256):
        got = quality._vote(labelled, good, 0.4, 7, 4.0, block)(docs)
        assert np.allclose(got, want, atol=2e-9) and (got[:30] == got[32:]).all()
    assert (quality._vote(labelled[:3], good[:3], 0.4, 7, 4.0, 2)(docs[:5]) >= 0).all()


def test_equal_texts_have_equal_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = docs.unionByName(docs.selectExpr("doc_id + 1000000 as doc_id", "text")).repartition(5)
    scores = {}
    for r in quality.score(more, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), keep=("text",)).collect():
        scores.setdefault(r.text, set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_as_sql(spark, name):
    d = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, d)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    ran = con.execute(ORACLES[name])
    cols = [c[0] for c in ran.description]
    assert values(got, *cols) == sorted(ran.fetchall(), key=str)


def test_pipeline_stages(spark, corpus):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.createDataFrame([(r[0], r[1], "en", "s", len(r[1] or "")) for r in corpus], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    d = "/root/testdata/sf0.001"
    kept = stages["MinHash near-dedup"](spark, docs, d)
    want = neardup.near_duplicates(docs, k=5).filter("kept").select("doc_id").distinct()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in want.collect()} and kept.columns == docs.columns
    assert sorted(stages["benchmark decontamination"](spark, docs, d).columns) == sorted(docs.columns)
    clean = stages["secret scans"](spark, docs, d)
    assert clean.count() == len(corpus) and clean.columns == docs.columns
    assert stages["BPE encoding and decoding"](spark, docs, d).count() == len(corpus)


def test_pipeline_run_keeps_what_brute_force_keeps(spark, tmp_path):
    """The whole chain over a small table with odd rows: no stage loses a row it has no reason to drop."""
    from tokenizers import Tokenizer

    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    first = docs.orderBy("doc_id").first()
    odd = [(700_001, first.text, "en", "s", 1), (700_002, None, None, None, None), (700_003, "", "en", "s", 0), (None, first.text, "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.orderBy("doc_id").limit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    got = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, d).collect())

    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = [(r.doc_id, r.text) for r in quality.score(docs, spark.read.parquet(f"{d}/labels.parquet"), keep=("text",)).filter("predicted = 1").collect()]
    sets = [(i, shingle_sets(t, 5)) for i, t in good if i is not None]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    root = roots({i for i, _ in sets}, links)
    single = [(i, t) for i, t in good if i is None or root[i] == i]
    assert 0 < len(single) < len(good) <= docs.count()
    leaks = decontaminate.passages(spark.createDataFrame(single, "doc_id long, text string"), spark.read.parquet(f"{d}/benchmark.parquet"))
    leaked = {r.doc_id for r in leaks.collect()}
    rest = [(i, t) for i, t in single if i is None or i not in leaked]
    masked = secrets.redact(secrets.scan(spark.createDataFrame(rest, "doc_id long, text string"))).select("doc_id", "text").collect()
    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    ids = [np.array(library.encode(r.text or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for r in masked]
    assert got == Counter((r.doc_id, hashlib.sha256(x).hexdigest()) for r, x in zip(masked, ids))


def test_pipeline_of_no_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0 if name == "documents" else 1000).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
