"""Long byte strings that repeat across documents, found by run-length indexes of the places where texts agree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.runindex import RunIndex, joined
from panelcast.llm.shingles import P1, P3, mixed
from panelcast.session import cut

ANCHOR = 24  # bytes of an anchor: short ones stand in many texts of a large table that share no window
ANCHOR_BITS = 40  # of its hash: anchors only bring windows together, so a rare false meeting costs time, not correctness
PIECE = 64  # windows of a piece at most
BLOCK_BYTES = 8_000_000  # of text, as a rule, that a task holds at once
INDEX_BYTES = 3_000_000  # of pieces, as a rule, in one index
HASH_BYTES = 1_000_000  # of pieces, as a rule, hashed together
STRETCH = 250_000  # places of texts that are hashed together
KINDS = 4096  # rows of a batch looked at together
ROWS = 2_000_000  # of anchors that are sorted together
KEYS = 2_000_000  # of windows, as a rule, sorted together


def window_hashes(b: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each place on: a polynomial put together from those of powers of two, mixed."""
    bits, power = b.astype(np.uint64) + np.uint64(1), int(P1)
    out, done, w = None, 0, 1
    while True:
        if width & w:
            n = max(0, len(b) - done - w + 1)
            out, done = bits[:n].copy() if out is None else out[:n] * np.uint64(power) + bits[done:done + n], done + w
        if w * 2 > width:
            break
        bits = bits[:-w] * np.uint64(power) + bits[w:] if len(bits) > w else bits[:0]
        power, w = power * power % (1 << 64), w * 2
    for shift, factor in ((33, P3), (29, P1)):  # as ``mixed`` does, in place
        out ^= out >> np.uint64(shift)
        out *= factor
    out ^= out >> np.uint64(32)
    return out


def anchor_hashes(b: np.ndarray, width: int) -> np.ndarray:
    return window_hashes(b, width) >> np.uint64(64 - ANCHOR_BITS)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    y, p = x, 1
    while p * 2 <= width:
        y, p = np.minimum(y[:-p], y[p:]), p * 2
    n = len(x) - width + 1
    return np.minimum(y[:n], y[width - p:width - p + n])


class Anchored:
    """The windows of ``length`` bytes of some texts. The anchor of a window is the least hash of the short strings in it, so
    equal windows have equal anchors; neighbours mostly share theirs."""

    def __init__(self, texts: list[bytes], length: int):
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.cumsum(lens) - lens
        self.length, width = length, min(ANCHOR, max(1, length * 4 // 5))
        n = len(self.data) - length + 1
        if n <= 0:
            self.anchor, self.owner, self.inside = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
            return
        self.anchor = np.empty(n, dtype=np.uint64)
        for lo in range(0, n, STRETCH):
            hashes = anchor_hashes(self.data[lo:lo + STRETCH + length - 1], width)
            self.anchor[lo:lo + STRETCH] = sliding_least(hashes, length - width + 1)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
        self.owner = owner[:n]
        self.inside = self.owner == owner[length - 1:]

    def pieces(self, chosen: np.ndarray | None = None, most: int = PIECE):
        """Runs of windows with one anchor, of ``most`` windows at most: first place, windows, anchor."""
        n = len(self.anchor)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        fresh = np.ones(n + 1, dtype=bool)
        fresh[1:n] = (self.anchor[1:] != self.anchor[:-1]) | (self.owner[1:] != self.owner[:-1]) | (self.inside[1:] != self.inside[:-1])
        edge = np.flatnonzero(fresh)
        first, count = edge[:-1], np.diff(edge)
        keep = self.inside[first]
        if chosen is not None:
            at = np.minimum(np.searchsorted(chosen, self.anchor[first]), max(0, len(chosen) - 1))
            keep &= (chosen[at] == self.anchor[first]) if len(chosen) else False
        first, count = first[keep], count[keep]
        parts = -(-count // most)
        which = np.repeat(np.arange(len(first)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = first[which] + nth * most
        return start, np.minimum(most, first[which] + count[which] - start), self.anchor[first[which]]


def _anchors(length: int):
    """(anchor, doc_id, name), once per text: what is compared across documents. Equal texts have equal names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            texts, lo, held = [], 0, 0
            for i, t in enumerate(b.column(1)):
                texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held > BLOCK_BYTES // 4 or i == b.num_rows - 1:
                    a = Anchored(texts, length)
                    at, _, anchor = a.pieces(most=1 << 40)
                    owner = a.owner[at].astype(np.uint64)
                    if len(texts) <= 1 << 64 - ANCHOR_BITS:  # by owner, then anchor
                        both = np.sort(owner << np.uint64(ANCHOR_BITS) | anchor)
                        owner, anchor = both >> np.uint64(ANCHOR_BITS), both & np.uint64((1 << ANCHOR_BITS) - 1)
                    new = np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))[:len(anchor)]
                    name = np.array([xxhash.xxh3_64_intdigest(x) for x in texts], dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[new].view(np.int64)), pa.array(ids[lo:][owner[new].astype(np.int64)]), pa.array(name[owner[new].astype(np.int64)])], ["anchor", "doc_id", "name"])
                    texts, lo, held = [], i + 1, 0
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, those whose anchor stands in several texts; the last column names the text. Rows of a group are
    passed on as they come; only one, of the smallest id, is held back until a second text shows up: of equal texts, later ones
    are not searched."""
    held: tuple[int, int, int] | None = None  # anchor, document and text of a group that has one text so far
    last = None  # anchor of the row before
    several = False
    for b in batches:
        a, d, w = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(b.num_columns - 1).to_numpy()
        if not len(a):
            continue
        fresh = np.append(a[0] != last, a[1:] != a[:-1])
        group = np.cumsum(fresh)  # 0: goes on from the batch before
        edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        lo, hi = np.minimum.reduceat(w, edge), np.maximum.reduceat(w, edge)
        many = lo < hi
        if group[0] == 0:
            many[0] |= several or lo[0] != held[2]
        keep = np.repeat(many, np.diff(np.append(edge, len(a))))
        out_a, out_d = a[keep], d[keep]
        if group[0] == 0 and many[0] and not several:
            out_a, out_d = np.append(out_a, held[0]), np.append(out_d, held[1])
        last, several = int(a[-1]), bool(many[-1])
        least = int(d[edge[-1]:].min())
        if several:
            held = None
        else:
            held = (last, min(least, held[1]) if group[-1] == 0 else least, int(w[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(out_a), pa.array(out_d)], ["anchor", "doc_id"])


def _shared_unsorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_shared``, of rows in any order, where all rows of an anchor are. After ROWS of them, each anchor keeps one row of its
    text, or two of different texts; the others have been passed on, or have the same text and a larger id."""
    held: list[tuple[np.ndarray, ...]] = []
    n, kept = 0, 0

    def ordered() -> tuple[np.ndarray, ...]:
        a, d, w = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(a)
        return a[order], d[order], w[order]

    def told(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        return _shared(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["anchor", "doc_id", "name"])]))

    for b in batches:
        if not b.num_rows:
            continue
        held.append(tuple(b.column(j).to_numpy() for j in range(3)))
        n += b.num_rows
        if n - kept > ROWS:
            a, d, w = ordered()
            yield from told((a, d, w))
            order = np.lexsort((d, w, a))
            a, d, w = a[order], d[order], w[order]
            fresh = np.append(True, a[1:] != a[:-1])
            stay = fresh | (np.append(fresh[1:], True) & (w != np.repeat(w[fresh], np.diff(np.append(np.flatnonzero(fresh), len(a))))))
            held = [(a[stay], d[stay], w[stay])]
            n = kept = int(stay.sum())
    if held:
        yield from told(ordered())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a batch that go to one block, compressed together, with ids and lengths."""
    press = zstandard.ZstdCompressor(level=3).compress
    for whole in batches:
        for i in range(0, whole.num_rows, 10_000):
            b = whole.slice(i, 10_000)
            block = b.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            shares = np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []
            for share in shares:
                texts = [(b.column(2)[j].as_py() or "").encode("utf-8", "surrogatepass") for j in share.tolist()]
                head = np.array([b.column(1).to_numpy()[share], [len(t) for t in texts]], dtype="<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block[share[0]]], pa.int64()), pa.array([head.tobytes()], pa.binary()), pa.array([press(b"".join(texts))], pa.binary())],
                    ["block", "head", "packed"])


def _opened(t: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """The documents of a block in the order that numbers them: by id, then text."""
    open_ = zstandard.ZstdDecompressor().decompress
    rows = []
    for head, packed in zip(t.column("head").to_pylist(), t.column("packed").to_pylist()):
        ids, lens = np.frombuffer(head, dtype="<i8").reshape(2, -1)
        data, ends = open_(packed), np.cumsum(lens)
        rows += [(i, data[e - n:e]) for i, n, e in zip(ids.tolist(), lens.tolist(), ends.tolist())]
    rows.sort()
    return np.array([i for i, _ in rows], dtype=np.int64), [x for _, x in rows]


def _copies(t: pa.Table, ids: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which documents have the whole text of an earlier one; ``t`` has their ids and the checksums of their texts."""
    named = set(zip(t.column("doc_id").to_pylist(), t.column("name").to_pylist()))
    some = {i for i, _ in named}
    return np.array([i in some and (i, hashlib.sha256(x).hexdigest()) in named for i, x in zip(ids.tolist(), texts)], dtype=bool)


def _pieces(length: int):
    """Cuts out of a block what lies around its shared anchors."""
    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        ids, texts = _opened(docs)
        copy = _copies(anchors.filter(pc.is_valid(anchors.column("name"))), ids, texts)
        a = Anchored([b"" if c else x for c, x in zip(copy, texts)], length)
        chosen = np.unique(anchors.column("anchor").drop_null().to_numpy().view(np.uint64))
        at, windows, anchor = a.pieces(chosen)
        lens = windows + length - 1
        data, edges = joined(a.data, at, lens), np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        piece = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        owner = a.owner[at] if len(at) else at
        return pa.table({"anchor": pa.array(anchor.view(np.int64)), "piece": piece, "doc_id": pa.array(ids[owner] if len(at) else at, pa.int64()),
                         "nth": pa.array(owner, pa.int32()), "at": pa.array(at - a.begin[owner] if len(at) else at, pa.int64())})
    return run


class Earlier:
    """Marks windows that stand in earlier documents, for pieces sorted by anchor, piece and document.

    Equal pieces are one class; its first document decides. A later document of the class has every window earlier. For the
    first one, windows of an anchor meet by a hash. Of each hash that several first documents have, the first window of the
    earliest one goes into a run-length index, and the windows of later documents are streamed through it, in runs of
    neighbours: those found whole in the index are marked. So a window is indexed once and streamed once, however many pieces
    an anchor has. A window that is streamed but not found has the hash of a different one; its anchor goes to ``_halved``,
    which needs no hash of windows.
    """

    def __init__(self, length: int):
        self.length = length
        self.held: list[tuple[np.ndarray, ...]] = []  # anchors, bytes, sizes and documents of classes
        self.rows: list[tuple[np.ndarray, ...]] = []  # class, nth, at of rows of the first document
        self.last: int | None = None  # anchor
        self.count = self.bytes = 0

    def extend(self, anchors: np.ndarray, data: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> None:
        if len(sizes):
            self.held.append((anchors, data, sizes, docs))
            self.count += len(sizes)
            self.bytes += len(data)
            self.last = int(anchors[-1])

    def add(self, anchor: int, piece: bytes, doc: int) -> None:
        one = lambda x: np.array([x], dtype=np.int64)
        self.extend(one(anchor), np.frombuffer(piece, dtype=np.uint8), one(len(piece)), one(doc))

    def _all(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.held) > 1:
            self.held = [tuple(np.concatenate(x) for x in zip(*self.held))]
        return self.held[0]

    def marks(self) -> list[np.ndarray]:
        """Per class, which windows stand in a class of the same anchor with an earlier first document."""
        sizes = self._all()[2]
        begin, found = np.cumsum(sizes) - sizes, self._found()
        return [found[s:s + n - self.length + 1] for s, n in zip(begin, sizes)]

    def spans(self) -> tuple[np.ndarray, ...]:
        """(doc_id, nth, start, end) of stretches of marked windows in the rows."""
        _, _, sizes, docs = self._all()
        begin, (start, windows) = np.cumsum(sizes) - sizes, self._runs(self._found())
        holder = np.searchsorted(begin, start, side="right") - 1
        first, last = np.searchsorted(holder, np.arange(len(sizes))), np.searchsorted(holder, np.arange(len(sizes)), side="right")
        kind, nth, at = (np.concatenate(x) for x in zip(*self.rows))
        times = (last - first)[kind]
        row = np.repeat(np.arange(len(kind)), times)
        which = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + first[kind[row]]
        lo = at[row] + start[which] - begin[kind[row]]
        return docs[kind[row]], nth[row], lo, lo + windows[which] - 1 + self.length

    def _runs(self, flag: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First place and length of runs of flagged neighbours in one class, and in one group where given."""
        sizes = self._all()[2]
        edge = np.zeros(len(flag), dtype=bool)
        edge[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        at = np.flatnonzero(flag)
        fresh = np.append(True, (at[1:] != at[:-1] + 1) | edge[at[1:]])[:len(at)]
        if group is not None:
            fresh[1:] |= group[1:] != group[:-1]
        head = np.flatnonzero(fresh)
        return at[head], np.diff(np.append(head, len(at)))

    def _origins(self) -> np.ndarray:
        """For each byte, if the window there has a hash that a window of the same anchor and of an earlier document has: the
        place of the earliest such one, else -1. The windows of many classes are taken in turns, each of a share of the hashes."""
        anchors, data, sizes, docs = self._all()
        begin, windows = np.cumsum(sizes) - sizes, np.maximum(0, sizes - self.length + 1)
        turns = max(1, -(-int(windows.sum()) // KEYS))
        share = begin // HASH_BYTES
        parts = np.split(np.arange(len(sizes)), np.flatnonzero(share[1:] != share[:-1]) + 1)
        origins = np.full(len(data), -1, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        for turn in range(turns if len(sizes) else 0):
            keys, places, owners = [], [], []
            for some in parts:
                lo, hi = begin[some[0]], begin[some[-1]] + sizes[some[-1]]
                h, owner = window_hashes(data[lo:hi], self.length), np.repeat(some, windows[some])
                place = np.arange(len(owner)) + np.repeat(begin[some] - (np.cumsum(windows[some]) - windows[some]), windows[some])
                key = mixed(h[place - lo] ^ np.repeat(mixed(anchors[some].view(np.uint64)), windows[some]))
                if turns > 1:
                    now = key % np.uint64(turns) == np.uint64(turn)
                    key, place, owner = key[now], place[now], owner[now]
                keys.append(key)
                places.append(place)
                owners.append(owner)
            key, place, owner = np.concatenate(keys), np.concatenate(places), np.concatenate(owners)
            order = np.argsort(key)
            key = key[order]
            same = np.concatenate([[False], key[1:] == key[:-1], [False]])
            some = np.flatnonzero(same[1:] | same[:-1])  # of hashes that come more than once
            place, doc = place[order[some]], docs[owner[order[some]]]
            edge = np.flatnonzero(~same[some])
            if not len(edge):
                continue
            times = np.diff(np.append(edge, len(some)))
            least = np.repeat(np.minimum.reduceat(doc, edge), times)
            origin = np.repeat(np.minimum.reduceat(np.where(doc == least, place, len(data)), edge), times)
            origins[place[doc > least]] = origin[doc > least]
        return origins

    def _found(self) -> np.ndarray:
        """Places of bytes where a marked window begins."""
        anchors, data, sizes, docs = self._all()
        found = np.zeros(len(data), dtype=bool)
        origins = self._origins()
        later = np.flatnonzero(origins >= 0)
        if not len(later):
            return found
        earliest = origins[later]
        del origins
        begin, lane = np.cumsum(sizes) - sizes, np.unique(anchors, return_inverse=True)[1].ravel()
        lane_of = lambda start: lane[np.searchsorted(begin, start, side="right") - 1]
        flag = np.zeros(len(data), dtype=bool)
        flag[earliest] = True
        old, windows = self._runs(flag)
        old_lens, old_lanes = windows + self.length - 1, lane_of(old)
        share = (np.cumsum(old_lens) - old_lens) // INDEX_BYTES
        goes_to = share[np.searchsorted(old, earliest, side="right") - 1]
        flag[:] = False
        flag[later] = True
        new, windows = self._runs(flag, goes_to)
        new_lens, new_lanes, new_share = windows + self.length - 1, lane_of(new), goes_to[np.searchsorted(later, new)]
        for k in np.unique(share):
            there, streamed = np.flatnonzero(share == k), np.flatnonzero(new_share == k)
            least = old_lanes[there].min()
            index = RunIndex(joined(data, old[there], old_lens[there]), old_lens[there], old_lanes[there] - least)
            part = np.cumsum(new_lens[streamed]) // INDEX_BYTES
            for some in np.split(streamed, np.flatnonzero(part[1:] != part[:-1]) + 1):
                for live, place, n in index.statistics(joined(data, new[some], new_lens[some]), new_lens[some], new_lanes[some] - least):
                    long = n >= self.length
                    found[new[some[live[long]]] + place[long]] = True
        if not found[later].all():
            again = np.isin(lane, lane_of(later[~found[later]]))
            self._halved(np.flatnonzero(again), found)
        return found

    def _halved(self, live: np.ndarray, found: np.ndarray) -> None:
        """Marks the windows of some classes by indexes alone. The classes of an anchor are numbered by first document, and
        halved by the bits of that number: the earlier half of each pair of blocks goes into an index, the later half is
        streamed through it. Classes that share no longer anchor (of 4/5 of a window) with another one of their anchor hold no
        equal windows, and stay out."""
        anchors, data, sizes, docs = self._all()
        begin = np.cumsum(sizes) - sizes
        live = live[self._meeting(joined(data, begin[live], sizes[live]), np.cumsum(sizes[live]) - sizes[live], sizes[live], anchors[live])]
        anchors, docs, lens, starts = anchors[live], docs[live], sizes[live], begin[live]
        order = np.lexsort((docs, anchors))
        a, d = anchors[order], docs[order]
        fresh = np.append(True, a[1:] != a[:-1])[:len(a)]
        step = np.append(True, (d[1:] != d[:-1]) | fresh[1:])[:len(a)]
        number = np.cumsum(step)
        rank, group = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
        group[order] = np.cumsum(fresh)
        rank[order] = number - np.repeat(number[fresh], np.diff(np.append(np.flatnonzero(fresh), len(a))))
        for bit in range(int(rank.max()).bit_length() if len(rank) else 0):
            block = np.unique(np.stack([group, rank >> (bit + 1)]), axis=1, return_inverse=True)[1].ravel()
            later = (rank >> bit & 1).astype(bool)
            both = np.zeros(block.max() + 1, dtype=np.int64)
            np.bitwise_or.at(both, block, np.where(later, 2, 1))
            use = both[block] == 3
            lanes = np.cumsum(both == 3)[block]
            for some in self._shares(use, lanes, lens):
                old, new = some[~later[some]], some[later[some]]
                index = RunIndex(joined(data, starts[old], lens[old]), lens[old], lanes[old] - lanes[some].min())
                for live, place, n in index.statistics(joined(data, starts[new], lens[new]), lens[new], lanes[new] - lanes[some].min()):
                    long = n >= self.length
                    found[starts[new[live[long]]] + place[long]] = True

    def _meeting(self, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """The classes that share a longer anchor with another class of their anchor; equal windows have equal ones."""
        wide = max(1, self.length * 4 // 5)
        keys, owners = [], []
        share = begin // HASH_BYTES
        for some in np.split(np.arange(len(sizes)), np.flatnonzero(share[1:] != share[:-1]) + 1):
            if not len(some):
                continue
            lo, hi = begin[some[0]], begin[some[-1]] + sizes[some[-1]]
            least = sliding_least(anchor_hashes(data[lo:hi], wide), self.length - wide + 1)
            windows = sizes[some] - self.length + 1
            owner = np.repeat(some, windows)
            least = least[np.arange(len(owner)) + np.repeat(begin[some] - lo - (np.cumsum(windows) - windows), windows)]
            fresh = np.append(True, (owner[1:] != owner[:-1]) | (least[1:] != least[:-1]))
            owners.append(owner[fresh])
            keys.append(mixed(least[fresh] ^ mixed(anchors[owner[fresh]].view(np.uint64))))
        if not keys:
            return np.zeros(0, np.int64)
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")  # owners stay in order
        key, owner = key[order], owner[order]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(edge, len(key)))
        return np.unique(owner[np.repeat(owner[edge] != owner[edge + count - 1], count)])

    @staticmethod
    def _shares(use: np.ndarray, lanes: np.ndarray, lens: np.ndarray) -> Iterator[np.ndarray]:
        """The used classes lane by lane, in shares of about INDEX_BYTES."""
        at = np.flatnonzero(use)
        at = at[np.argsort(lanes[at], kind="stable")]
        if not len(at):
            return
        share = (np.cumsum(lens[at]) // INDEX_BYTES)
        first = np.append(True, lanes[at][1:] != lanes[at][:-1])
        share = share[first][np.cumsum(first) - 1]
        yield from np.split(at, np.flatnonzero(share[1:] != share[:-1]) + 1)


def _removals(length: int):
    """(doc_id, nth, start, end) of removed bytes, from pieces sorted by anchor, piece and document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Earlier(length)
        last: tuple = (None, None, None)

        def out(doc, nth, start, end) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                ["doc_id", "nth", "start", "end"])

        for whole in batches:
            for i in range(0, whole.num_rows, KINDS):
                b = whole.slice(i, KINDS)
                anchor, doc, nth, at = (b.column(j).to_numpy() for j in (0, 2, 3, 4))
                piece = b.column(1)
                same = np.zeros(b.num_rows, dtype=bool)
                same[1:] = pc.equal(piece.slice(1), piece.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False) & (anchor[1:] == anchor[:-1])
                same[0] = last[0] == anchor[0] and last[1] == piece[0].as_py()
                head = np.flatnonzero(~same)
                # a class alone with its anchor meets no other; the last class of the slice may go on
                near = np.concatenate([[last[0] is not None and last[0] == anchor[0]], anchor[head[1:]] == anchor[head[:-1]], [True]]) if len(head) else np.ones(1, bool)
                alone = np.append(False, ~(near[:-1] | near[1:]))
                skip = alone[np.cumsum(~same)]
                first = np.repeat(np.append(np.int64(last[2] or 0), doc[head]), np.diff(np.concatenate([[0], head, [len(doc)]])))
                later = doc > first
                size = pc.binary_length(piece).to_numpy().astype(np.int64)
                yield out(doc[later], nth[later], at[later], (at + size)[later])
                rows = np.flatnonzero(~later & ~skip)
                shares = [rows]
                if state.bytes > INDEX_BYTES:
                    other = np.flatnonzero(~same[rows] & (anchor[rows] != state.last))[:1]
                    shares = np.split(rows, other)
                for n, some in enumerate(shares):
                    if n:
                        yield out(*state.spans())
                        state = Earlier(length)
                    fresh = ~same[some]
                    heads, kind = some[fresh], state.count + np.cumsum(fresh) - 1
                    _, offsets, data = pc.take(piece, pa.array(heads)).buffers() if len(heads) else (None, None, None)
                    if len(heads) and data is not None:
                        state.extend(anchor[heads], np.frombuffer(data, dtype=np.uint8, count=int(size[heads].sum())), size[heads], doc[heads])
                    state.rows.append((kind, nth[some], at[some]))
                last = (int(anchor[-1]), piece[-1].as_py(), int(first[-1]))
        if state.count:
            yield out(*state.spans())
    return run


def _cleaned(length: int, texts: bool):
    """Results of a block: spans merged, and what they leave."""
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        ids, raw = _opened(docs)
        copied = spans.column("name").is_valid()
        copy = np.flatnonzero(_copies(spans.filter(copied), ids, raw))
        copy = copy[np.array([len(raw[c]) >= length for c in copy], dtype=bool)]
        spans = spans.filter(pc.invert(copied))
        nth, start, end = (spans.column(c).to_numpy() for c in ("nth", "start", "end"))
        nth, start, end = np.append(nth, copy), np.append(start, copy * 0), np.append(end, np.array([len(raw[c]) for c in copy], dtype=np.int64))
        order = np.lexsort((start, nth))
        nth, start, end = nth[order], start[order], end[order]
        edges = np.searchsorted(nth, np.arange(len(raw) + 1))
        removed, counts, kept, sums = [], [], [], []
        for k, t in enumerate(raw):
            merged: list[list[int]] = []
            for s, e in zip(start[edges[k]:edges[k + 1]].tolist(), end[edges[k]:edges[k + 1]].tolist()):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            bounds = [0, *[x for m in merged for x in m], len(t)]
            rest = b"".join(t[a:b] for a, b in zip(bounds[::2], bounds[1::2])) if merged else t
            removed.append([{"start": s, "end": e} for s, e in merged])
            counts.append(len(t) - len(rest))
            kept.append(rest)
            sums.append(hashlib.sha256(rest).hexdigest())
        cols = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in raw], pa.int64()), "n_removed": pa.array(counts, pa.int64()),
                "n_spans": pa.array([len(r) for r in removed], pa.int64()), "kept_sha256": pa.array(sums, pa.string())}
        if texts:
            cols |= {"removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())}
        return pa.table(cols)
    return run


def dedup(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and with ``texts`` also
    ``removed`` (spans in bytes, ends exclusive) and ``kept`` (the bytes that stay).

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Texts are taken as
    UTF-8 bytes as they came in; matches never cross documents.

    0. Of equal texts only those with the smallest id are searched; the later ones go whole (if they have a window).
    1. Every window gets an anchor; equal windows have equal ones. Anchors that stand in one text alone (by a 64-bit hash of it) drop out. Their
       rows are sorted in parts of ROWS; from one part to the next an anchor keeps two rows at most, whatever the size of its group.
    2. Around the others, pieces are cut out and meet by anchor. Equal pieces of later documents are removed at once; the
       first ones of different pieces are matched by run-length indexes (``Earlier``), each window indexed or streamed once.
    3. Removed spans and texts meet by block of documents.

    A task holds a block of texts (about ``BLOCK_BYTES``, or one longer document) or the different pieces of one anchor, as bytes.
    Null and empty texts have no bytes. Rows without an id neither remove nor lose anything. Rows with equal ids are no earlier
    ones of each other. Repeated rows come back as often as they came; other columns are not read; no rows give no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    named = rows.filter("doc_id is not null")
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    packed = named.select(block, "doc_id", "text").mapInArrow(_pack, "block long, head binary, packed binary")
    text_name = F.sha2(F.coalesce("text", F.lit("")), 256)
    firsts = named.filter(F.octet_length("text") >= length).groupBy(text_name.alias("name")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = cut(named.filter(F.octet_length("text") >= length).select("doc_id", text_name.alias("name")).join(firsts, "name")
                 .filter("doc_id > first").select(block, "doc_id", "name").distinct())

    anchors = named.mapInArrow(_anchors(length), "anchor long, doc_id long, name long").repartition(-(-blocks // 2), "anchor")
    shared = anchors.mapInArrow(_shared_unsorted, "anchor long, doc_id long").select(block, "anchor")
    both = cut(shared, release=True).unionByName(copies, allowMissingColumns=True)
    pieces = packed.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(
        _pieces(length), "anchor long, piece binary, doc_id long, nth int, at long")
    sorted_pieces = pieces.repartition("anchor").sortWithinPartitions("anchor", "piece", "doc_id")
    spans = cut(sorted_pieces.mapInArrow(_removals(length), "doc_id long, nth int, start long, end long"), release=True)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", removed array<struct<start:long,end:long>>, kept binary" * texts
    found = spans.select(block, "nth", "start", "end").unionByName(copies, allowMissingColumns=True)
    cleaned = packed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cleaned(length, texts), schema)
    plain = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    n = F.octet_length(plain).cast("long")
    zero = F.lit(0).cast("long")
    alone = rows.filter("doc_id is null").select(
        "doc_id", n.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(plain, 256).alias("kept_sha256"),
        *([F.array().cast("array<struct<start:long,end:long>>").alias("removed"), plain.alias("kept")] if texts else []))
    return cleaned.unionByName(alone)
