"""A run-length index of short byte strings: run-compressed Burrows-Wheeler transform, sampled run ends, matching statistics."""

from __future__ import annotations

import numpy as np

ABSENT = np.int64(-1)
FIRST_BYTES = 5  # of a suffix that the first sort key holds, besides the lane


def joined(parts: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices ``parts[starts[i]:starts[i] + lens[i]]`` one after the other."""
    total = int(lens.sum())
    if not total:
        return parts[:0]
    at = np.ones(total, dtype=np.int64)
    ends = np.cumsum(lens)
    full = lens > 0
    heads = (ends - lens)[full]
    at[heads] = starts[full]
    at[heads[1:]] -= (starts[full] + lens[full] - 1)[:-1]
    return parts[np.cumsum(at)]


class RunIndex:
    """Index of strings that each lie in a lane; a string is found in its own lane only.

    The strings stand in one text, each with an end mark. A symbol is a byte together with its lane, so one transform holds
    all lanes side by side. Suffixes are sorted by prefix doubling. What is kept is per run of equal symbols: its first row,
    its symbol, the row its first symbol comes from, and the text positions of its first and last row.
    """

    def __init__(self, data: np.ndarray, lens: np.ndarray, lanes: np.ndarray):
        count = len(lens)
        widths = lens + 1
        ends = np.cumsum(widths)
        starts = ends - widths
        n = int(ends[-1])
        text = np.zeros(n, dtype=np.int64)  # 0 is the end mark
        inside = np.ones(n, dtype=bool)
        inside[ends - 1] = False
        text[inside] = data.astype(np.int64) + 1
        lane = np.repeat(lanes.astype(np.int64), widths)
        self.symbol = lane * 257 + text
        self.text, self.size = text, n
        left = np.repeat(ends, widths) - np.arange(n)  # to the end of the string, its mark included
        order = self._suffixes(text, lane, left, int(widths.max()))
        before = np.where(np.isin(order, starts, assume_unique=True), ABSENT, self.symbol[order - 1])
        head = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.head, self.run = head, before[head]
        tail = np.append(head[1:], n) - 1
        self.head_text, self.tail_text = order[head], order[tail]
        first = np.sort(self.symbol)  # rows in order of their first symbol
        by = np.lexsort((head, self.run))
        sizes = (tail - head + 1)[by]
        so_far = np.cumsum(sizes) - sizes
        sym = self.run[by]
        fresh = np.append(True, sym[1:] != sym[:-1])
        inner = so_far - np.repeat(so_far[fresh], np.diff(np.append(np.flatnonzero(fresh), len(sym))))
        self.source = np.empty(len(head), dtype=np.int64)
        self.source[by] = np.searchsorted(first, sym) + inner
        self.by, self.by_key = by, sym * len(head) + by
        padded = np.concatenate([text, np.zeros(8, np.int64)]).astype(np.uint64)
        self.words = self._packed(padded)
        self.count = count

    @staticmethod
    def _packed(symbols: np.ndarray) -> np.ndarray:
        """Seven symbols (of nine bits) from each place on, in one number."""
        n = len(symbols) - 7
        out = np.zeros(n, dtype=np.uint64)
        for j in range(7):
            out = (out << np.uint64(9)) | symbols[j:n + j]
        return out

    @staticmethod
    def _suffixes(text: np.ndarray, lane: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
        """Rows in order: by lane, then by the suffix up to its end mark, equal ones by place."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(FIRST_BYTES, np.int64)])
        key = lane.copy()
        alive = np.ones(n, dtype=bool)
        for j in range(FIRST_BYTES):
            alive &= left > j
            key = key * 257 + np.where(alive, padded[j:n + j], 0)
        order = np.argsort(key, kind="stable")
        width = FIRST_BYTES
        while True:
            sorted_key = key[order]
            fresh = np.append(True, sorted_key[1:] != sorted_key[:-1])
            if width >= longest or fresh.all():
                return order
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(fresh)
            after = np.zeros(n, dtype=np.int64)
            reach = np.flatnonzero(left > width)
            after[reach] = rank[reach + width]
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            width *= 2

    def _common(self, query: np.ndarray, q: np.ndarray, q_left: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the query from q and the text from t."""
        out = np.zeros(len(q), dtype=np.int64)
        going = np.arange(len(q))
        while len(going):
            a, b = query[q[going] + out[going]], self.words[np.minimum(t[going] + out[going], self.size - 1)]
            same = a == b
            diff = (a ^ b)[~same]
            out[going[~same]] += sum((diff < np.uint64(1 << b)).astype(np.int64) for b in range(9, 63, 9))
            out[going[same]] += 7
            going = going[same]
            going = going[(out[going] < q_left[going]) & (t[going] + out[going] < self.size)]
        return np.minimum(out, q_left)

    def statistics(self, data: np.ndarray, lens: np.ndarray, lanes: np.ndarray):
        """Streams strings through the index, right to left and all in step. Yields (strings, place in them, length), where
        length is that of the longest match that starts there and lies in a string of the lane."""
        ends = np.cumsum(lens)
        starts = ends - lens
        total = int(ends[-1]) if len(ends) else 0
        query = self._packed(np.concatenate([data.astype(np.uint64) + np.uint64(1), np.full(8, 400, np.uint64)]))
        by_len = np.argsort(-lens, kind="stable")
        row = np.zeros(len(lens), dtype=np.int64)
        length = np.zeros(len(lens), dtype=np.int64)
        runs = len(self.head)
        for step in range(int(lens.max()) if total else 0):
            live = by_len[:np.searchsorted(-lens[by_len], -step, side="left")]
            at = ends[live] - 1 - step
            symbol = lanes[live] * 257 + data[at].astype(np.int64) + 1
            r = row[live]
            k = np.searchsorted(self.head, r, side="right") - 1
            hit = (self.run[k] == symbol) & (length[live] > 0)
            new_row, new_len = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
            new_row[hit] = self.source[k[hit]] + r[hit] - self.head[k[hit]]
            new_len[hit] = length[live[hit]] + 1
            miss = np.flatnonzero(~hit)
            if len(miss):
                new_row[miss], new_len[miss] = self._jump(query, at[miss] + 1, ends[live[miss]] - at[miss] - 1, symbol[miss], k[miss], runs)
            row[live], length[live] = new_row, new_len
            yield live, lens[live] - 1 - step, new_len

    def _jump(self, query, q, q_left, symbol, k, runs):
        """The nearest rows before and after whose symbol fits stand at ends of runs, whose text places are sampled: the
        one that shares more with the query is where the match goes on."""
        nxt = np.searchsorted(self.by_key, symbol * runs + k, side="left")
        row, best = np.zeros(len(q), np.int64), np.full(len(q), -1, np.int64)
        for place, texts, last in ((nxt, self.head_text, False), (nxt - 1, self.tail_text, True)):
            inside = (place >= 0) & (place < runs)
            run = self.by[np.where(inside, place, 0)]
            ok = np.flatnonzero(inside & (self.run[run] == symbol))
            run = run[ok]
            if not len(ok):
                continue
            shared = self._common(query, q[ok], q_left[ok], texts[run])
            size = np.append(self.head[1:], self.size)[run] - self.head[run] if last else 1
            better = shared > best[ok]
            row[ok[better]] = (self.source[run] + size - 1)[better]
            best[ok[better]] = shared[better]
        return row, best + 1
