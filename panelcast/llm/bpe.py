"""Byte-pair encoding as a deterministic automaton over tokens, compiled from the merge list merge by merge."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

START = -1
NEVER = 1 << 60
beyond_latin = re.compile("[^\0-\u024f]").search
WORD_CACHE = 500_000  # words remembered by a task; the automaton answers the others again
GROUP_CHARS = 1_000_000  # of texts that a task splits before it encodes their new words, or one longer text
BLOCK_LETTERS = 1 << 18  # of words that take their transitions together
LONG_WORD = 128  # letters; a longer word takes its transitions by itself
PAIR_SLOTS = 20  # bits; answered pairs of tokens that a task remembers
BATCH_BYTES = 2_000_000  # of ids that a task holds before it passes them on, or those of one longer text


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others take the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def latin_words(pattern: str):
    """The function that finds the words of a pattern in lower-cased text up to U+024F. Where the pattern names properties inside
    brackets only, the letters that can stand there are spelled out for ``re``, which takes half the time."""
    names = (r"\p{L}", r"\p{N}", r"\s")
    bare = pattern
    for name in names:
        bare = bare.replace(name, "")
    if any(x in bare for x in ("\\", "(?", "[[", "&&", "--", "||", "~~")) or "\\" in re.sub(r"\[[^]]*\]", "", pattern):
        return regex.compile(pattern).findall
    letters = sorted(set("".join(map(chr, range(0x250))).lower()))
    for name in names:
        pattern = pattern.replace(name, "".join(re.escape(c) for c in letters if regex.match(name, c)))
    return re.compile(pattern).findall


class MergeAutomaton:
    """The automaton whose paths are exactly the token sequences that the merge rules produce.

    Construction. It starts with one state that loops over the base symbols. The gadget for the k-th merge (u, v) -> w does,
    wherever an arc u leads to a state with an arc v: add an arc w past both, and let u lead to a copy of that state without
    its arc v. Each state is then known by the token that leads to it, so the gadgets are kept as three tables: the parts and
    the creation time of w, and the time at which the arc v behind u was removed. ``arc`` reads the arcs of the finished
    automaton from these tables: w got its incoming arcs from u, and its outgoing ones from v, as they were at that time.

    Encoding. Left to right, each prefix of a word has one state that a path spells; ``encode`` fills that table with one
    transition per token ending at the position. Arc labels spelled in order give the text back. ``encode_all`` does so for
    many words at once, position by position, on compiled arrays: the tables of the gadgets, and the tokens that label any
    arc as a trie read from their last letter.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.vocab, self.word_end = vocab, word_end
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        self.removed: dict[tuple[int, int], int] = {}
        self.longest = max(map(len, vocab), default=1)
        for k, (a, b) in enumerate(merges):
            self._gadget(vocab[a], vocab[b], vocab[a + b], k)
        self._arcs: dict[tuple[int, int], bool] = {}
        self._compile()

    def _compile(self) -> None:
        """Arrays by token (creation time, first and last part), removed pairs in order, and the levels of the trie."""
        self.width = max(self.vocab.values(), default=0) + 1
        self.made_at, self.first, self.last = np.full(self.width, -1), np.zeros(self.width, int), np.zeros(self.width, int)
        made = np.array(list(self.made), int)
        self.made_at[made] = list(self.made.values())
        self.first[made], self.last[made] = np.array(list(self.parts.values()), int).reshape(-1, 2).T
        pairs = np.array(list(self.removed), int).reshape(-1, 2)
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        order = np.argsort(keys)
        self.gone = np.append(keys[order], NEVER), np.append(np.array(list(self.removed.values()), int)[order], NEVER)
        labels = dict.fromkeys(self.vocab.values(), True)  # tokens that label any arc
        for w, ok in zip(self.made, self._follow_all(self.first[made], self.last[made], self.made_at[made]).tolist()):
            u, v = self.parts[w]
            labels[w] = ok and labels[u] and labels[v]
        end = self.word_end
        tokens = [(k[:len(k) - len(end)], 1, t) if end and k.endswith(end) else (k, 0, t) for k, t in self.vocab.items() if labels[t]]
        letters, node, ids = ([*x] for x in zip(*(x for x in tokens if x[0]))) if tokens else ([], [], [])
        sizes, codes = np.array([len(x) for x in letters], int), self._codes(letters)
        last, node, ids = np.cumsum(sizes) - 1, np.array(node, int), np.array(ids, int)
        self.levels = []
        while len(ids):
            keys, node = np.unique(node << 21 | codes[last - len(self.levels)], return_inverse=True)
            whole = sizes == len(self.levels) + 1
            token = np.full(len(keys) + 1, -1)
            token[node[whole]] = ids[whole]
            self.levels.append((np.append(keys, NEVER), token))
            last, node, ids, sizes = last[~whole], node[~whole], ids[~whole], sizes[~whole]
        self.answered = np.full(1 << PAIR_SLOTS, -1)

    @staticmethod
    def _codes(letters: list[str]) -> np.ndarray:
        return np.frombuffer("".join(letters).encode("utf-32-le"), "<u4").astype(np.int64)

    def _gadget(self, u: int, v: int, w: int, k: int) -> None:
        self.removed.setdefault((u, v), k)
        if w not in self.made:
            self.made[w], self.parts[w] = k, (u, v)

    def arc(self, a: int, b: int) -> bool:
        """Whether b may follow a in the finished automaton."""
        if a == START:
            return True
        known = self._arcs.get((a, b))
        if known is None:
            if len(self._arcs) > 4_000_000:
                self._arcs.clear()
            known = self._arcs[a, b] = self._follow(a, b)
        return known

    def _follow(self, a: int, b: int, limit: int = NEVER) -> bool:
        """Whether b could follow a before the gadget of time ``limit``."""
        inclusive = False
        while True:
            gone = self.removed.get((a, b), NEVER)
            if gone < limit or (inclusive and gone == limit):
                return False
            ta, tb = self.made.get(a, -1), self.made.get(b, -1)
            if ta < 0 and tb < 0:
                return True
            if ta == tb:  # w after w: as u after v before the gadget
                limit, inclusive, a, b = ta, False, self.parts[a][1], self.parts[b][0]
            elif tb > ta:  # b is the younger: its arcs are those of its first part, after the gadget took arcs away
                limit, inclusive, b = tb, True, self.parts[b][0]
            else:  # what follows a is what followed its last part, before the gadget
                limit, inclusive, a = ta, False, self.parts[a][1]

    def _follow_all(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """``_follow`` for pairs of tokens at once."""
        out, row = np.zeros(len(a), bool), np.arange(len(a))
        keys, times = self.gone
        while len(row):
            pair = a * self.width + b
            at = np.searchsorted(keys, pair)
            alive = (keys[at] != pair) | (times[at] >= limit)
            ta, tb = self.made_at[a], self.made_at[b]
            base = (ta < 0) & (tb < 0)
            out[row[alive & base]] = True
            on = alive & ~base
            row, a, b, ta, tb = row[on], a[on], b[on], ta[on], tb[on]
            limit = np.maximum(ta, tb) + (tb > ta)
            a, b = np.where(ta >= tb, self.last[a], a), np.where(tb >= ta, self.first[b], b)
        return out

    def arcs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``arc`` for pairs of tokens at once. A pair and its answer share one number in the slot of the pair."""
        pair = a * self.width + b
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_SLOTS)).astype(np.int64)
        known = self.answered[slot]
        new = np.flatnonzero(known >> 1 != pair)
        if len(new):
            asked, where = np.unique(pair[new], return_inverse=True)
            known[new] = (asked << 1 | self._follow_all(asked // self.width, asked % self.width, np.full(len(asked), NEVER)))[where]
            self.answered[slot[new]] = known[new]
        return known & 1 == 1

    def encode_all(self, words: list[str]) -> list[bytes]:
        """``encode`` for many words at once: token ids of each as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        block, held = [], 0
        for i in sorted(range(len(words)), key=lambda i: len(words[i])):
            n = len(words[i])
            if n > LONG_WORD:
                out[i] = np.array(self.encode(words[i]), "<u4").tobytes()
            elif n:
                block.append(i)
                held += n
                if held >= BLOCK_LETTERS:
                    self._encode_block(words, block, out)
                    block, held = [], 0
        if block:
            self._encode_block(words, block, out)
        return out

    def _encode_block(self, words: list[str], block: list[int], out: list[bytes]) -> None:
        codes, sizes = self._codes([words[i] for i in block]), np.array([len(words[i]) for i in block])
        ends = np.cumsum(sizes) - 1
        place = np.arange(len(codes)) - np.repeat(ends - sizes + 1, sizes)
        node = np.zeros(len(codes), int)
        if self.word_end:
            node[ends] = 1
        at, ending = np.arange(len(codes)), []  # ending: the tokens that end at each letter
        for d, (keys, token) in enumerate(self.levels):
            key = node << 21 | codes[at - d]
            node = np.searchsorted(keys, key)
            hit = keys[node] == key
            at, node = at[hit], node[hit]
            found = np.flatnonzero(token[node] >= 0)
            ending.append((at[found], token[node[found]], np.full(len(found), d + 1)))
            more = place[at] > d
            at, node = at[more], node[more]
        at, token, size = map(np.concatenate, zip(*ending)) if ending else np.zeros((3, 0), int)
        state, back = np.full(len(codes), -1), np.ones(len(codes), int)
        whole = place[at] + 1 == size  # the first token of a path follows the start
        state[at[whole]], back[at[whole]] = token[whole], size[whole]
        rest = np.flatnonzero(state[at] < 0)
        rest = rest[np.argsort(place[at[rest]].astype(np.uint16), kind="stable")]
        at, token, size = at[rest], token[rest], size[rest]
        hi = 0
        for n in np.bincount(place[at]).tolist():
            lo, hi = hi, hi + n
            before = state[at[lo:hi] - size[lo:hi]]
            step = lo + np.flatnonzero((before >= 0) & self.arcs(before, token[lo:hi]))
            state[at[step]], back[at[step]] = token[step], size[step]
        if (state[ends] < 0).any():
            raise ValueError(f"no path spells {words[block[int(np.argmax(state[ends] < 0))]]!r}")
        path, at = np.zeros(len(codes), bool), ends
        while len(at):
            path[at] = True
            at = at[place[at] >= back[at]]
            at = at - back[at]
        ids = state[path].astype("<u4").tobytes()
        lo = 0
        for i, hi in zip(block, (np.cumsum(path)[ends] * 4).tolist()):
            out[i], lo = ids[lo:hi], hi

    def encode(self, letters: str) -> list[int]:
        """Token ids of one word given in byte letters (without the word end)."""
        n, end = len(letters), self.word_end
        if not n:
            return []
        state: list[int | None] = [None] * n
        back = [0] * n
        for i in range(n - 1):
            for s in range(max(0, i + 1 - self.longest), i + 1):
                t = self.vocab.get(letters[s:i + 1])
                if t is not None and (s == 0 or (state[s - 1] is not None and self.arc(state[s - 1], t))) and self._reachable(t):
                    state[i], back[i] = t, s
                    break
        for s in range(max(0, n - self.longest), n):
            t = self.vocab.get(letters[s:] + end)
            if t is not None and (s == 0 or (state[s - 1] is not None and self.arc(state[s - 1], t))) and self._reachable(t):
                out = [t]
                while s:
                    out.append(state[s - 1])
                    s = back[s - 1]
                return out[::-1]
        raise ValueError(f"no path spells {letters!r}")

    def _reachable(self, t: int) -> bool:
        """Whether the automaton has arcs labelled t at all: a token whose parts never stand next to each other has none."""
        known = self._arcs.get((t, START))
        if known is None:
            if t not in self.parts:
                known = True
            else:
                u, v = self.parts[t]
                known = self._reachable(u) and self._reachable(v) and self._follow(u, v, self.made[t])
            self._arcs[t, START] = known
        return known


class WordTokenizer:
    """A word-level tokenizer file: normalise, split into words, encode each by the automaton, decode by arc labels."""

    def __init__(self, spec: dict):
        library = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self.library_normal, self.library_split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.auto = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = latin_words(split["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.letters = dict(enumerate(byte_letters())) | {10: "\n"}  # no word holds a line feed; it parts words here
        size = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for t, i in (model["vocab"] | self.added).items():
            self.labels[i] = t.encode()
        self.known: dict[str, bytes] = {}

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if beyond_latin(text):  # which letters exist there depends on the library's Unicode version: it normalises and splits
                return ["\n" + letters for letters, _ in self.library_split(self.library_normal(text))]
            text = unicodedata.normalize("NFC", text)
        return self.words(text.lower())

    def _split(self, text: str) -> list[str]:
        """The words of a text; those given in byte letters begin with one line feed, added tokens with two."""
        if self.cut_added is None or "<" not in text:
            return self._plain(text)
        return [w for p in self.cut_added(text) if p for w in (["\n\n" + p] if p in self.added else self._plain(p))]

    def _learn(self, words: set[str]) -> None:
        """Remembers the token ids of new words."""
        spelled = [w for w in words if w[0] == "\n"]
        added = [w for w in spelled if w[1] == "\n"]
        spelled = [w for w in spelled if w[1] != "\n"]
        plain = [w for w in words if w[0] != "\n"]
        self.known.update((w, np.array([self.added[w[2:]]], dtype="<u4").tobytes()) for w in added)
        letters = "\n".join(plain).encode().decode("latin-1").translate(self.letters).split("\n") if plain else []
        self.known.update(zip(plain + spelled, self.auto.encode_all(letters + [w[1:] for w in spelled]), strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers. Added tokens are cut out of the raw text first."""
        split = [self._split(t) for t in texts]
        words = set().union(*split)
        new = words.difference(self.known)
        if len(self.known) + len(new) > WORD_CACHE:
            self.known.clear()
            new = words
        self._learn(new)
        return [b"".join(map(self.known.__getitem__, w)) for w in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The labels in order, one space between them (the file names no decoder), as UTF-8."""
        return b" ".join(map(self.labels.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def load(path: str) -> WordTokenizer:
    with open(path, encoding="utf-8") as f:
        return WordTokenizer(json.load(f))


def _encoded(path: str, tokens: bool):
    """Rows of ids and checksums, passed on in parts of BATCH_BYTES; the labels of a text are held one text at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)

        def out(doc_id: pa.Array, ids: list[bytes], sums: list[str], decoded: list[str]) -> pa.RecordBatch:
            sizes = [len(x) // 4 for x in ids]
            cols, names = [doc_id, pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"]
            if tokens:
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), flat))
                names.append("ids")
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array(sums, pa.string()), pa.array(decoded, pa.string())], [*names, "ids_sha256", "decoded_sha256"])

        for b in batches:
            lo, held = 0, 0
            ids, sums, decoded = [], [], []
            for i, x in enumerate(x for texts in _groups(b.column(1)) for x in tok.encode_all(texts)):
                ids.append(x)
                sums.append(hashlib.sha256(x).hexdigest())
                decoded.append(hashlib.sha256(tok.decode(x)).hexdigest())
                held += len(x)
                if held >= BATCH_BYTES or i == b.num_rows - 1:
                    yield out(b.column(0).slice(lo, i + 1 - lo), ids, sums, decoded)
                    lo, held = i + 1, 0
                    ids, sums, decoded = [], [], []
    return run


def _groups(column: pa.Array) -> Iterator[list[str]]:
    """The texts in order, in groups of GROUP_CHARS characters."""
    texts, held = [], 0
    for t in column:
        texts.append(t.as_py() or "")
        held += len(texts[-1])
        if held >= GROUP_CHARS:
            yield texts
            texts, held = [], 0
    if texts:
        yield texts


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokens: bool = True) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``ids`` (array<int>; left out with ``tokens=False``),
    ``ids_sha256``, ``decoded_sha256`` (of the labels of exactly these ids).

    ``path`` is a tokenizer file that every executor can read. It is a map over the rows: no exchange, one Arrow batch of
    texts in memory, and the ids of a part of it. Null and empty texts have no token; equal rows get equal results; other columns are not read.
    """
    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * tokens + "ids_sha256 string, decoded_sha256 string"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encoded(path, tokens), schema)
