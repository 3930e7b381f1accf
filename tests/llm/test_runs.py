"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import runs
from panelcast.llm.queries import QUERIES

short = st.lists(st.integers(0, 2), max_size=24)


def lyndon(s):
    """Longest word from each place that is smaller than all its proper suffixes."""
    return [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]


def every_run(s, least, times=2):
    """Each period by itself: maximal stretches of equal words one period apart; smaller periods win."""
    out = set()
    for q in range(1, len(s)):
        i = 0
        while i < len(s) - q:
            j = i
            while j < len(s) - q and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                part = s[i:j + q]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.add((i, j - i + q, q))
            i = max(j, i + 1)
    return out


@given(short)
@settings(max_examples=300, deadline=None)
def test_lyndon_arrays_of_both_orders(s):
    assert runs.lyndon_array(s) == lyndon(s)
    assert runs.lyndon_array(s, descending=True) == lyndon([-x for x in s])


@given(short, st.integers(2, 12), st.integers(2, 3))
@settings(max_examples=300, deadline=None)
def test_runs_of_short_words(s, least, times):
    assert set(runs.find_runs([b"%d" % x for x in s], least, times)) == every_run(s, least, times)


def test_runs_among_other_words_and_in_long_texts():
    rng = random.Random(5)
    for _ in range(60):
        s = [rng.randrange(rng.choice([2, 9, 400])) for _ in range(rng.randrange(10, 60))]
        for _ in range(3):
            p = [rng.randrange(50) for _ in range(rng.randrange(1, 9))]
            s += p * rng.randrange(1, 8) + [rng.randrange(400) for _ in range(rng.randrange(12))]
        assert set(runs.find_runs([b"%d" % x for x in s])) == every_run(s, 12)
    for n, p in ((300_000, 1), (300_000, 7), (60_000, 20_000)):
        s = [b"%d" % rng.randrange(1 << 40) for _ in range(p)] * (n // p)
        assert runs.find_runs(s) == [(0, len(s), p)]
        assert runs.collapse(s, runs.find_runs(s)) == s[:p]


ROWS = "doc_id long, text string, runs string, seed string"  # columns with clashing names


def expected(rows):
    out = []
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(w)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = sorted(every_run(w, 12), key=lambda r: (r[0], r[2]))
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        out.append((doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
                    hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(),
                    hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(5, 60))), "x", "y") for i in range(60)]
    hot = next(i for i in range(1000, 9999) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows += [(hot, "a b c d e f g h i j k l m n o p q r s t", "x", None), (hot, "", None, None), (hot, None, None, None), (61, "la " * 40, "x", "y"),
             (61, "la " * 40, "x", "y"), (62, "\n\t ", "x", "y"), (63, "é" * 9, "x", "y"), (None, "ho hum\u00a0 " * 9, "x", "y"),
             (64, "a\u2028b \x0b" * 20, "x", "y"), (-5, "one two three\n" * 5, "x", "y"), (65, "x" * 300_000 + " y" * 13, "x", "y")]
    return rows


def test_query_equals_brute_force(spark, corpus, tmp_path):
    spark.createDataFrame(corpus, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == expected(corpus)
    assert sum(r[1] > 0 for r in got) > 8


def test_texts_nulls_and_no_rows(spark, corpus):
    df = spark.createDataFrame(corpus, ROWS)
    got = {r["doc_id"]: r for r in runs.periodic_runs(df).collect()}
    assert got[61]["collapsed"] == "la" and got[61]["n_words"] == 40 and got[62]["collapsed"] == "" and got[62]["runs"] == []
    assert [tuple(r) for r in got[-5]["runs"]] == [(0, 15, 3)]
    empty = runs.digest(runs.periodic_runs(df.limit(0)))
    assert empty.collect() == [] and empty.columns[0] == "doc_id"
