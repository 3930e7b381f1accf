"""Conversation repair against exhaustive edit scripts and a plain reading of its definition."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from panelcast.llm import repair
from panelcast.llm.queries import ORACLES, QUERIES

LEGAL = re.compile(r"(s?(ua)+)?")


def scripts(initials, faults):
    """Every edit script with at most two insertions between rows, as (cost, audit, role letters or None where not legal)."""
    gaps = [["", "I", "II"]] * (len(initials) + 1)
    for edits in itertools.product("DKR", repeat=len(initials)):
        if any(e != "D" and f in (1, 2) for e, f in zip(edits, faults)):
            continue
        base = sum({"D": 4, "K": 0, "R": 3}[e] + (3 if e != "D" and f == 3 else 0) for e, f in zip(edits, faults))
        for put in itertools.product(*gaps):
            audit = "".join(g + e for g, e in zip(put, edits)) + put[-1]
            kept = iter(initials)
            shown = ""
            for letter in audit:
                own = next(kept) if letter != "I" else ""
                shown += {"D": "", "K": own, "R": "?", "I": "?"}[letter]
            fits = any(LEGAL.fullmatch("".join(next(f) if x == "?" else x for x in shown))
                       for fill in itertools.product("ua", repeat=shown.count("?")) for f in [iter(fill)])
            if fits:
                yield base + 3 * audit.count("I"), audit


def test_cheapest_equals_exhaustive_search():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randrange(0, 5)
        initials = "".join(rng.choice("sua-") for _ in range(n))
        faults = [rng.choice([0, 0, 1, 2, 3]) for _ in range(n)]
        assert repair.cheapest(initials, faults) == min(scripts(initials, faults)), (initials, faults)


def from_the_end(initials, faults):
    """Least (cost, audit) by rows from the last to the first, with whole strings."""
    lattice, n, best = repair.Lattice(initials, faults), len(initials), {}
    for i in range(n, -1, -1):
        here = {q: [(0, "")] if i == n and q in (0, 3) else [] for q in range(4)}
        for q in range(4):
            if i < n:
                here[q] += [(best[r][0] + c, letter + best[r][1]) for letter, c, r in lattice._row(i, q) if r in best]
        least = {q: min(c) for q, c in here.items() if c}
        best = {}
        for q in range(4):
            r, c = q, [least[q]] if q in least else []
            for k in (1, 2, 3):
                r = repair.SPOKEN[r]
                if r in least:
                    c.append((3 * k + least[r][0], "I" * k + least[r][1]))
            if c:
                best[q] = min(c)
    return best[0]


def test_cheapest_of_long_dialogues():
    rng = random.Random(6)
    for n in (1, 7, 40, 300):
        for _ in range(30):
            initials = "".join(rng.choice("suuaa-") for _ in range(n))
            faults = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
            assert repair.cheapest(initials, faults) == from_the_end(initials, faults)
    for shape in ("-", "u", "s", "ua"):
        initials = (shape * 30_001)[:30_001]
        cost, audit = repair.cheapest(initials, [0] * len(initials))
        assert len(audit.replace("I", "")) == len(initials) and cost == sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in audit)


ROWS = "conv_id long, turn long, role string, text string, name string, kind int, audit string"  # with clashing names


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(8)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Hello.", "So?", "and then", "Fine! \n", " ", "é."])))
    rows += [(70, None, "user", "Yes."), (70, None, "user", "Yes."), (70, 3, None, "No."), (70, 4, "assistant", None), (71, 0, "", ""), (72, 1, "user", "x" * 500_000 + "."),
             (72, 2, "assistant", "a. " * 100_000), (None, 5, "user", "Who?"), (None, 6, "assistant", "Me."), (73, 9_000_000_000, "user", "Late."), (73, 1, "user", "Late.")]
    dropped = next(i for i in range(100, 999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    rows += [(80, t, ("user", "assistant")[t % 2], f"Line {t}.") for t in range(150)]
    return [(*r, "n", 7, "KK") for r in rows]


def expected(rows):
    convs: dict = {}
    for c, t, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        row = (t, "user" if k == 4 else role, text)
        convs.setdefault(c, []).extend([row] * (0 if k == 0 else 2 if k == 3 else 1))
    out = []
    for c, here in convs.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in here:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in here]
        cost, audit = from_the_end("".join(i if i in ("s", "u", "a") else "-" for i in initials), faults) if here else (0, "")
        said, left, q = [], iter(here), 0
        for e in audit:
            _, role, text = next(left) if e != "I" else (None, "", "")
            if e != "D":
                q = repair.STEP[q, role[:1]] if e == "K" else repair.SPOKEN[q]
                said.append(f"{role if e == 'K' else ['', '', 'user', 'assistant'][q]}:{text}")
        at = [r[0] for r in here if r[0] is not None]
        out.append((c, max(at) - min(at) + 1 - len(set(at)) if at else 0, faults.count(1), faults.count(2), faults.count(3),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_plain_reading_and_sql(spark, turns, tmp_path):
    spark.createDataFrame(turns, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in QUERIES["op11_repair"](spark, str(tmp_path)).collect()), key=str)
    assert got == expected(turns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(con.execute(ORACLES["op11_repair"]).fetchall(), key=str) == got


def test_repaired_rows_alternate(spark, turns):
    df = spark.createDataFrame(turns, ROWS)
    found = repair.diagnose(df)
    rows = repair.repaired(df, found).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append(r)
    for conv in by.values():
        assert [r["place"] for r in conv] == list(range(len(conv)))
        assert LEGAL.fullmatch("".join(r["role"][0] for r in conv))
    assert all(r["text"] == "" for r in rows if r["edit"] == "I")
    assert {r["conv_id"] for r in found.collect()} == {r[0] for r in turns}


def test_no_rows(spark, turns):
    empty = spark.createDataFrame(turns, ROWS).limit(0)
    assert repair.repair(empty).collect() == []
