"""Conversation structure repair: the cheapest edits that make a dialogue alternate, by bidirectional search of the edit lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut

# Places in a dialogue ``(s?(ua)+)?`` and where a turn leads: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SPOKEN = (2, 2, 3, 2)  # where the one user or assistant turn that may come next leads
FINAL = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NAMES = {2: "user", 3: "assistant"}
NEVER = 1 << 60
BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT = 1, 2, 3
CACHE_BYTES = 4_000_000  # of dialogue shapes whose audit a task remembers
WHITE = " \t\n\x0b\x0c\r"


class Lattice:
    """Nodes (rows read, place in the pattern); arcs are edits. A row is its role's initial (``s``, ``u``, ``a`` or another
    character) and its fault. From a node each edit leads to one other node, so an audit is one path."""

    def __init__(self, initials: str, faults: list[int]):
        self.initials, self.faults, self.n = initials, faults, len(initials)

    def _row(self, i: int, q: int) -> Iterator[tuple[str, int, int]]:
        """Edits of row i at place q: letter, cost, place after it."""
        fault = self.faults[i]
        yield "D", DELETE, q
        if fault not in (BLANK_FAULT, DUPLICATE_FAULT):
            extra = TRUNCATED if fault == TRUNCATED_FAULT else 0
            kept = STEP.get((q, self.initials[i]))
            if kept is not None:
                yield "K", KEEP + extra, kept
            yield "R", REROLE + extra, SPOKEN[q]

    def onward(self, node: int) -> Iterator[tuple[str, int, int]]:
        i, q = node >> 2, node & 3
        yield "I", INSERT, node - q + SPOKEN[q]
        if i < self.n:
            for letter, cost, r in self._row(i, q):
                yield letter, cost, (i + 1) * 4 + r

    def back(self, node: int) -> Iterator[tuple[str, int, int]]:
        i, r = node >> 2, node & 3
        for q in range(4):
            if SPOKEN[q] == r:
                yield "I", INSERT, node - r + q
            if i:
                for letter, cost, after in self._row(i - 1, q):
                    if after == r:
                        yield letter, cost, (i - 1) * 4 + q


class Ahead:
    """Least audits from the start. Two cheapest audits to one node are never one the beginning of the other, so they
    compare where their paths part; jump pointers find that place in logarithmic time."""

    def __init__(self, size: int):
        self.cost, self.done = [NEVER] * size, bytearray(size)
        self.parent, self.jump, self.depth = [-1] * size, [-1] * size, [0] * size
        self.letter = [""] * size

    def settle(self, v: int) -> None:
        self.done[v] = 1
        p = self.parent[v]
        if p < 0:
            self.jump[v] = v
            return
        self.depth[v] = self.depth[p] + 1
        j = self.jump[p]
        self.jump[v] = self.jump[j] if self.depth[p] - self.depth[j] == self.depth[j] - self.depth[self.jump[j]] else p

    def _up(self, v: int, depth: int) -> int:
        while self.depth[v] > depth:
            v = self.jump[v] if self.depth[self.jump[v]] >= depth else self.parent[v]
        return v

    def less(self, a: int, x: str, b: int, y: str) -> bool:
        """Whether the audit to a, then x, sorts before the audit to b, then y."""
        if a == b:
            return x < y
        level = min(self.depth[a], self.depth[b])
        u, v = self._up(a, level), self._up(b, level)
        if u == v:  # one path goes through the end of the other
            return x < self.letter[self._up(b, level + 1)] if self.depth[a] == level else self.letter[self._up(a, level + 1)] < y
        while self.parent[u] != self.parent[v]:
            u, v = (self.jump[u], self.jump[v]) if self.jump[u] != self.jump[v] else (self.parent[u], self.parent[v])
        return self.letter[u] < self.letter[v]

    def audit(self, v: int) -> str:
        out = []
        while self.parent[v] >= 0:
            out.append(self.letter[v])
            v = self.parent[v]
        return "".join(reversed(out))


def cheapest(initials: str, faults: list[int]) -> tuple[int, str]:
    """Cost and least audit of the cheapest edits that leave ``(s?(ua)+)?``.

    Dijkstra from both ends: the side with the lower next cost settles a node (of equal cost, the one with fewer rows behind it,
    as edits without cost lead on by a row). It ends when the two next costs add up to more than the best crossing; then every
    cheapest path has an arc from a node settled ahead to one settled behind. Of these crossings the least whole audit wins.
    Behind, equal costs are told apart by the next letter alone. Memory is linear in the rows, time by a logarithm more.
    """
    lattice = Lattice(initials, faults)
    n = lattice.n
    if not n:
        return 0, ""
    size = 4 * (n + 1)
    ahead = Ahead(size)
    rest, behind, following, next_letter = [NEVER] * size, bytearray(size), [-1] * size, [""] * size
    ahead.cost[0] = 0
    heap: list[tuple[int, int]] = [(0, 0)]
    paeh: list[tuple[int, int]] = []
    for q in FINAL:
        rest[4 * n + q] = 0
        heappush(paeh, (0, -(4 * n + q)))
    best = NEVER

    def forward() -> None:
        nonlocal best
        cost, u = heappop(heap)
        if ahead.done[u] or cost > ahead.cost[u]:
            return
        ahead.settle(u)
        for letter, c, v in lattice.onward(u):
            total = cost + c
            if total < ahead.cost[v]:
                ahead.cost[v], ahead.parent[v], ahead.letter[v] = total, u, letter
                heappush(heap, (total, v))
            elif total == ahead.cost[v] and not ahead.done[v] and ahead.less(u, letter, ahead.parent[v], ahead.letter[v]):
                ahead.parent[v], ahead.letter[v] = u, letter
            best = min(best, total + rest[v])

    def backward() -> None:
        nonlocal best
        cost, minus = heappop(paeh)
        v = -minus
        if behind[v] or cost > rest[v]:
            return
        behind[v] = 1
        for letter, c, u in lattice.back(v):
            total = cost + c
            if total < rest[u]:
                rest[u], following[u], next_letter[u] = total, v, letter
                heappush(paeh, (total, -u))
            elif total == rest[u] and not behind[u] and letter < next_letter[u]:
                following[u], next_letter[u] = v, letter
            best = min(best, total + ahead.cost[u])

    forward()
    backward()
    backward()
    while heap and paeh and heap[0][0] + paeh[0][0] <= best:
        if heap[0][0] < paeh[0][0]:
            forward()
        else:
            backward()

    audits = []
    goals = {4 * n + q for q in FINAL}
    for u in range(size):
        if ahead.done[u]:
            for letter, c, v in lattice.onward(u):
                if behind[v] and (not ahead.done[v] or v in goals) and ahead.cost[u] + c + rest[v] == best:
                    out, w = [ahead.audit(u), letter], v
                    while following[w] >= 0:
                        out.append(next_letter[w])
                        w = following[w]
                    audits.append("".join(out))
    return best, min(audits)


class Audits:
    """``cheapest`` with a bounded memory of dialogue shapes."""

    def __init__(self):
        self.known: dict[tuple[str, bytes], tuple[int, str]] = {}
        self.held = 0

    def of(self, initials: str, faults: bytearray) -> tuple[int, str]:
        shape = initials, bytes(faults)
        got = self.known.get(shape)
        if got is None:
            got = cheapest(initials, list(faults))
            if self.held > CACHE_BYTES:
                self.known.clear()
                self.held = 0
            self.held += 200 + 3 * len(initials)
            self.known[shape] = got
        return got


def damage(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults put in by crc32(``id:turn``) % 20: 0 drops the row (``present`` false: its conversation stays known), 1 empties the
    text, 2 removes its ``.!?``, 3 repeats the row, 4 makes it the user's. Nulls are read as one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col(id_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))) % 20
    text = F.coalesce(F.col(text_col), space)
    rows = df.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), kind.alias("kind"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(role_col), space)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text", (F.col("kind") != 0).alias("present"))


def _rows(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None) -> DataFrame:
    """Rows as all steps read them; ``name`` stands for role and text, and orders rows of one turn."""
    space = F.lit(" ")
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    present = F.coalesce(F.col(present_col), F.lit(False)) if present_col else F.lit(True)
    return df.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), present.alias("present"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("name"))


def _in_order(rows: DataFrame, *before: str) -> DataFrame:
    """Whole conversations in one task each, streamed in order: nothing but a batch of rows is held for it."""
    order = [F.col("conv_id").asc_nulls_first(), *before, F.col("turn").asc_nulls_first(), F.col("name")]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def _diagnose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types = [pa.int64()] * 8 + [pa.string()]
    audits, out = Audits(), []
    nothing = object()
    conv = nothing

    def told() -> tuple:
        cost, audit = audits.of("".join(initials), faults)
        return (conv, len(faults), turns[1] - turns[0] + 1 - turns[2] if turns else 0, faults.count(BLANK_FAULT), faults.count(DUPLICATE_FAULT),
                faults.count(TRUNCATED_FAULT), illegal, cost, audit)

    for b in batches:
        for c, turn, initial, blank, cut_off, present, name in zip(*(b.column(i).to_pylist() for i in range(7))):
            if conv is nothing or c != conv:
                if conv is not nothing:
                    out.append(told())
                conv, initials, faults, seen, illegal, turns = c, [], bytearray(), set(), 0, None
            if not present:
                continue
            if turn is not None:
                turns = [turn, turn, 1] if turns is None else [turns[0], turn, turns[2] + (turn != turns[1])]
            if initials and initials[-1] + initial not in ("su", "ua", "au"):
                illegal += 1
            initials.append(initial if initial in ("s", "u", "a") else "-")
            faults.append(BLANK_FAULT if blank else DUPLICATE_FAULT if name in seen else TRUNCATED_FAULT if cut_off else 0)
            seen.add(name)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out = []
    if conv is not nothing:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(told(), types)], names)


def diagnose(
    df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None,
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``n_rows``, ``gaps``, counts of each row's first fault (``blank``, ``duplicate``,
    ``truncated``), ``illegal`` (neighbours whose role initials are not su, ua or au), ``cost`` and ``audit`` of the cheapest repair
    (the edits' initials in order; of equally cheap ones the least).

    Rows are taken by turn (nulls first); rows of one turn by a hash of role and text. Null roles and texts are one space; rows
    with a null id are one conversation. Rows whose ``present_col`` is false or null only make their conversation known. Repeated
    rows are duplicates. Texts stay out of the exchange: a conversation's rows pass one task as about 40 bytes each, which
    keeps two letters and a 128-bit hash of each. Other columns are not read; no rows give no rows.
    """
    rows = _rows(df, id_col, turn_col, role_col, text_col, present_col)
    body = F.rtrim("text", F.lit(WHITE))
    marks = rows.select(
        "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"),
        (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut_off"), "present", "name")
    return _in_order(marks).mapInArrow(
        _diagnose, "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit's row leads each conversation; edits are taken from it as rows come."""
    names = ["conv_id", "place", "edit", "role", "text"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    out: list[tuple] = []
    audit, at, place, q, conv = "", 0, 0, 0, None

    def inserts() -> None:
        nonlocal at, place, q
        while at < len(audit) and audit[at] == "I":
            q = SPOKEN[q]
            out.append((conv, place, "I", NAMES[q], ""))
            at, place = at + 1, place + 1

    for b in batches:
        for c, lead, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            if lead is not None:
                audit, at, place, q, conv = lead, 0, 0, 0, c
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    q = STEP[q, role[:1]] if edit == "K" else SPOKEN[q]
                    out.append((conv, place, edit, role if edit == "K" else NAMES[q], text))
                    place += 1
            inserts()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out = []


def repaired(
    df: DataFrame, diagnoses: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    present_col: str | None = None,
) -> DataFrame:
    """Rows of the repaired conversations: ``conv_id``, ``place`` (from 0), ``edit`` (K, R or I), ``role``, ``text``; those of one conversation
    follow each other in order in one partition. ``diagnoses`` is what ``diagnose`` gave for the same rows; a conversation without
    rows left gives none."""
    rows = _rows(df, id_col, turn_col, role_col, text_col, present_col).filter("present")
    lead = diagnoses.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                            F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("name"), "audit", F.lit(0).alias("kind"))
    both = rows.select("conv_id", "turn", "role", "text", "name", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind")).unionByName(lead)
    return _in_order(both, "kind").select("conv_id", "audit", "role", "text").mapInArrow(
        _apply, "conv_id long, place long, edit string, role string, text string")


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per conversation of rows that come in order."""
    held = None
    for b in batches:
        out = []
        for c, place, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            if place == 0:
                if held:
                    out.append((held[0], held[1].hexdigest()))
                held = c, hashlib.sha256()
            else:
                held[1].update(b"\n")
            held[1].update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out])], ["id", "sha256"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1].hexdigest()])], ["id", "sha256"])


def hashes(rows: DataFrame) -> DataFrame:
    """(``id``, ``sha256``) over ``role:text`` of what ``repaired`` gives, joined by line breaks."""
    return rows.select("conv_id", "place", "role", "text").mapInArrow(_hash, "id long, sha256 string")


def repair(df: DataFrame, **cols: str | None) -> DataFrame:
    """``diagnose`` with ``repaired_sha256``: the hash of the repaired conversation (of nothing, where no row is left)."""
    found = cut(diagnose(df, **cols))
    sums = hashes(repaired(df, found, **cols))
    none: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return found.join(sums, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", none).alias("repaired_sha256"))
