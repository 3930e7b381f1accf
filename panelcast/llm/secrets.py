"""Secret scans with DataFrame functions only: fixed patterns, and windows of high entropy per character class."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. ``hex`` and ``access`` hold their least length, which for runs equals dropping short matches.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class EntropyClass:
    """A character class with its own window and threshold (bits a character, in millionths)."""

    kind: str
    chars: str
    window: int
    least_bits: int

    def alphabet(self) -> str:
        """The ASCII characters of the class."""
        return "".join(chr(i) for i in range(128) if re.fullmatch(f"[{self.chars}]", chr(i)))


#: A random 24-character window has 3.5 bits on average over 16 letters and 4.3 over 64.
CLASSES = (
    EntropyClass("entropy_hex", "0-9A-Fa-f", 24, 3_200_000),
    EntropyClass("entropy_base64", "A-Za-z0-9+/_=-", 24, 4_000_000),
)
#: Candidates that look random and are none: alphabets and digit rows in order, examples, placeholders, data URIs' padding.
ALLOWED = (
    r"(?i)example",
    r"(?i)(?:placeholder|changeme|your[_-]?(?:key|token|secret))",
    r"(?i)abcdefghijklmnop",
    r"0123456789(?i:abcdef)",
)
SEPARATORS = "/="  # between the parts of a path or an assignment, which are candidates of their own to the allow-list
REACH = 40  # characters of its part that an allow-list match takes along on either side
BLOCK = 1024  # windows that one fold sweeps


def bits_table(window: int) -> list[int]:
    """c * log2(c) in millionths for c = 0..window: whole numbers, so running sums are exact."""
    from math import log2

    return [round(c * log2(c) * 1e6) if c else 0 for c in range(window + 1)]


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _placed(found: Column, gaps: Column) -> Column:
    """Each match with its start in code points: what lies before it are the gaps and matches so far."""
    step = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["g"])).alias("start"), x["m"].alias("text")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(found) > 0, step).otherwise(F.array().cast("array<struct<start:int,text:string>>"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pieces(text: Column, allowed: tuple[str, ...]) -> Column:
    """What the allow-list leaves of a candidate, with starts: each match goes with up to REACH characters of its part on either side."""
    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("text")))
    if not allowed:
        return whole
    any_of = "|".join(f"(?:{p})" for p in allowed)
    part = f"[^{SEPARATORS}]{{0,{REACH}}}"
    masks, left = _matches(text, f"{part}(?:{any_of}){part}"), F.split(text, f"{part}(?:{any_of}){part}", -1)
    step = F.aggregate(
        F.arrays_zip(left.alias("p"), masks.alias("m")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), x["p"].alias("text")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.rlike(text, F.lit(any_of)), step).otherwise(whole)


def _symbols(text: Column, alphabet: str) -> Column:
    return F.transform(F.split(text, "", -1), lambda ch: F.instr(F.lit(alphabet), ch) - 1)


def _sweep(symbols: Column, c: EntropyClass) -> Column:
    """Spans that windows of at least the threshold cover, from counts kept up to date symbol by symbol.

    The counts of the window are kept in a few long numbers, ``bits`` bits a symbol. A step takes out the symbol that leaves and
    counts the one that enters; the sum of c * log2(c) changes by these two counts alone. Windows that touch make one span.
    """
    w = c.window
    most = bits_table(w)[w]  # w * log2(w)
    limit = most - c.least_bits * w  # entropy >= least  <=>  sum of c * log2(c) <= limit
    bits = w.bit_length()
    each = 62 // bits
    n_symbols = len(c.alphabet())
    table = F.array(*[F.lit(b) for b in bits_table(w)])
    shifts = F.array(*[F.lit(i % each * bits) for i in range(n_symbols)])
    longs = F.array(*[F.lit(i // each) for i in range(n_symbols)])
    one = F.lit(1).cast("long")

    def of(lookup: Column, i: Column) -> Column:
        return F.element_at(lookup, i + 1)

    def count(counts: Column, symbol: Column) -> Column:
        return F.call_function("shiftright", of(counts, of(longs, symbol)), of(shifts, symbol)).bitwiseAND(F.lit(2 ** bits - 1)).cast("int")

    def unit(i: Column, symbol: Column) -> Column:
        return F.when(i == of(longs, symbol), F.call_function("shiftleft", one, of(shifts, symbol))).otherwise(F.lit(0))

    def step(acc: Column, entering: Column) -> Column:
        j = acc["at"] + 1
        full = j > w
        leaving = F.element_at(symbols, F.greatest(j - w, F.lit(1)))
        dropped = F.when(full, F.transform(acc["counts"], lambda x, i: x - unit(i, leaving))).otherwise(acc["counts"])
        less = F.when(full, _let(count(acc["counts"], leaving), lambda n: of(table, n) - of(table, n - 1))).otherwise(0)

        def enter(counts: Column) -> Column:
            more = _let(count(counts, entering), lambda n: of(table, n + 1) - of(table, n))
            return F.struct(F.transform(counts, lambda x, i: x + unit(i, entering)).alias("counts"), (acc["total"] - less + more).cast("int").alias("total"))

        def close(now: Column) -> Column:
            hit = (j >= w) & (now["total"] <= limit)
            fresh = hit & (acc["end"] < j - w)
            return F.struct(
                j.cast("int").alias("at"), now["counts"].alias("counts"), now["total"].alias("total"),
                F.when(fresh, j - w).otherwise(acc["start"]).alias("start"), F.when(hit, j).otherwise(acc["end"]).alias("end"),
                F.when(fresh & (acc["end"] > 0), F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"]).alias("out"),
            )
        return _let(_let(dropped, enter), close)

    nothing = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.array(*[F.lit(0).cast("long")] * -(-n_symbols // each))
    start = F.struct(F.lit(0).alias("at"), zero.alias("counts"), F.lit(0).alias("total"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), nothing.alias("out"))
    return F.aggregate(symbols, start, step, lambda acc: F.when(
        acc["end"] > 0, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"]))


def _windows(text: Column, c: EntropyClass) -> Column:
    """Spans of a text of one class: stretches of BLOCK windows are swept one after another, spans that touch across them joined.

    A stretch starts its counts anew, so time and the arrays of the fold grow with the text, not with its square.
    """
    w = c.window

    def swept(symbols: Column) -> Column:
        begins = F.sequence(F.lit(0), F.size(symbols) - w, F.lit(BLOCK))
        blocks = F.transform(begins, lambda b: F.struct(b.alias("begin"), F.slice(symbols, b + 1, BLOCK + w - 1).alias("symbols")))
        return F.flatten(F.transform(blocks, lambda x: F.transform(_sweep(x["symbols"], c), lambda s: F.struct(
            (x["begin"] + s["start"]).alias("start"), (x["begin"] + s["end"]).alias("end")))))

    def merged(spans: Column) -> Column:
        n = F.size(spans)
        begins = F.filter(spans, lambda s, i: (i == 0) | (s["start"] > F.element_at(spans, F.greatest(i, F.lit(1)))["end"]))
        ends = F.filter(spans, lambda s, i: (i == n - 1) | (F.element_at(spans, F.least(i + 2, n))["start"] > s["end"]))
        return F.zip_with(begins, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(F.length(text) >= w, _let(_let(_symbols(text, c.alphabet()), swept), merged)).otherwise(empty)


def _count(rank: int) -> Column:
    return F.size(F.filter("found", lambda s: s["rank"] == rank))


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: ``doc_id``, ``text``, ``found`` (the spans: start, rank, kind, end; by start, then kind), and
    ``kept``, a struct of the columns named in ``keep``.

    Positions are code points, ends exclusive. Base kinds are pattern matches, leftmost and not overlapping per kind.
    The entropy kinds take runs of one character class as candidates, slide a window over each, and report what windows
    of high entropy cover. An allow-list match is cut out of its candidate with up to REACH characters on either side that no
    separator parts from it (leftmost matches first, none overlapping); what is left is scanned on (base matches are never cut).
    Time is linear in the length of a candidate.
    Null and empty texts have no spans; repeated rows are scanned each for itself; other columns are not read.
    Everything happens within a row: no exchange.
    """
    kept_cols = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(None).alias("none"))
    base = df.select(kept_cols.alias("kept"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    runs = [(c, f"[{c.chars}]{{{c.window},}}") for c in classes]
    rows = base.select(
        "kept", "doc_id", "text", "t",
        _matches(F.col("t"), ASSIGN).alias("assign"), _matches(F.col("t"), ACCESS).alias("access"), _matches(F.col("t"), HEX).alias("hex"),
        *[_matches(F.col("t"), p).alias(c.kind) for c, p in runs],
    )

    def gaps(name: str, pattern: str) -> Column:
        return F.when(F.size(name) > 0, F.split("t", pattern, -1)).otherwise(F.array().cast("array<string>"))

    pats = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)] + [(c.kind, p) for c, p in runs]
    rows = rows.select("kept", "doc_id", "text", *[_placed(F.col(k), gaps(k, p)).alias(k) for k, p in pats])

    def spans(kind: str, rank: int) -> Column:
        kept = F.col(kind)
        if kind == "assign":
            kept = F.filter(kept, lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 1)) >= ASSIGN_LEAST)
        return F.transform(kept, lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["text"])).alias("end")))

    def entropy(c: EntropyClass, rank: int) -> Column:
        left = F.flatten(F.transform(F.col(c.kind), lambda x: F.transform(_pieces(x["text"], allowed), lambda p: F.struct(
            (x["start"] + p["start"]).alias("start"), p["text"].alias("text")))))
        return F.flatten(F.transform(left, lambda x: F.transform(_windows(x["text"], c), lambda s: F.struct(
            (x["start"] + s["start"]).alias("start"), F.lit(rank).alias("rank"), F.lit(c.kind).alias("kind"), (x["start"] + s["end"]).alias("end")))))

    every = [spans(k, i) for i, k in enumerate(KINDS)] + [entropy(c, len(KINDS) + i) for i, c in enumerate(classes)]
    return rows.select("kept", "doc_id", "text", F.array_sort(F.concat(*every)).alias("found"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the checksum of their spans, and all spans as text."""
    base = F.filter("found", lambda s: s["rank"] < len(KINDS))
    n = [_count(i).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return scanned.select("doc_id", *n, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``kept``, ``doc_id``, ``text`` with each maximal covered stretch replaced by ``mark``, ``n_spans``; texts without spans stay."""
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def fold(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        apart = (s["start"] > acc["at"]) | ((acc["at"] == 0) & (acc["out"] == ""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, fresh).otherwise(acc["out"]).alias("out"))

    told = F.aggregate("found", empty, fold, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return scanned.select("kept", "doc_id", F.when(F.size("found") > 0, told).otherwise(F.col("text")).alias("text"), F.size("found").alias("n_spans"))
