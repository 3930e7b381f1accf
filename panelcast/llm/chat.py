"""Multi-party chat formatting with DataFrame functions only: each dialogue from the view of each of its speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut

BEGIN, END = "<|im_start|>", "<|im_end|>"
POSITION_BITS = 33  # of monotonically_increasing_id


def _safe(text: Column) -> Column:
    """Text that cannot open or close a turn of its own."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``rank``: the place of a turn in its dialogue, from 0, without ever holding a dialogue in one task.

    Rows are sorted by range - a long dialogue spreads over ranges, and a hash of the source place spreads equal rows - and
    written. A row's rank is its place in its range, plus the rows of the dialogue in the ranges before (one number per range).
    """
    salt = F.xxhash64(F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("body"), F.col("salt")]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(turns.withColumn("salt", salt).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt")
               .withColumn("at", F.monotonically_increasing_id()))
    laid = laid.withColumn("range", F.shiftright("at", POSITION_BITS))
    held = cut(laid.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    before = held.alias("x").join(held.alias("y"), F.expr("x.conv_id <=> y.conv_id and y.range < x.range"), "left").groupBy(
        F.col("x.conv_id").alias("c"), F.col("x.range").alias("r"), F.col("x.first").alias("first")).agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    joined = laid.join(before, F.expr("conv_id <=> c and range = r"))
    return joined.select("conv_id", "speaker", "body", (F.col("before") + F.col("at") - F.col("first")).alias("rank"))


def perspectives(
    df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
    context: str = "system", unnamed: str = "unknown", part_turns: int = 256,
) -> DataFrame:
    """One row per dialogue, speaker and part: ``conv_id``, ``perspective``, ``part``, ``n_turns``, ``text``, ``mask``.

    For every participant the whole dialogue is rendered with that speaker as ``assistant``, the others as ``user`` with their
    name, and turns of the ``context`` role as ``system`` (context is no participant). ``mask`` lists the spans to train on, in
    code points of ``text``, ends exclusive: the bodies of the speaker's turns with their end marks. A dialogue of more than
    ``part_turns`` turns comes in parts, so that no row or task grows with a dialogue; its parts in order are its rendering.

    Turns are ordered by turn number (nulls last), then speaker and text; repeated rows are turns of their own. Rows with a null
    id form one dialogue with a null id. A null or empty speaker is called ``unnamed``; a null text is empty; marks inside texts
    and names are broken up. A dialogue with context alone has no participant and gives no row; other columns are not read.
    """
    speaker = F.when(F.length(F.coalesce(F.col(speaker_col), F.lit(""))) > 0, F.col(speaker_col)).otherwise(F.lit(unnamed))
    turns = df.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), speaker.alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    people = cut(turns.filter(F.col("speaker") != context).groupBy("conv_id", "speaker").agg(F.count("*").alias("own")).select(
        F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")))
    parts = numbered(turns).groupBy("conv_id", F.floor(F.col("rank") / part_turns).cast("long").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "speaker", "body"))).alias("turns"))

    def head(t: Column) -> Column:
        named = F.concat(F.lit("user name="), _safe(t["speaker"]))
        return F.concat(
            F.lit(BEGIN), F.when(t["speaker"] == F.col("perspective"), F.lit("assistant")).when(t["speaker"] == context, F.lit("system")).otherwise(named), F.lit("\n"))

    views = parts.join(people, F.expr("conv_id <=> c")).withColumn("pieces", F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), F.concat(_safe(t["body"]), F.lit(END)).alias("body"), (t["speaker"] == F.col("perspective")).alias("own"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return views.select(
        "conv_id", "perspective", "part", F.size("turns").alias("n_turns"),
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "\n"), F.lit("\n")).alias("text"),
        F.aggregate("pieces", start, step, lambda acc: acc["spans"]).alias("mask"))


def digest(views: DataFrame) -> DataFrame:
    """The same with the mask as text."""
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return views.select("conv_id", "perspective", "part", "n_turns", "text", mask.alias("mask"))
