"""Panel tables derived from the driver's ``events`` table.

Five users form a series, an hour is a slot, and strong ``error`` rows are the
fire signal.  All counting happens in one aggregation by (series, hour), which
combines before the shuffle, so a user with a third of all events costs no more
than its hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.layout import Layout, PanelWindows
from panelcast.session import use_utc

USERS_PER_SERIES = 5
SEEDS = tuple(range(10))


def events(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """All events, or those of the few series in ``only`` (a sample of bounded size), left out right at the scan."""
    use_utc(spark)
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    if only is None:
        return ev
    few = F.broadcast(only.select(F.col("series_id").alias("_only")).distinct())
    return ev.join(few, F.floor(F.col("user_id") / USERS_PER_SERIES) == F.col("_only"), "left_semi")


def layout(spark: SparkSession, sf_dir: str) -> Layout:
    return Layout.detect(events(spark, sf_dir), time="ts")


def _cells(ev: DataFrame) -> DataFrame:
    """One row per (series, hour) that has events, with observation and weather sums."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = ev.select(
        F.floor(F.col("user_id") / USERS_PER_SERIES).alias("series_id"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("slot_utc"),
        "event_type", "value", k.alias("k"),
    ).withColumn("hit", (F.col("event_type") == "error") & (F.col("k") >= 75))
    hit = F.col("hit")
    return rows.groupBy("series_id", "slot_utc").agg(
        F.when(F.max(hit), "fire").otherwise("no_fire").alias("slot_type"),
        F.coalesce(F.sum(F.when(hit, F.col("value"))), F.lit(0.0)).alias("frp_sum_mw"),
        F.avg(F.when(hit, (F.col("k") >= 90).cast("double"))).alias("sat_fraction"),
        F.count(F.when(hit, 1)).alias("n_pixels"),
        ((F.avg("k") - 50) / 10).alias("u10"),
        ((F.max("k") - F.min("k")) / 20.0).alias("v10"),
        (F.avg("value") / 20).alias("u850"),
        ((F.max("value") - F.min("value")) / 20).alias("v850"),
        ((7 * F.sum("k")) % 360).cast("double").alias("wind_dir_10m"),
        (F.count(F.lit(1)) + 280).cast("double").alias("d2m_K"),
        (F.sum("k") + 500).cast("double").alias("blh_m"),
        (F.avg("value") / 50).alias("vpd_kPa"),
        F.count(F.when(F.col("event_type") == "signup", 1)).cast("double").alias("precip_1h_mm"),
    )


OBS = ["series_id", "slot_utc", "slot_type", "frp_sum_mw", "sat_fraction", "n_pixels"]


def hourly(spark: SparkSession, sf_dir: str, lay: Layout | None = None, only: DataFrame | None = None) -> DataFrame:
    """Observations on the full hourly grid from a series' first to its last event.

    The gap after a slot is filled from that slot itself (next slot by ``lead``),
    so no grid table has to be built and joined.
    """
    ev = events(spark, sf_dir, only)
    cells = _cells(ev).select(*OBS)
    pw = PanelWindows(cells, lay or Layout.detect(ev, "ts"), 0, 1)
    until = F.coalesce(F.lead("slot_utc").over(pw.w) - F.expr("INTERVAL 1 HOUR"), F.col("slot_utc"))
    rows = pw.close(pw.df.withColumn("_until", until))
    rows = rows.withColumn("_slot", F.explode(F.expr("sequence(slot_utc, _until, INTERVAL 1 HOUR)")))
    seen = F.col("_slot") == F.col("slot_utc")
    return rows.select(
        "series_id", F.col("_slot").alias("slot_utc"),
        F.when(seen, F.col("slot_type")).otherwise("missing").alias("slot_type"),
        F.when(seen, F.col("frp_sum_mw")).alias("frp_sum_mw"),
        F.when(seen, F.col("sat_fraction")).alias("sat_fraction"),
        F.when(seen, F.col("n_pixels")).otherwise(F.lit(0)).cast("long").alias("n_pixels"),
    )


def _weather(cells: DataFrame, lay: Layout) -> DataFrame:
    cells = cells.withColumns({
        "wind_speed_10m": F.sqrt(F.col("u10") * F.col("u10") + F.col("v10") * F.col("v10")),
        "wind_speed_850": F.sqrt(F.col("u850") * F.col("u850") + F.col("v850") * F.col("v850")),
        "t2m_K": F.lit(290.0) + F.hour("slot_utc") / 2,
    })
    pw = PanelWindows(cells, lay, 23, 0)
    return pw.close(pw.df.withColumns({
        "precip_24h_mm": F.sum("precip_1h_mm").over(pw.w.rowsBetween(-23, 0)),
        "delta_wind_3h": F.coalesce(F.col("wind_speed_10m") - F.lag("wind_speed_10m", 3).over(pw.w), F.lit(0.0)),
    })).drop("row_no")


def covariates(spark: SparkSession, sf_dir: str, lay: Layout | None = None, only: DataFrame | None = None) -> DataFrame:
    from panelcast.schema import COVARIATES

    ev = events(spark, sf_dir, only)
    rows = _weather(_cells(ev), lay or Layout.detect(ev, "ts"))
    return rows.select("series_id", "slot_utc", *COVARIATES)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per series with its split and labels."""
    s = F.floor(F.col("user_id") / USERS_PER_SERIES).alias("series_id")
    ids = events(spark, sf_dir).select(s).distinct()
    return ids.select("series_id", *_labels())


def _labels():
    s = F.col("series_id")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (s % n + 1).cast("int"))
    return [
        F.concat(F.lit("unit_"), F.lpad(s.cast("string"), 6, "0"), F.lit("_"), (2017 + s % 8).cast("string")).alias("series_name"),
        _split(s).alias("split"),
        pick(("high", "medium", "low"), 3).alias("intensity_tier"),
        pick("ABCD", 4).alias("wind_regime"),
        pick("XY", 2).alias("country"),
    ]


def _split(s):
    return F.when(s % 10 == 1, "val").when(s % 10 == 2, "test").otherwise("train")


def panel(spark: SparkSession, sf_dir: str, lay: Layout | None = None) -> DataFrame:
    """Observations joined with covariates, gaps dropped, split attached.

    Both inputs come from the same cells here, so one aggregation gives the
    joined rows; ``assemble.assemble`` does the same from separate tables.
    """
    ev = events(spark, sf_dir)
    rows = _weather(_cells(ev), lay or Layout.detect(ev, "ts"))
    return rows.withColumn("sat_fraction", F.coalesce("sat_fraction", F.lit(0.0))).withColumn(
        "split", _split(F.col("series_id")))


def pseudo_seed(prior, seed, lead, series):
    """Stand-in seed forecasts: a fixed mix of the prior."""
    mix = F.lit(0.6) + F.lit(0.1) * ((7 * seed + 3 * lead + series) % 9)
    return prior * mix + ((seed + lead) % 4)

