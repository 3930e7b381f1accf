"""Split-conformal intervals in log space.

The leave-one-series-out form asks, for every series, for an order statistic of
all *other* series' scores.  Instead of pairing every series with every score,
scores are ranked once.  For one series let C(v) and c(v) count all and own
scores up to v; its own scores that precede the k-th other score are those with
C(v) - c(v) < k.  With j of them, the k-th other score is number k + j overall,
and positions are looked up in blocks that hold an even share of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.columns import floor0
from panelcast.operators.layout import RANGE_ROWS, cumulative_cells, exact_quantiles, splitters
from panelcast.plans.evaluation import with_mean_rows
from panelcast.schema import CONFORMAL_LEVELS
from panelcast.session import cut

INF = float("inf")


def with_scores(rows: DataFrame, pred: str = "pred") -> DataFrame:
    """Nonconformity of fire-active rows: absolute log residual."""
    return rows.filter("fire_active").withColumn("score", F.abs(F.log1p("y") - F.log1p(pred)))


def _levels(levels):
    return F.explode(F.array(*[F.lit(float(x)) for x in levels]))


def _k(n, level):
    return F.ceil((n + 1) * level)


def split_quantiles(scores: DataFrame, by: list[str], levels=CONFORMAL_LEVELS, splits=None) -> DataFrame:
    """k-th smallest score per group and level, k = ceil((n + 1) level); infinite when k > n."""
    if splits is None:
        splits = splitters(scores, "score")
    cells = cumulative_cells(scores, by, "score", splits).withColumn("level", _levels(levels))
    k = _k(F.col("total"), F.col("level"))
    hit = (F.col("below") < k) & (k <= F.col("below") + F.col("n"))
    return cells.groupBy(*by, "level").agg(
        F.coalesce(F.max(F.when(hit, F.col("score"))), F.lit(INF)).alias("q"),
        F.max("total").alias("n_cal"))


def placed_lookups(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """Lookups and the cells they need, in groups of bounded size.

    ``cells`` (distinct scores with ``below``, ``n`` and ``total``) cover the positions 1..total; ``asked`` rows have a ``pos``.
    Positions are cut into even blocks, and a cell goes to every block it reaches into, so a block has no more cells than
    positions. Lookups may crowd on few positions: they are counted per block, and a block with more of them than its
    share is dealt out several times. No group has more than a block's share of lookups (by hash, a fifth of leeway) or cells.
    """
    total = cells.agg(F.max("total")).first()[0] or 1
    blocks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    share = -(-total // blocks)
    block = lambda p: F.floor((p - 1) / share)
    asked = asked.withColumns({"_block": block(F.col("pos")), "_kind": F.lit(0), "q": F.lit(None).cast("double")})
    loads = asked.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / (0.8 * share)).alias("_copies"))
    loads = F.broadcast(loads)  # a row for each block: as many as there are partitions
    lookups = asked.join(loads, "_block").withColumn("_copy", F.pmod(F.xxhash64("series_id", "level"), F.col("_copies")))
    end = F.col("below") + F.col("n")
    reached = cells.withColumn("_block", F.explode(F.sequence(block(F.col("below") + 1), block(end))))
    reached = reached.join(loads, "_block").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    known = reached.select("_block", "_copy", end.alias("pos"), F.lit(1).alias("_kind"), F.col("score").alias("q"))
    return lookups.drop("_copies").unionByName(known, allowMissingColumns=True)


def scores_at(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with ``q``, the score at each ``pos``: that of the first cell which ends there or later."""
    down = Window.partitionBy("_block", "_copy").orderBy(F.desc("pos"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed_lookups(cells, asked).withColumn("q", F.last("q", ignorenulls=True).over(down))
    return rows.filter("_kind = 0").drop("_block", "_copy", "_kind")


def asked_positions(scores: DataFrame, everyone: DataFrame, levels=CONFORMAL_LEVELS, splits=None) -> DataFrame:
    """Per series and level: how many other scores there are, and the position of the wanted one among all (null beyond them)."""
    own = cumulative_cells(scores, ["series_id"], "score", splits or [])
    both = own.join(
        everyone.select("score", (F.col("below") + F.col("n")).alias("_C"), F.col("total").alias("_N")), "score")
    both = both.withColumn("level", _levels(levels))
    n_cal = F.col("_N") - F.col("total")
    k = _k(n_cal, F.col("level"))
    preceding = F.when(F.col("_C") - F.col("below") - F.col("n") < k, F.col("n")).otherwise(0)
    asked = both.groupBy("series_id", "level").agg(
        F.max(n_cal).alias("n_cal"), F.max(k).alias("_k"), F.sum(preceding).alias("_j"))
    return asked.select("series_id", "level", "n_cal", F.when(F.col("_k") <= F.col("n_cal"), F.col("_k") + F.col("_j")).alias("pos"))


def leave_one_out_quantiles(scores: DataFrame, levels=CONFORMAL_LEVELS, splits=None) -> DataFrame:
    """Per series and level: the conformal quantile of all other series' scores."""
    splits = splitters(scores, "score") if splits is None else splits
    everyone = cut(cumulative_cells(scores, [], "score", splits))
    asked = cut(asked_positions(scores, everyone, levels, splits))
    found = scores_at(everyone, asked.filter("pos is not null")).select("series_id", "level", "n_cal", "q")
    beyond = asked.filter("pos is null").select("series_id", "level", "n_cal", F.lit(INF).alias("q"))
    return found.unionByName(beyond)


def intervals(rows: DataFrame, quantiles: DataFrame, pred: str = "pred") -> DataFrame:
    """Interval per row and level; the quantile table has one row per (series, level)."""
    per = quantiles.groupBy("series_id").agg(F.collect_list(F.struct("level", "q")).alias("_q"))
    rows = rows.join(per, "series_id").withColumn("_x", F.explode("_q"))
    log = F.log1p(pred)
    return rows.withColumns({
        "level": F.col("_x.level"), "q": F.col("_x.q"),
        "lo": floor0(F.expm1(log - F.col("_x.q"))), "hi": F.expm1(log + F.col("_x.q")),
    }).drop("_x", "_q")


def covered(rows: DataFrame):
    """Is the observation inside, both ends included. Rows with their score and its quantile are judged by these: an end that
    lies exactly on the observation is off by a last bit after the way through the exponential."""
    if {"score", "q"} <= set(rows.columns):
        return (F.col("y") >= 0) & (F.col("score") <= F.col("q"))
    return F.col("y").between(F.col("lo"), F.col("hi"))


def interval_report(rows: DataFrame, by: list[str], splits=None) -> DataFrame:
    """Coverage, mean and median width, also relative to the mean observation."""
    inside = covered(rows).cast("double")
    rows = rows.withColumn("width", F.col("hi") - F.col("lo"))
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_fire"),
        F.avg(inside).alias("coverage"),
        F.avg("width").alias("width_mean"), F.avg("y").alias("mean_obs"))
    med = exact_quantiles(rows, by, "width", {"width_median": 0.5}, splits=splits)
    obs = F.when(F.col("mean_obs") > 0, F.col("mean_obs"))
    return agg.join(med, by).withColumns({
        "width_mean_frac": F.col("width_mean") / obs, "width_median_frac": F.col("width_median") / obs})


def calibration(rows: DataFrame, levels=CONFORMAL_LEVELS, pred: str = "pred") -> DataFrame:
    """The whole leave-one-series-out report with one MEAN row per level."""
    scores = cut(with_scores(rows, pred).select("series_id", "slot_utc", "y", pred, "score"))
    ivs = cut(intervals(scores, leave_one_out_quantiles(scores, levels), pred))
    per = interval_report(ivs, ["series_id", "level"]).withColumn("event", F.col("series_id").cast("string"))
    return with_mean_rows(per, ["level"], ["coverage", "width_mean", "width_median", "width_mean_frac",
                                           "width_median_frac"])
