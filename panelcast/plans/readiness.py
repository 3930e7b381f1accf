"""Checks a built dataset has to pass before modelling.

Every check is a table; ``verdict`` folds (check, passed) rows into one answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.features import long_form
from panelcast.operators.layout import Layout, PanelWindows, exact_quantiles
from panelcast.plans.normalise import unpivot, weighted_moments, window_statistics
from panelcast.schema import COVARIATES, FEATURES, HORIZON, LOOKBACK, SCALED, SPLITS, TARGET_PERCENTILES, UNSCALED
from panelcast.session import cut

IMBALANCE = 0.60
EXTREME = 10.0
DRIFT_SKIPPED = UNSCALED + ("hours_since_first_fire",)


# ------------------------------------------------------------- coverage, leakage

def window_audit(rows: DataFrame, catalogue: DataFrame, lookback: int = LOOKBACK, horizon: int = HORIZON) -> DataFrame:
    """Usable rows, windows and the reason for none, for every catalogue series.

    ``rows`` are panel rows with ``is_anchor``.  The possible count ignores the
    lag warm-up on purpose.
    """
    per = rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_anchor").alias("n_windows"))
    out = catalogue.select("series_id", "split").join(per, "series_id", "left")
    out = out.withColumns({
        "n_rows": F.coalesce("n_rows", F.lit(0)),
        "n_windows": F.coalesce("n_windows", F.lit(0)),
        "max_possible": F.col("n_rows") - (lookback + horizon - 1),
    })
    reason = (
        F.when(F.col("n_windows") > 0, "ok")
        .when(F.col("n_rows") == 0, "no data")
        .when(F.col("max_possible") <= 0, "too short")
        .otherwise("all windows incomplete")
    )
    return out.withColumn("status", reason)


def split_leaks(windows: DataFrame) -> DataFrame:
    """Series that occur in more than one split."""
    return windows.groupBy("series_id").agg(
        F.min("split").alias("first_split"), F.max("split").alias("last_split")
    ).filter("first_split <> last_split")


def start_gaps(windows: DataFrame, layout: Layout | None = None, keep: int = 3, hours: float = 1.5) -> DataFrame:
    """Breaks between consecutive window starts: the first ``keep`` per series."""
    base = layout or Layout.detect(windows, "input_start_utc")
    lay = Layout(time="input_start_utc", blocked=base.blocked, block_rows=base.block_rows, chunk_days=base.chunk_days)
    pw = PanelWindows(windows.select("series_id", "input_start_utc"), lay, 1, 0)
    step = F.timestamp_diff("SECOND", F.lag("input_start_utc").over(pw.w), F.col("input_start_utc")) / 3600.0
    gaps = pw.close(pw.df.withColumn("gap_hours", step)).filter(F.col("gap_hours") > hours)
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy("input_start_utc"))
    return gaps.withColumn("gap_no", rank).filter(F.col("gap_no") <= keep).select(
        "series_id", "gap_no", "input_start_utc", "gap_hours")


def start_gap_counts(windows: DataFrame, layout: Layout | None = None, hours: float = 1.5) -> DataFrame:
    base = layout or Layout.detect(windows, "input_start_utc")
    lay = Layout(time="input_start_utc", blocked=base.blocked, block_rows=base.block_rows, chunk_days=base.chunk_days)
    pw = PanelWindows(windows.select("series_id", "input_start_utc"), lay, 1, 0)
    step = F.timestamp_diff("SECOND", F.lag("input_start_utc").over(pw.w), F.col("input_start_utc")) / 3600.0
    rows = pw.close(pw.df.withColumn("_step", step))
    return rows.groupBy("series_id").agg(F.count_if(F.col("_step") > hours).alias("n_gaps"))


# ------------------------------------------------------------- cells and targets

def cell_integrity(weighted: DataFrame, features=FEATURES) -> DataFrame:
    """Per split and feature over all window cells: NaN, infinite, constant, extreme values."""
    w = F.col("window_weight")
    rows = weighted.filter(w > 0)
    aggs = []
    for f in features:
        c = F.col(f)
        aggs += [
            F.sum(F.when(c.isNull() | F.isnan(c), w).otherwise(0)).alias(f"{f}__n_nan"),
            F.sum(F.when(F.abs(c) == float("inf"), w).otherwise(0)).alias(f"{f}__n_inf"),
            (F.min(f) == F.max(f)).alias(f"{f}__is_constant"),
            F.sum(F.when(F.abs(c) > EXTREME, w).otherwise(0)).alias(f"{f}__n_extreme"),
            F.max(F.abs(c)).alias(f"{f}__max_abs"),
        ]
    return unpivot(rows.groupBy("split").agg(*aggs), ["split"], features,
                   ["n_nan", "n_inf", "is_constant", "n_extreme", "max_abs"])


def zero_targets(windows: DataFrame) -> DataFrame:
    """Share of windows whose targets are all zero, flagged above the imbalance limit."""
    zero = F.col("target_mean_frp") == 0
    z = windows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(zero).alias("all_zero"),
        F.avg(zero.cast("double")).alias("zero_fraction"))
    return z.withColumn("flagged", F.col("zero_fraction") > IMBALANCE)


def positive_target_percentiles(windows: DataFrame, percentiles=TARGET_PERCENTILES) -> DataFrame:
    y = cut(long_form(windows, "split").filter("y > 0").select("y"))
    return exact_quantiles(y, [], "y", {f"p{p}": p / 100 for p in percentiles})


def target_sanity(windows: DataFrame) -> DataFrame:
    """Per split: window count, null and negative targets, zero fraction and flag."""
    bad = lambda f: F.size(F.filter("targets", f))
    zero = F.col("target_mean_frp") == 0
    t = windows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(bad(lambda x: x.isNull() | F.isnan(x))).alias("n_null"),
        F.sum(bad(lambda x: x < 0)).alias("n_negative"),
        F.count_if(zero).alias("all_zero"), F.avg(zero.cast("double")).alias("zero_fraction"))
    return t.withColumns({
        "flagged": F.col("zero_fraction") > IMBALANCE,
        "passed": (F.col("n_null") == 0) & (F.col("n_negative") == 0)})


def drift(weighted: DataFrame, features=SCALED, split: str = "train") -> DataFrame:
    """Window-weighted mean and deviation of normalised features against their limits."""
    kept = [f for f in features if f not in DRIFT_SKIPPED]
    s = window_statistics(weighted.filter(F.col("split") == split), [], kept)
    ok = (F.abs("mean") <= 0.15) & F.col("std").between(0.85, 1.15)
    return s.select("feature", "mean", "std", ok.alias("match"))


def drift_of_raw(weighted: DataFrame, features=SCALED, split: str = "train") -> DataFrame:
    """``drift`` from rows that are not scaled yet, in one aggregation: the plain moments are the scaling, and scaling moves
    the weighted ones in a known way."""
    kept = [f for f in features if f not in DRIFT_SKIPPED]
    w = F.col("window_weight")
    aggs = []
    for f in kept:
        mean, std = weighted_moments(weighted, [], F.col(f), w)
        aggs += [F.avg(f).alias(f"{f}__m"), F.stddev_pop(f).alias(f"{f}__s"), mean.alias(f"{f}__wm"), std.alias(f"{f}__ws")]
    t = unpivot(weighted.filter(F.col("split") == split).agg(*aggs), [], kept, ["m", "s", "wm", "ws"]).filter("s > 0")
    t = t.select("feature", ((F.col("wm") - F.col("m")) / F.col("s")).alias("mean"), (F.col("ws") / F.col("s")).alias("std"))
    return t.withColumn("match", (F.abs("mean") <= 0.15) & F.col("std").between(0.85, 1.15))


# ------------------------------------------------------------- alignment

def _close(a, b, atol: float = 0.01, rtol: float = 1e-4):
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def alignment(sample: DataFrame, raw: DataFrame, lookback: int = LOOKBACK, horizon: int = HORIZON,
              params: dict | None = None, compared=COVARIATES + ("sat_fraction",)) -> DataFrame:
    """Rebuild targets and last-step inputs of sampled windows from raw rows and compare.

    ``sample`` has ``targets`` and stored inputs; ``raw`` is the joined panel with ``row_no``.
    """
    starts = sample.select("series_id", "slot_utc", "split", "input_start_utc", "targets",
                           *[F.col(c).alias(f"_in_{c}") for c in compared])
    begin = raw.select("series_id", F.col("slot_utc").alias("input_start_utc"), F.col("row_no").alias("_start"))
    placed = starts.join(begin, ["series_id", "input_start_utc"], "left")
    # Step 0 is the last input row, steps 1..horizon are the targets; one equi-join fetches them.
    placed = placed.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(horizon)))).withColumn(
        "row_no", F.col("_start") + F.lit(lookback - 1) + F.col("_k"))
    rows = raw.select("series_id", "row_no", F.col("frp_sum_mw").alias("_v"), *[F.col(c).alias(f"_raw_{c}") for c in compared])
    both = placed.join(rows, ["series_id", "row_no"], "left")
    good_inputs = F.lit(True)
    for c in compared:
        expected = F.col(f"_raw_{c}")
        if params and c in params:
            expected = (expected - F.lit(params[c][0])) / F.lit(params[c][1])
        good_inputs = good_inputs & F.coalesce(_close(F.col(f"_in_{c}"), expected), expected.isNull())
    y = F.element_at("targets", F.when(F.col("_k") > 0, F.col("_k")).otherwise(1).cast("int"))
    return both.groupBy("split", "series_id", "slot_utc").agg(
        (F.count_if((F.col("_k") > 0) & _close(y, F.col("_v"))) == horizon).alias("target_ok"),
        (F.count_if((F.col("_k") == 0) & F.col("_v").isNotNull() & good_inputs) == 1).alias("input_ok"))


# ------------------------------------------------------------- balance, build, sanity

def split_balance(windows: DataFrame, catalogue: DataFrame, attribute: str) -> DataFrame:
    """(split, value, n_series): series with windows per split, for every value the catalogue holds (unknown included);
    series outside the catalogue drop out."""
    known = catalogue.select("series_id", F.col(attribute).alias("value"))
    seen = windows.select("split", "series_id").distinct().join(known, "series_id").groupBy(
        F.col("split").alias("_s"), F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    grid = known.select("value").distinct().withColumn("split", F.explode(F.array(*[F.lit(x) for x in SPLITS])))
    return grid.join(seen, (F.col("split") == F.col("_s")) & F.col("value").eqNullSafe(F.col("_v")), "left").select(
        "split", "value", F.coalesce("_n", F.lit(0)).alias("n_series"))


def fire_content(windows: DataFrame) -> DataFrame:
    fire = F.col("target_mean_frp") > 0
    return windows.groupBy("split").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(fire).alias("fire_active"),
        F.count_if(~fire).alias("no_fire"), F.avg(fire.cast("double")).alias("fire_fraction"))


def missing_tiers(windows: DataFrame, catalogue: DataFrame, tiers=("high", "medium", "low"), split: str = "train") -> DataFrame:
    """One row: how many tiers no series of the training split has."""
    series = windows.filter(F.col("split") == split).select("series_id").distinct()
    seen = series.join(catalogue.select("series_id", "intensity_tier"), "series_id").agg(
        *[F.count_if(F.col("intensity_tier") == t).alias(t) for t in tiers])
    return seen.select(sum((F.when(F.col(t) > 0, 0).otherwise(1) for t in tiers), F.lit(0)).cast("long").alias("missing_tiers"))


def _items(check: str, df: DataFrame, limits: dict[str, bool]) -> DataFrame:
    """A one-row table of counts as evidence rows; a count that matters has to be there and zero."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).cast("long").alias("detail"), F.lit(m).alias("_m")) for n, m in limits.items()]))
    rows = df.select(cells.alias("_c")).select("_c.*")
    passed = F.coalesce(~F.col("_m") | (F.col("detail") == 0), F.lit(False))
    return rows.select(F.lit(check).alias("check"), "item", "detail", passed.alias("passed"))


def build_checks(windows: DataFrame, rows: DataFrame, names, scaled=SCALED, lookback: int = LOOKBACK) -> DataFrame:
    """(check, passed, detail) rows over stored windows: targets, input cells, channels, normalised range, leaks.

    ``windows`` have ``inputs`` and ``targets`` as stored, ``rows`` are the z-scored panel rows, ``names`` the channels that the
    store's metadata lists.
    """
    held = windows.schema["inputs"].dataType.elementType.names
    lost = lambda c: c.isNull() | F.isnan(c)
    # One pass over the cells, step by step; what belongs to a whole window counts at its first step.
    first = F.coalesce(F.col("_step"), F.lit(0)) == 0
    cells = windows.select("targets", F.size("inputs").alias("_size"), F.posexplode_outer("inputs").alias("_step", "_x"))
    off_targets = lambda f: F.when(first, F.size(F.filter("targets", f)))
    channels = len(set(held) ^ set(names))
    n_lost = sum((F.when(F.col("_step").isNotNull() & lost(F.col("_x")[c]), 1).otherwise(0) for c in held), F.lit(0))
    t = cells.agg(
        F.coalesce(F.sum(n_lost), F.lit(0)).alias("null_inputs"),
        F.coalesce(F.sum(off_targets(lost)), F.lit(0)).alias("null_targets"),
        F.coalesce(F.sum(off_targets(lambda x: x < 0)), F.lit(0)).alias("negative_targets"),
        (F.count_if(first & (F.col("_size") != lookback)) + F.lit(channels)).alias("feature_count"))
    aggs = []
    for f in scaled:
        aggs += [F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std")]
    stats = unpivot(rows.filter("split = 'train'").agg(*aggs), [], scaled, ["mean", "std"])
    off = stats.agg(F.count_if(F.abs("mean") > 0.1).alias("mean_range"),
                    F.count_if(~F.col("std").between(0.9, 1.1)).alias("std_range"))
    train = windows.filter("split = 'train'").select("series_id").distinct()
    held_out = windows.filter("split <> 'train'").select("series_id").distinct()
    leaks = held_out.join(train, "series_id", "left_semi").agg(F.count(F.lit(1)).alias("leaked_series"))
    out = _items("build", t, dict.fromkeys(("null_inputs", "null_targets", "negative_targets", "feature_count"), True))
    out = out.unionByName(_items("build", off, {"mean_range": True, "std_range": True}))
    out = out.unionByName(_items("build", leaks, {"leaked_series": True}))
    return out.select(F.col("item").alias("check"), "passed", "detail")


def sanity_by_series(windows: DataFrame) -> DataFrame:
    """Windows and fire-active windows of every series."""
    return windows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("fire_active").alias("n_fire"))


def baseline_sanity(summary: DataFrame, windows: DataFrame, reference: str = "persistence") -> DataFrame:
    """Is persistence the lowest at t+1; mean target of fire-active windows; window counts."""
    lowest = summary.filter(F.col("lead") == 1).agg(
        F.min_by("baseline", F.struct("mae_fire_mean", "baseline")).alias("b")).scalar()
    total = F.sum(F.when(F.col("fire_active"), F.col("target_mean_frp")))
    return windows.agg(
        (total / F.count_if("fire_active")).alias("mean_fire_value"),
        F.count(F.lit(1)).alias("n_all"), F.count_if("fire_active").alias("n_fire"),
    ).select(lowest.alias("lowest_at_t1"), (lowest == reference).alias("persistence_lowest"),
             "mean_fire_value", "n_all", "n_fire")


def integrity_counts(cells: DataFrame) -> DataFrame:
    """One row from ``cell_integrity``: bad cells, constant (split, feature) pairs, extreme cells."""
    return cells.agg(F.sum("n_nan").alias("n_nan"), F.sum("n_inf").alias("n_inf"),
                     F.count_if("is_constant").alias("constant"), F.sum("n_extreme").alias("n_extreme"))


def integrity_verdict(cells: DataFrame) -> DataFrame:
    """Per split: the counts, and whether no cell is NaN or infinite and no feature constant."""
    per = cells.groupBy("split").agg(F.sum("n_nan").alias("n_nan"), F.sum("n_inf").alias("n_inf"),
                                     F.count_if("is_constant").alias("n_constant"), F.sum("n_extreme").alias("n_extreme"))
    return per.withColumn("passed", (F.col("n_nan") == 0) & (F.col("n_inf") == 0) & (F.col("n_constant") == 0))


def evidence(rows: DataFrame, aligned: DataFrame, catalogue: DataFrame, features=FEATURES, layout: Layout | None = None) -> DataFrame:
    """(check, item, detail, passed): all seven readiness checks from the built dataset.

    ``rows`` are scaled panel rows with window columns and ``window_weight``; ``aligned`` comes from ``alignment``. Counts that only
    inform (gaps between windows, extreme values, series without windows whose reason is known) never fail. A check without
    rows has not passed.
    """
    w = rows.filter("is_anchor")
    audit = window_audit(rows, catalogue).agg(
        F.count_if(F.col("n_windows") == 0).alias("series_without_windows"),
        F.count_if(F.col("status").isNull()).alias("undocumented"), F.nullif(F.count(F.lit(1)), F.lit(0)).alias("_n"))
    audit = audit.withColumn("undocumented", F.when(F.col("_n").isNotNull(), F.col("undocumented")))
    leaks = split_leaks(w).agg(F.count(F.lit(1)).alias("cross_split"))
    gaps = start_gap_counts(w, layout).agg(F.sum("n_gaps").alias("start_gaps"))
    cells = integrity_counts(cell_integrity(rows, features))
    targets = target_sanity(w).agg(F.sum("n_null").alias("n_null"), F.sum("n_negative").alias("n_negative"))
    drifted = drift(rows, [f for f in SCALED if f in features]).agg(F.count_if(~F.col("match") | F.col("match").isNull()).alias("mismatches"))
    spots = aligned.agg(F.sum((~F.col("target_ok")).cast("long")).alias("targets"), F.sum((~F.col("input_ok")).cast("long")).alias("inputs"))
    parts = [
        _items("coverage", audit, {"undocumented": True, "series_without_windows": False}),
        _items("leakage", leaks, {"cross_split": True}), _items("leakage", gaps, {"start_gaps": False}),
        _items("integrity", cells, {"n_nan": True, "n_inf": True, "constant": True, "n_extreme": False}),
        _items("targets", targets, {"n_null": True, "n_negative": True}),
        _items("drift", drifted, {"mismatches": True}),
        _items("alignment", spots, {"targets": True, "inputs": True}),
        _items("tiers", missing_tiers(w, catalogue), {"missing_tiers": True}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdict(checks: DataFrame) -> DataFrame:
    """All checks passed?  The failed list has at most one entry per check."""
    return checks.agg(
        F.bool_and("passed").alias("ready"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("check")))), ",").alias("failed"))
