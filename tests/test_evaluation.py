import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators.features import long_form
from panelcast.plans import baselines as B
from panelcast.plans import bootstrap as BS
from panelcast.plans import conformal as U
from panelcast.plans import ensembles as E
from panelcast.plans import evaluation as ev
from panelcast.plans import reporting as L

# Published results of the forecast comparison (fixed values to reproduce).
FULL = {"c": 0.2184139801332431, "vm": 0.19642172233403588, "vn": 0.2856292106161915, "vo": 0.49857158949136415}
FULL_MEAN, FULL_CI = 0.29975912564370866, (0.20741785123363948, 0.42853218715183394)
BASE = {"c": 0.0842415404732475, "vm": 0.19338848182975943, "vn": 0.18373691323597052, "vo": 0.3261129964899553}
BASE_MEAN, BASE_CI = 0.19686998300723318, (0.11152827581237548, 0.2905189756764591)
TUNED = {"c": 0.1367787172211299, "vm": 0.17018642148094087, "vn": 0.2504581949094047, "vo": 0.40336791919830073}
TUNED_MEAN, TUNED_CI = 0.24019781320244404, (0.15348256935103538, 0.34507254476896077)
SEED_SS = [0.285761334153095, 0.2698188985231452, 0.26751791843039746, 0.2664974401869065, 0.2639989851055673,
           0.2809120716625021, 0.24020994020523526, 0.2671569788679876, 0.2369244259837718, 0.2740941488413895]
SEED_MEAN, SEED_STD = 0.2652892141959998, 0.015657222855720077
LAG_RIDGE = {"vo": 0.054803722747227335, "vn": -2.331324024249156, "vm": 0.13337566176208915, "c": -0.16241450540534474}
LAG_RIDGE_MEAN = -0.5763897862862961
ABLATION = [("full", 0.281911, 0.0), ("no_aligned_loss", 0.255836, -0.026075), ("no_wind", 0.284681, 0.002770),
            ("no_balance", 0.278715, -0.003197), ("base", 0.274033, -0.007878)]
CALIBRATION_90 = [(133, 0.9323, 538780.0067), (72, 0.7500, 1241206.9732), (192, 0.9635, 465759.5390), (183, 0.8743, 496600.4391)]


def per_event(spark, d):
    return spark.createDataFrame([(k, v) for k, v in d.items()], "series_id string, ss double")


@pytest.mark.parametrize("d,mean,ci", [(FULL, FULL_MEAN, FULL_CI), (BASE, BASE_MEAN, BASE_CI), (TUNED, TUNED_MEAN, TUNED_CI)])
def test_mean_skill_and_exact_bootstrap(spark, d, mean, ci):
    df = per_event(spark, d)
    assert ev.cross_event(df).first().mean == pytest.approx(mean, abs=1e-12)
    b = BS.bootstrap(df, method="exact").first()
    assert (b.ci_lo, b.ci_hi) == pytest.approx(ci, abs=1e-8) and b.ci_excludes_zero


def test_hash_bootstrap_is_repeatable_and_near_the_exact_one(spark):
    df = per_event(spark, FULL)
    a, b = (BS.bootstrap(df, n_boot=4000).first() for _ in range(2))
    assert a == b and a.ci_lo == pytest.approx(FULL_CI[0], abs=0.01) and a.ci_hi == pytest.approx(FULL_CI[1], abs=0.01)


def test_seed_mean_and_deviation(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(SEED_SS)], "series_id long, ss double")
    r = ev.cross_event(df).first()
    assert (r.mean, r.std, r.n_events) == (pytest.approx(SEED_MEAN), pytest.approx(SEED_STD), 10)


def test_unknown_skill_leaves_the_mean_and_one_value_has_zero_deviation(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "series_id string, ss double")
    r = ev.cross_event(df).first()
    assert (r.mean, r.std, r.n_events) == (0.5, 0.0, 1)
    assert ev.cross_event(df, single_std=None).first().std is None
    assert ev.cross_event(per_event(spark, LAG_RIDGE)).first().mean == pytest.approx(LAG_RIDGE_MEAN)


def test_deltas_to_a_reference_row(spark):
    df = spark.createDataFrame(ABLATION, "config string, ss double, want double")
    for r in L.deltas(df, "config", "full", "ss", "delta").collect():
        assert r.delta == pytest.approx(r.want, abs=2e-6)


def test_mean_rows_average_events_not_samples(spark):
    df = spark.createDataFrame([(0.9, str(i), *r) for i, r in enumerate(CALIBRATION_90)],
                               "level double, event string, n_fire long, coverage double, width_mean double")
    r = ev.with_mean_rows(df, ["level"], ["coverage", "width_mean"]).filter("event = 'MEAN'").first()
    assert (r.n_fire, round(r.coverage, 4)) == (580, 0.8800) and r.width_mean == pytest.approx(685586.7395, abs=1e-3)


def rows(spark, data):
    return spark.createDataFrame(data, "series_id string, y double, pred double, persistence double, fire_active boolean")


def test_event_skill_edges(spark):
    df = rows(spark, [("a", 4.0, 3.0, 2.0, True), ("a", 0.0, 1.0, 2.0, True), ("a", 9.0, 0.0, 0.0, False),
                      ("quiet", 0.0, 1.0, 1.0, False), ("exact", 2.0, 1.0, 2.0, True)])
    want = spark.createDataFrame([("a",), ("quiet",), ("exact",), ("absent",)], "series_id string")
    got = {r.series_id: r for r in ev.event_skill(df, expected=want).collect()}
    assert (got["a"].n_fire, got["a"].mae_model, got["a"].mae_pers, got["a"].ss) == (2, 1.0, 2.0, 0.5)
    assert (got["quiet"].n_fire, got["quiet"].ss) == (0, None)
    assert (got["exact"].mae_pers, got["exact"].ss) == (0.0, None)
    assert (got["absent"].n_fire, got["absent"].ss) == (0, None)
    same = ev.event_skill(df.withColumn("pred", F.col("persistence"))).filter("series_id = 'a'").first()
    assert same.ss == 0.0


def test_aligned_score_skips_unknown_series_and_is_zero_without_fire(spark):
    df = spark.createDataFrame([("a", 6, 5.0, 3.0, True), ("a", 1, 1.0, 2.0, True), ("x", 6, 1.0, 9.0, True)],
                               "series_id string, lead int, y double, pred double, fire_active boolean")
    table = spark.createDataFrame([("a", 6, 4.0), ("a", 1, 2.0)], "series_id string, lead int, mae_pers double")
    r = ev.skill_aligned_score(df, table).first()
    assert r.n_events == 1 and r.skill_term == pytest.approx(0.5 * 2 / (4 + 1e-6) + 0.1 * 1 / (2 + 1e-6))
    quiet = ev.skill_aligned_score(df.withColumn("fire_active", F.lit(False)), table).first()
    assert (quiet.skill_term, quiet.n_events) == (0.0, 0)
    assert sum(ev.horizon_weights(6).values()) == pytest.approx(1) and 12 not in ev.horizon_weights(6)


def test_trend_equals_a_least_squares_line(spark):
    rng = np.random.default_rng(0)
    data = [tuple(float(x) for x in rng.gamma(1, 10, 4) * (rng.random(4) > 0.3)) for _ in range(50)] + [(0.0,) * 4]
    df = spark.createDataFrame(data, "frp_lag_6h double, frp_lag_3h double, frp_lag_2h double, frp_lag_1h double")
    got = df.withColumn("lead", F.lit(7)).select("*", B.trend(F.col("lead")).alias("p")).collect()
    for r in got:
        slope = np.polyfit([-5, -2, -1, 0], list(r)[:4], 1)[0]
        assert r.p == pytest.approx(max(0.0, r.frp_lag_1h + 7 * slope), abs=1e-9)


def test_ensembles_lie_between_the_seeds(spark):
    rng = np.random.default_rng(1)
    data = [("s", t, 6, s, float(rng.gamma(1, 9))) for t in range(20) for s in range(10)]
    df = spark.createDataFrame(data, "series_id string, slot_utc int, lead int, seed int, pred double")
    pdf = df.toPandas().pivot(index="slot_utc", columns="seed", values="pred").sort_index()
    logs = np.log1p(pdf.to_numpy())
    want = {E.log_mean: np.expm1(logs.mean(1)), E.log_median: np.expm1(np.median(logs, 1)),
            E.trimmed_log_mean: np.expm1(np.sort(logs, 1)[:, 1:-1].mean(1))}
    for fn, w in want.items():
        got = fn(df).orderBy("slot_utc").toPandas().pred.to_numpy()
        np.testing.assert_allclose(got, w)
        assert ((got >= pdf.min(axis=1)) & (got <= pdf.max(axis=1))).all()
    b = E.band(df).orderBy("slot_utc").toPandas()
    np.testing.assert_allclose(b.lo, np.percentile(pdf, 25, axis=1))
    with pytest.raises(FileNotFoundError, match="11"):
        E.require_seeds(df, [0, 11])


def test_leave_one_out_equals_the_direct_form(spark):
    rng = np.random.default_rng(3)
    parts = {"hot": 300, "b": 40, "c": 7, "one": 1}
    data = [(k, i, float(np.round(rng.gamma(1, 1), 1 if k == "hot" else 6))) for k, n in parts.items() for i in range(n)]
    df = spark.createDataFrame(data, "series_id string, slot_utc int, score double")
    pdf = df.toPandas()
    for splits in (None, [], [0.2, 0.4, 1.0, 1.5]):
        got = U.leave_one_out_quantiles(df, splits=splits).toPandas()
        assert len(got) == 12
        for r in got.itertuples():
            cal = np.sort(pdf[pdf.series_id != r.series_id].score)
            k = int(np.ceil((len(cal) + 1) * r.level))
            assert r.n_cal == len(cal) and r.q == (cal[k - 1] if k <= len(cal) else np.inf)


def test_too_few_scores_give_infinite_intervals(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 4.0, True), ("b", 1, 2.0, 3.0, True), ("b", 2, 1.0, 3.0, True)],
                               "series_id string, slot_utc int, y double, pred double, fire_active boolean")
    s = U.with_scores(df)
    q = {(r.series_id, r.level): r.q for r in U.leave_one_out_quantiles(s).collect()}
    assert q["b", 0.9] == np.inf and q["a", 0.5] < np.inf
    rep = U.calibration(df).filter("level = 0.9").toPandas().set_index("event")
    assert rep.loc["b", "coverage"] == 1.0 and rep.loc["b", "width_mean"] == np.inf
    cov = U.calibration(df).filter("event = 'MEAN'").orderBy("level").toPandas().coverage
    assert cov.is_monotonic_increasing


def test_epoch_rules(spark):
    scores = {0: [0.1, 0.3, 0.3, None, 0.2, 0.1, 0.2, 0.25, 0.9], 1: [float("nan")] * 7, 2: [0.1, 0.2, 0.3]}
    df = spark.createDataFrame([(s, i + 1, v) for s, vs in scores.items() for i, v in enumerate(vs)],
                               "seed int, epoch int, val_SS_paper double")
    best = {r.seed: r.best_epoch for r in L.best_epoch(df.filter("seed <> 0 or epoch < 9")).collect()}
    assert best == {0: 2, 2: 3}
    stop = {r.seed: r.stopped_at for r in L.stop_epoch(df).collect()}
    assert stop == {0: 7, 1: 5, 2: 3}


def test_versions_keep_absent_baselines(spark):
    t = lambda d: spark.createDataFrame(list(d.items()), "baseline string, ss_mean double")
    got = {r.baseline: r for r in L.compare_versions(t({"a": 1.0}), t({"a": 2.0, "b": 3.0}), t({"a": 5.0, "c": 1.0})).collect()}
    assert got["a"].delta == 3.0 and got["b"].v3 is None and got["c"].delta is None and len(got) == 3


def test_climatology_falls_back_to_the_overall_mean(spark):
    pdf = pd.DataFrame({"split": "train", "fire_active": True, "target_hour": [3, 3, 5], "y": [1.0, 3.0, 8.0]})
    t = {r.target_hour: r.diurnal_climatology for r in B.hourly_climatology(spark.createDataFrame(pdf)).collect()}
    assert (len(t), t[3], t[5], t[0]) == (24, 2.0, 8.0, 4.0)
    empty = B.hourly_climatology(spark.createDataFrame(pdf).filter("y < 0"))
    assert {r.diurnal_climatology for r in empty.collect()} == {0.0}
    assert long_form is not None


def test_leave_one_out_lookups_spread_evenly(spark):
    from pyspark.sql import functions as F

    from panelcast.operators.layout import cumulative_cells, splitters
    from panelcast.plans import conformal as U

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"series_id": np.repeat(np.arange(20_000), 5), "score": np.round(rng.gamma(1.0, 1.0, 100_000), 3)})
    scores = spark.createDataFrame(pdf).cache()
    everyone = cumulative_cells(scores, [], "score", splitters(scores, "score")).cache()
    asked = U.asked_positions(scores, everyone, splits=splitters(scores, "score"))
    groups = U.placed_lookups(everyone, asked.filter("pos is not null")).groupBy("_block", "_copy").agg(
        F.count_if(F.col("_kind") == 0).alias("lookups"), F.count_if(F.col("_kind") == 1).alias("cells"))
    most = groups.agg(F.max("lookups"), F.max("cells"), F.sum("lookups")).first()
    share = -(-100_000 // int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert most[0] <= share and most[1] <= share + 1 and most[2] == 60_000
    got = U.leave_one_out_quantiles(scores).filter("series_id % 2500 = 0").toPandas()
    assert len(got) == 24
    for r in got.itertuples():
        other = np.sort(pdf.score[pdf.series_id != r.series_id].to_numpy())
        assert r.q == other[int(np.ceil((len(other) + 1) * r.level)) - 1] and r.n_cal == len(other)
    scores.unpersist(), everyone.unpersist()


@pytest.mark.parametrize("text", [False, True])
def test_window_numbers_of_sparse_ids_meet_in_even_ranges(spark, text):
    from pyspark.sql import functions as F

    from panelcast.operators import layout as lay
    from panelcast.plans import manifest as M

    rng = np.random.default_rng(4)
    ids = rng.integers(-(1 << 62), 1 << 62, 6_000)
    pdf = pd.DataFrame({"series_id": ids, "n": rng.integers(1, 6, 6_000), "split": rng.choice(["train", "val", "test"], 6_000, p=[0.8, 0.1, 0.1])})
    df = spark.createDataFrame(pdf).withColumn("slot_utc", F.explode(F.expr("sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-01' + make_dt_interval(0, int(n) - 1), interval 1 hour)")))
    df = df.withColumn("series_id", F.concat(F.lit("s"), F.col("series_id").cast("string"))) if text else df
    _, coarse = lay.order_value(df, "series_id")
    held = lay.value_range(df.select("series_id", "split", coarse.alias("v")).distinct(), "v", lay.splitters(df.select("series_id", coarse.alias("v")).distinct(), "v"), "c")
    sizes = held.groupBy("c").count().toPandas()["count"]
    assert len(sizes) >= 8 and sizes.max() <= 2 * sizes.mean()
    got = M.with_sample_index(df, "series_id").toPandas()
    got["key"] = [__import__("hashlib").md5(s.encode()).hexdigest() for s in got.series_id] if text else got.series_id
    got["rank"] = got.split.map({"train": 0, "val": 1, "test": 2})
    got = got.sort_values(["rank", "key", "slot_utc"])
    assert got.sample_idx.tolist() == list(range(len(got)))


def test_an_observation_on_the_end_of_its_interval_is_covered(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(round(y, 2)), float(p), True) for i, (y, p) in enumerate(zip(rng.gamma(2.0, 40.0, 400), rng.gamma(2.0, 40.0, 400)))]
    scores = U.with_scores(spark.createDataFrame(rows, "series_id long, y double, pred double, fire_active boolean"))
    ends = U.intervals(scores, scores.select("series_id", F.lit(0.5).alias("level"), F.col("score").alias("q"))).cache()
    assert ends.filter("not y between lo and hi").count() > 0  # by a last bit
    assert U.interval_report(ends, ["series_id"]).filter("coverage < 1").count() == 0
    assert U.interval_report(ends.withColumn("q", F.col("q") * 0.999), ["series_id"]).filter("coverage > 0").count() == 0
    assert U.interval_report(ends.drop("score"), ["series_id"]).filter("coverage < 1").count() > 0  # ends alone tell no more


@pytest.mark.parametrize("combine", [E.log_mean, E.trimmed_log_mean, E.log_median])
def test_seeds_side_by_side_give_what_long_rows_give(spark, combine):
    rng = np.random.default_rng(1)
    rows = [("a", t, 1 + t % 3, float(t), [None if rng.random() < 0.3 else float(v) for v in rng.normal(20, 30, t % 6)]) for t in range(40)]
    wide = spark.createDataFrame(rows, "series_id string, slot_utc long, lead int, y double, preds array<double>")
    long = wide.select("series_id", "slot_utc", "lead", "y", F.explode_outer("preds").alias("pred"))
    got = combine(wide).orderBy("slot_utc").toPandas()
    want = combine(long.filter("slot_utc % 6 > 0")).orderBy("slot_utc").toPandas()
    assert got[got.slot_utc % 6 == 0].pred.isna().all() and list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got[got.slot_utc % 6 > 0].reset_index(drop=True), want, rtol=1e-12)


@pytest.mark.parametrize("name", ["log_mean_ensemble", "trimmed_ensemble", "median_ensemble"])
def test_ensembles_group_nothing_after_the_windows(spark, small, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Window")]
    assert "Aggregate" not in above and "Sort" not in above
