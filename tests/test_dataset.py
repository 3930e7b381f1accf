import json
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import frame, series
from pyspark.sql import functions as F

from panelcast.operators import features as feat
from panelcast.operators.layout import Layout
from panelcast.plans import dataset as D
from panelcast.plans import manifest as M
from panelcast.plans import quality as Q
from panelcast.plans import readiness as R
from panelcast.plans import ridge as RG
from panelcast.plans import sampling as S
from panelcast.plans import scoring as SC
from panelcast.schema import AR_RIDGE_FEATURES, COVARIATES, FEATURES, WIND_FEATURES
from panelcast.sources import readers, writers

PLAIN = Layout()


@pytest.fixture(scope="module")
def panel(spark):
    parts = [series("a", 150, 1), series("b", 120, 2), series("v", 110, 3, "val"), series("t", 100, 4, "test"),
             series("few", 86, 5, fire=0.02), series("quiet", 100, 6, fire=0.0)]
    return frame(spark, pd.concat(parts, ignore_index=True)).cache()


# ------------------------------------------------------------- sampling

def test_batches_hold_distinct_series_and_windows(panel):
    w = feat.anchors(panel, PLAIN)
    got = S.event_balanced_batches(w, 3, 4, num_batches=6, seed=1).toPandas()
    again = S.event_balanced_batches(w, 3, 4, num_batches=6, seed=1).toPandas()
    assert sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, again.to_numpy()))
    assert len(got) == 6 * 3 * 4 and "quiet" not in set(got.series_id)
    sizes = w.filter("fire_active").groupBy("series_id").count().toPandas().set_index("series_id")["count"]
    for (b, s), g in got.groupby(["batch", "series_id"]):
        assert len(g) == 4
        if sizes[s] >= 4:
            assert g.slot_utc.nunique() == 4
    assert (got.groupby("batch").series_id.nunique() == 3).all()


def test_default_batch_count_is_the_floor(panel):
    w = feat.anchors(panel, PLAIN)
    n = w.filter("fire_active").count()
    k = min(8, w.filter("fire_active").select("series_id").distinct().count())
    got = S.event_balanced_batches(w)
    assert got.select("batch").distinct().count() == max(1, n // 64)
    assert got.count() == max(1, n // 64) * k * 8


def test_distinct_draws_are_even(spark):
    df = spark.range(4000).select(S.distinct_draws(F.lit(5).cast("long"), 2, F.lit("x"), F.col("id").cast("string")).alias("d"))
    pairs = Counter(tuple(r.d) for r in df.collect())
    assert len(pairs) == 10 and all(a < b for a, b in pairs)
    assert max(pairs.values()) < 1.3 * min(pairs.values())


def test_spot_sample_takes_at_most_five_per_split(panel):
    got = S.spot_sample(feat.anchors(panel, PLAIN).select("split", "series_id", "slot_utc"))
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 5, "val": 5, "test": 5}


# ------------------------------------------------------------- ridge and scoring

def brute_ridge(x, y, alphas, folds=5):
    """Fit with rows in memory: contiguous folds, R2 per fold, first best penalty."""
    def solve(a, b, alpha):
        m, c = a.mean(0), b.mean()
        w = np.linalg.solve((a - m).T @ (a - m) + alpha * np.eye(a.shape[1]), (a - m).T @ (b - c))
        return w, c - m @ w

    parts = np.array_split(np.arange(len(y)), folds)
    best, top = None, -np.inf
    for alpha in alphas:
        s = []
        for p in parts:
            keep = np.setdiff1d(np.arange(len(y)), p)
            w, b = solve(x[keep], y[keep], alpha)
            e = y[p] - x[p] @ w - b
            s.append(1 - (e @ e) / ((y[p] - y[p].mean()) @ (y[p] - y[p].mean())))
        if np.mean(s) > top:
            best, top = alpha, np.mean(s)
    return best, *solve(x, y, best)


def test_gram_ridge_equals_a_direct_fit(panel):
    w = M.with_sample_index(feat.anchors(panel, PLAIN)).cache()
    model = RG.fit(w, AR_RIDGE_FEATURES)
    train = w.filter("split = 'train'").orderBy("sample_idx").toPandas()
    x, y = train[list(AR_RIDGE_FEATURES)].to_numpy(), np.array(train.targets.tolist(), float)
    for k in (1, 6, 12):
        alpha, wts, b = brute_ridge(x, y[:, k - 1], (0.1, 1.0, 10.0, 100.0))
        assert model.alphas[k - 1] == alpha
        np.testing.assert_allclose(model.weights[k - 1], wts, rtol=1e-6)
        assert model.intercepts[k - 1] == pytest.approx(b, rel=1e-8)
    preds = RG.predict(w, model).orderBy("sample_idx").limit(20).toPandas()
    np.testing.assert_allclose([p[0] for p in preds.preds], np.maximum(
        preds[list(AR_RIDGE_FEATURES)].to_numpy() @ model.weights[0] + model.intercepts[0], 0))


@pytest.mark.parametrize("n", [5, 7, 23, 100])
def test_folds_are_contiguous(spark, n):
    got = spark.range(n).select(RG.fold_of(F.col("id"), n).alias("f")).toPandas().f.tolist()
    assert got == [i for i, p in enumerate(np.array_split(np.arange(n), 5)) for _ in p]


def test_a_user_model_sees_whole_windows_in_batches(panel):
    seen = AR_RIDGE_FEATURES[0]
    i = FEATURES.index(seen)

    def model(x):
        assert x.shape[1:] == (48, 32) and len(x) <= 10
        return np.repeat(x[:, -1, i][:, None], 12, 1)

    got = SC.predict_panel(panel, model, layout=PLAIN, batch_size=10)
    both = got.join(feat.anchors(panel, PLAIN), ["series_id", "slot_utc"])
    assert both.count() == got.count() > 0 and both.filter(F.col("preds")[11] != F.col(seen)).count() == 0


# ------------------------------------------------------------- quality and readiness

def test_gate_rounds_first_and_flags_unknown(spark):
    m = spark.createDataFrame([("a", 0.4, 0.3, 3), ("b", 0.4001, 0.0, 9), ("c", 0.1, None, 9), ("d", 0.1, 0.1, 2)],
                              "series_id string, gap_rate double, sat_rate double, complete_days int")
    got = {r.series_id: r for r in Q.gate(m).collect()}
    assert [got[k].overall for k in "abcd"] == ["OK", "FLAG", "FLAG", "FLAG"] and got["c"].sat_flag == "N/A"
    p = pd.DataFrame({"series_id": "s", "slot_utc": pd.date_range("2024-01-01", periods=48, freq="h"),
                      "slot_type": ["missing"] * 12 + ["fire"] * 12 + ["missing"] * 11 + ["no_fire"] * 13,
                      "frp_sum_mw": 2.0, "sat_fraction": [0.3, 0.31] * 24})
    r = Q.audit(frame(spark, p)).first()
    assert (r.gap_rate, r.sat_rate, r.complete_days, r.peak_frp_mw, r.n_fire_slots) == (0.4792, 0.5, 1, 2.0, 12)


def test_audit_gives_the_reason_for_no_windows(spark, panel):
    extra = frame(spark, pd.concat([series("short", 50, 9), series("mid", 70, 8)]))
    cat = spark.createDataFrame([(s, "train") for s in ("a", "short", "mid", "ghost")], "series_id string, split string")
    rows = feat.build_rows(panel.unionByName(extra), PLAIN)
    got = {r.series_id: r.status for r in R.window_audit(rows, cat).collect()}
    assert got == {"a": "ok", "short": "too short", "mid": "all windows incomplete", "ghost": "no data"}


def test_checks_fail_when_they_should(spark, panel):
    scaling = D.fit(panel, PLAIN)
    w = D.scaled_windows(panel, scaling, PLAIN).cache()
    rows = D.scaled_rows(panel, scaling, PLAIN)
    good = {r.check: r for r in R.build_checks(w, rows, scaling.channels, scaling.params).collect()}
    assert all(r.passed for r in good.values()) and len(good) == 7
    moved = w.withColumn("split", F.when((F.col("series_id") == "a") & (F.col("row_no") > 90), "val").otherwise(F.col("split")))
    assert [r.series_id for r in R.split_leaks(moved).collect()] == ["a"]
    raw = feat.feature_rows(panel, PLAIN)
    got = {r.check: r for r in R.build_checks(moved, raw, scaling.channels[:-1], scaling.params).collect()}
    assert {c for c, r in got.items() if not r.passed} == {"leaked_series", "mean_range", "std_range", "feature_count"}
    v = R.verdict(R.build_checks(moved, raw, scaling.channels, scaling.params)).first()
    assert not v.ready and v.failed == "leaked_series,mean_range,std_range"
    holes = w.withColumn("inputs", F.transform("inputs", lambda x, i: x.withField("u10", F.when(i != 4, x["u10"]))))
    got = {r.check: r.detail for r in R.build_checks(holes, rows, scaling.channels, scaling.params).collect()}
    assert got["null_inputs"] == w.count()
    empty = R.build_checks(w.limit(0), rows.limit(0), scaling.channels, scaling.params).filter("not passed").collect()
    assert {r.check for r in empty} == set()  # no window has a fault; that there are none is the evidence's to say
    bad = w.withColumn("targets", F.transform("targets", lambda x: x - 1e6))
    assert not R.target_sanity(bad).filter("split = 'val'").first().passed


def test_evidence_names_what_is_wrong(spark, panel):
    scaling = D.fit(panel, PLAIN, wind=False)
    rows = D.scaled_rows(panel, scaling, PLAIN).cache()
    ids = [r.series_id for r in panel.select("series_id").distinct().collect()]
    tiers = ("high", "medium", "low")
    cat = spark.createDataFrame([(s, "train", tiers[i % 3]) for i, s in enumerate(sorted(ids))], "series_id string, split string, intensity_tier string")
    fine = spark.createDataFrame([(True, True)], "target_ok boolean, input_ok boolean")

    def failed(rows=rows, aligned=fine, cat=cat):
        e = R.evidence(rows, aligned, cat, scaling.features, PLAIN)
        assert e.count() == 14
        return {(r.check, r.item) for r in e.filter("not passed").collect()}

    base = failed()
    assert base <= {("tiers", "missing_tiers"), ("drift", "mismatches")}  # small hand-made panels drift
    assert failed(aligned=spark.createDataFrame([(True, False)], "target_ok boolean, input_ok boolean")) - base == {("alignment", "inputs")}
    assert failed(aligned=fine.limit(0)) - base == {("alignment", "targets"), ("alignment", "inputs")}
    assert failed(rows.withColumn("u10", F.lit(1.0))) - base == {("integrity", "constant")} | ({("drift", "mismatches")} - base)
    assert ("targets", "n_negative") in failed(rows.withColumn("targets", F.transform("targets", lambda x: -1 - x)))
    assert failed(cat=cat.withColumn("intensity_tier", F.lit("high"))) >= {("tiers", "missing_tiers")}
    crossed = rows.withColumn("split", F.when((F.col("series_id") == "a") & (F.col("row_no") > 90), "val").otherwise(F.col("split")))
    assert ("leakage", "cross_split") in failed(crossed)
    assert not R.verdict(R.evidence(crossed, fine, cat, scaling.features, PLAIN)).first().ready


def brute_window(g, end, scaling):
    """Inputs of the window that ends at row ``end`` of one series' feature rows, wind frames inside the window only."""
    steps = g.iloc[end - 47:end + 1]
    x = {f: steps[f].to_numpy() for f in scaling.features}
    for f, (m, s) in scaling.params.items():
        x[f] = (x[f] - m) / s
    wind = {f: np.empty(48) for f in scaling.wind}
    for t in range(48):
        part = steps.iloc[max(0, t - 11):t + 1]
        row = steps.iloc[t]
        wind["shear_signed"][t] = row.wind_speed_850 - row.wind_speed_10m
        wind["hdw_product"][t] = row.vpd_kPa * row.wind_speed_10m
        wind["wind_frp_coupling"][t] = row.wind_speed_850 * max(row.frp_lag_1h, 0)
        wind["wind_var_12h"][t] = part.u10.std(ddof=0) + part.v10.std(ddof=0)
        wind["ws850_max_12h"][t] = part.wind_speed_850.max()
    return np.stack([*x.values(), *[(wind[f] - m) / s for f, (m, s) in scaling.wind.items()]], axis=1)


@pytest.mark.parametrize("lay", [PLAIN, Layout(blocked=True, block_rows=90, chunk_days=3)])
def test_scaled_windows_equal_brute_force(panel, lay):
    scaling = D.fit(panel, lay)
    assert scaling.channels == (*FEATURES, *WIND_FEATURES)
    rows = feat.feature_rows(panel, PLAIN).toPandas().sort_values(["series_id", "slot_utc"])
    got = D.scaled_windows(panel, scaling, lay).filter("series_id in ('a', 'b')").toPandas()
    assert len(got) > 20
    for r in got.sample(12, random_state=1).itertuples():
        g = rows[rows.series_id == r.series_id].reset_index(drop=True)
        want = brute_window(g, r.row_no - 1, scaling)
        have = np.array([[x[c] for c in scaling.channels] for x in r.inputs], float)
        np.testing.assert_allclose(have, want, rtol=1e-9, atol=1e-9)
    every = np.concatenate([brute_window(g.reset_index(drop=True), t - 1, scaling)[:, len(FEATURES):]
                            for s, g in rows[rows.split == "train"].groupby("series_id")
                            for t in D.scaled_windows(panel, scaling, PLAIN).filter(F.col("series_id") == s).toPandas().row_no])
    np.testing.assert_allclose(every.mean(axis=0), 0, atol=1e-6)
    np.testing.assert_allclose(every.std(axis=0), 1, atol=1e-6)


def test_a_constant_feature_is_left_out_and_nulls_in_it_do_not_matter(panel):
    flat = panel.withColumn("blh_m", F.when(F.col("slot_utc") > F.lit("2024-02-22").cast("timestamp_ntz"), 7.0))
    scaling = D.fit(flat, PLAIN)
    assert "blh_m" not in scaling.channels and len(scaling.channels) == 36
    w = D.scaled_windows(flat, scaling, PLAIN)
    assert w.count() == feat.anchors(panel, PLAIN).count()
    assert w.schema["inputs"].dataType.elementType.names == list(scaling.channels)


def test_drift_of_raw_rows_is_that_of_scaled_ones(panel):
    scaling = D.fit(panel, PLAIN, wind=False)
    a = R.drift(D.scaled_rows(panel, scaling, PLAIN)).toPandas().set_index("feature").sort_index()
    b = R.drift_of_raw(feat.weighted_rows(panel, PLAIN)).toPandas().set_index("feature").sort_index()
    np.testing.assert_allclose(a["mean"], b["mean"], atol=1e-8)
    np.testing.assert_allclose(a["std"], b["std"], atol=1e-8)
    assert (a.match == b.match).all()


def test_alignment_notices_a_shifted_target(panel):
    w = S.spot_sample(feat.anchors(panel, PLAIN)).cache()
    pw = feat.open_panel(panel, PLAIN)
    raw = pw.close(pw.df)
    ok = R.alignment(w, raw).toPandas()
    assert len(ok) == 15 and ok.target_ok.all() and ok.input_ok.all()
    shifted = R.alignment(w.withColumn("targets", F.transform("targets", lambda x: x + 1)), raw).toPandas()
    assert not shifted.target_ok.any() and shifted.input_ok.all()
    moved = R.alignment(w.withColumn("u10", F.col("u10") + 1), raw).toPandas()
    assert moved.target_ok.all() and not moved.input_ok.any()


# ------------------------------------------------------------- files

def test_series_files_and_named_columns(spark, tmp_path):
    p = series("big_fire_2021", 30, 1)
    obs = p[["slot_utc", "slot_type", "frp_sum_mw", "sat_fraction"]].assign(n_pixels=3)
    obs.loc[4, "sat_fraction"] = np.nan
    obs.to_csv(tmp_path / "big_fire_2021_hourly.csv", index=False, na_rep="NaN")
    cov = p[["slot_utc", "tp_m", *COVARIATES]] if "tp_m" in p else p[["slot_utc", *COVARIATES]].assign(tp_m=0.1)
    cov[["slot_utc", "tp_m", *COVARIATES]].to_csv(tmp_path / "big_fire_2021_era5_hourly.csv", index=False)
    o, c = readers.read_observations(spark, str(tmp_path)), readers.read_covariates(spark, str(tmp_path))
    assert o.count() == c.count() == 30 and {r.series_id for r in o.select("series_id").distinct().collect()} == {"big_fire_2021"}
    assert o.filter("sat_fraction is null").count() == 1 and "tp_m" not in c.columns
    np.testing.assert_allclose(c.orderBy("slot_utc").toPandas().u10, p.u10)
    cov[["u10", *[c for c in reversed(COVARIATES) if c != "u10"], "slot_utc"]].to_csv(tmp_path / "odd name+1_era5_hourly.csv", index=False)
    two = readers.read_covariates(spark, str(tmp_path)).toPandas()
    assert set(two.series_id) == {"big_fire_2021", "odd name+1"} and len(two) == 60
    for _, g in two.groupby("series_id"):
        for c in COVARIATES:
            np.testing.assert_allclose(g.sort_values("slot_utc")[c], p[c])
    cov.drop(columns=["u10"]).to_csv(tmp_path / "third_era5_hourly.csv", index=False)
    with pytest.raises(ValueError, match="u10.*third"):
        readers.read_covariates(spark, str(tmp_path))
    (tmp_path / "third_era5_hourly.csv").write_text("1,2,3\n")
    with pytest.raises(ValueError, match="no header"):
        readers.read_covariates(spark, str(tmp_path))


def test_a_lost_seed_is_an_error_before_anything_is_read(spark, tmp_path):
    df = spark.createDataFrame([(s, f"e{i}", float(s + i)) for s in (0, 1, 12) for i in range(3)], "seed int, series_id string, pred double")
    writers.write_predictions(df, str(tmp_path / "p"))
    got = readers.read_predictions(spark, str(tmp_path / "p"), (0, 12))
    assert sorted((r.seed, r.series_id, r.pred) for r in got.collect()) == sorted((r.seed, r.series_id, r.pred) for r in df.filter("seed <> 1").collect())
    with pytest.raises(FileNotFoundError, match="2, 3"):
        readers.read_predictions(spark, str(tmp_path / "p"), (0, 2, 3))
    for f in (tmp_path / "p").glob("f=seed_012*/*.parquet"):
        f.write_bytes(b"no parquet")  # names alone tell that seed 5 is lost
    with pytest.raises(FileNotFoundError, match="5"):
        readers.read_predictions(spark, str(tmp_path / "p"), (12, 5))


def test_sample_store_is_pruned_and_the_test_split_sealed(spark, panel, tmp_path):
    writers.write_samples(feat.input_windows(panel, PLAIN), str(tmp_path))
    v = readers.read_split(spark, str(tmp_path), "val")
    assert v.count() == 110 - 83 and v.select(F.size("inputs")).first()[0] == 48
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*split.*val", plan)
    with pytest.raises(PermissionError):
        readers.read_split(spark, str(tmp_path), "test")
    assert readers.read_split(spark, str(tmp_path), "test", unsealed=True).count() == 100 - 83
    writers.write_metadata(spark, str(tmp_path), {"u10": (1.0, 2.0)})
    m = readers.read_metadata(spark, str(tmp_path)).first()
    assert list(m.feature_names) == list(FEATURES) and m.normalization_params["u10"].std == 2.0


def test_nested_results_with_bare_nan(spark, tmp_path):
    text = '{"seed": 3, "best_epoch": 2, "wall_s": 1.5, "history": [{"epoch": 1, "val_SS_paper": NaN, "per_event": {"a": NaN}},' \
           ' {"epoch": 2, "val_SS_paper": 0.25, "per_event": {"a": 0.25}}]}'
    (tmp_path / "run.json").write_text(text)
    h = readers.run_history(readers.read_runs(spark, str(tmp_path / "run.json"))).orderBy("epoch").collect()
    assert [r.epoch for r in h] == [1, 2] and np.isnan(h[0].val_SS_paper) and h[1].per_event == {"a": 0.25}
    (tmp_path / "norm.json").write_text(json.dumps({"frp_lag_1h": {"mean": 1.0, "std": 2.0}}))
    n = readers.read_norm_params(spark, str(tmp_path / "norm.json"))
    assert readers.value_norm(n) == (1.0, 2.0)
    with pytest.raises(KeyError):
        readers.value_norm(n, "absent")


def test_windows_leave_their_build_in_order_and_are_stored_without_a_sort(spark, panel, tmp_path):
    w = D.scaled_windows(panel, D.fit(panel, PLAIN), PLAIN)
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Sort") == 1  # that of the series' rows
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    writers.write_samples(w, str(tmp_path / "a"), in_order=True)
    writers.write_samples(w, str(tmp_path / "b"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    a, b = (readers.read_samples(spark, str(tmp_path / x)) for x in "ab")
    assert a.count() == b.count() > 20 and a.exceptAll(b).count() == 0
    for f in (tmp_path / "a").rglob("*.parquet"):
        rows = [(r.series_id, r.slot_utc) for r in spark.read.parquet(str(f)).collect()]
        assert rows == sorted(rows)


def test_build_checks_count_cells_in_one_pass(spark, panel):
    scaling = D.fit(panel, PLAIN)
    rows, w = D.scaled_rows(panel, scaling, PLAIN), D.scaled_windows(panel, scaling, PLAIN).cache()
    n = w.count()
    odd = w.withColumn("inputs", F.when(F.col("split") == "val", F.slice("inputs", 1, 47)).when(
        F.col("split") == "test", F.slice("inputs", 1, 0)).otherwise(F.transform("inputs", lambda x, i: x.withField("v10", F.when(i > 1, x["v10"]).when(i > 0, float("nan"))))))
    odd = odd.withColumn("targets", F.transform("targets", lambda y, i: F.when(i > 1, y).when(i > 0, -1.0)))
    checks = R.build_checks(odd, rows, scaling.channels, scaling.params)
    assert "aggregate(inputs" not in checks._jdf.queryExecution().executedPlan().toString()
    got = {r.check: r.detail for r in checks.collect()}
    per = {r.split: r["count"] for r in w.groupBy("split").count().collect()}
    assert got["null_inputs"] == 2 * per["train"] and got["feature_count"] == per["val"] + per["test"]
    assert got["null_targets"] >= n and got["negative_targets"] >= n


@pytest.mark.parametrize("name", ["window_inputs_scaled", "constant_feature_windows", "model_scoring"])
def test_windows_are_used_in_the_task_that_builds_them(spark, small, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "InArrow" in plan  # the hourly cells, then the series
    assert "collect_list" not in plan and "inputs" not in plan.split("FlatMapGroupsInArrow")[0]


def test_weather_files_are_neither_listed_as_observations_nor_listed_twice(spark, tmp_path, monkeypatch):
    p = series("x", 5, 1)
    obs = p[["slot_utc", "slot_type", "frp_sum_mw", "sat_fraction"]].assign(n_pixels=3)
    names = ["5", "a5", "ra5", "era5", "xera5", "x2015", "a_ra5", "x", "odd name+5"]
    for n in names:
        obs.to_csv(tmp_path / f"{n}_hourly.csv", index=False)
        p[["slot_utc", *COVARIATES]].to_csv(tmp_path / f"{n}_era5_hourly.csv", index=False)
    got = readers.read_observations(spark, str(tmp_path))
    assert not [f for f in got.inputFiles() if f.endswith("_era5_hourly.csv") and not f.endswith("/era5_hourly.csv")]
    assert {r.series_id: r["count"] for r in got.groupBy("series_id").count().collect()} == dict.fromkeys(names, 5)
    weather = readers.read_covariates(spark, str(tmp_path))
    assert "Scan csv" not in weather._jdf.queryExecution().executedPlan().toString()  # the lines that told the headers are parsed
    assert {r.series_id: r["count"] for r in weather.groupBy("series_id").count().collect()} == dict.fromkeys(names, 5)
