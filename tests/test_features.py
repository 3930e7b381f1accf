import numpy as np
import pandas as pd
import pytest
from helpers import frame, series
from pyspark.sql import functions as F

from panelcast.functions import columns as C
from panelcast.operators import assemble as A
from panelcast.operators import features as feat
from panelcast.operators.layout import Layout
from panelcast.plans import manifest as M
from panelcast.plans import normalise as N
from panelcast.schema import FEATURES, LAGS

PLAIN = Layout()


def brute_features(g):
    """Row features of one series, value by value."""
    v = g.frp_sum_mw.to_numpy()
    out = pd.DataFrame({"slot_utc": g.slot_utc.to_numpy()})
    for k in LAGS:
        out[f"frp_lag_{k}h"] = [v[i - k] if i >= k else np.nan for i in range(len(v))]
    out["frp_rolling_6h_mean"] = [v[max(0, i - 5):i + 1].mean() for i in range(len(v))]
    out["frp_rolling_6h_std"] = [np.std(v[max(0, i - 5):i + 1], ddof=1) if i else np.nan for i in range(len(v))]
    out["frp_trend_6h"] = [np.polyfit(range(6), v[i - 5:i + 1], 1)[0] if i >= 5 else np.nan for i in range(len(v))]
    out["cumulative_frp"] = np.cumsum(v)
    fires = g.slot_utc[g.slot_type == "fire"]
    hours = (g.slot_utc - fires.min()).dt.total_seconds().clip(lower=0) / 3600 if len(fires) else 0.0
    out["hours_since_first_fire"] = np.asarray(hours, float) if len(fires) else 0.0
    return out


def test_features_equal_a_row_by_row_loop(spark):
    parts = [series("a", 200, 1), series("quiet", 90, 2, fire=0.0), series("one", 1, 3), series("late", 60, 4, fire=0.05)]
    got = feat.feature_rows(frame(spark, pd.concat(parts)), PLAIN).toPandas()
    for p in parts:
        want = brute_features(p)
        g = got[got.series_id == p.series_id.iloc[0]].sort_values("slot_utc").reset_index(drop=True)
        for c in want.columns[1:]:
            np.testing.assert_allclose(g[c].astype(float), want[c], rtol=1e-9, atol=1e-9, err_msg=c)


def test_lags_count_rows_across_gaps(spark):
    p = series("g", 30, 1, gap=0.7)
    got = feat.feature_rows(frame(spark, p), PLAIN).orderBy("slot_utc").toPandas()
    assert got.frp_lag_1h.iloc[1:].tolist() == p.frp_sum_mw.iloc[:-1].tolist()


@pytest.mark.parametrize("n,windows", [(83, 0), (84, 1), (100, 17), (59, 0)])
def test_first_window_waits_for_the_longest_lag(spark, n, windows):
    assert feat.anchors(frame(spark, series("s", n, n)), PLAIN).count() == windows


def test_a_null_covariate_kills_the_windows_that_contain_it(spark):
    p = series("s", 200, 1)
    df = frame(spark, p).withColumn("v10", F.when(F.col("slot_utc") != F.lit(p.slot_utc.iloc[110]), F.col("v10")))
    rows = set(feat.anchors(df, PLAIN).toPandas().row_no)
    assert rows == {i for i in range(72, 189) if not 111 <= i <= 158}


def test_calendar_uses_365_days_on_leap_days(spark):
    df = spark.sql("select timestamp_ntz'2024-12-31 06:30:00' as slot_utc")
    r = df.select(*[c.alias(n) for n, c in C.calendar().items()]).first()
    assert r.doy_sin == pytest.approx(np.sin(2 * np.pi * 366 / 365))
    assert r.hour_cos == pytest.approx(np.cos(2 * np.pi * 6.5 / 24))


def test_wind_features_at_the_anchor_and_clipped_statistics(spark):
    p = pd.concat([series("a", 110, 1), series("b", 95, 2), series("v", 100, 3, "val")])
    df = frame(spark, p)
    cells = []
    for name in ("a", "b"):
        g = feat.feature_rows(df, PLAIN).filter(F.col("series_id") == name).orderBy("slot_utc").toPandas()
        for t in range(71, len(g) - 12):
            w = g.iloc[t - 47:t + 1]
            for j in range(48):
                s = w.iloc[max(0, j - 11):j + 1]
                cells.append((w.wind_speed_850.iloc[j] - w.wind_speed_10m.iloc[j],
                              np.std(s.u10) + np.std(s.v10), s.wind_speed_850.max(),
                              w.vpd_kPa.iloc[j] * w.wind_speed_10m.iloc[j],
                              w.wind_speed_850.iloc[j] * max(w.frp_lag_1h.iloc[j], 0)))
    cells = np.array(cells)
    got = N.wind_statistics(df, PLAIN).toPandas().set_index("feature")
    for i, f in enumerate(("shear_signed", "wind_var_12h", "ws850_max_12h", "hdw_product", "wind_frp_coupling")):
        assert got.loc[f, "mean"] == pytest.approx(cells[:, i].mean(), rel=1e-9)
        assert got.loc[f, "std"] == pytest.approx(cells[:, i].std(), rel=1e-7)


def test_constant_features_are_left_out_of_scaling(spark):
    df = frame(spark, pd.concat([series("a", 120, 1), series("v", 120, 2, "val")])).withColumn("blh_m", F.lit(5.0))
    rows = feat.feature_rows(df, PLAIN)
    params = N.norm_params(N.norm_table(rows))
    assert "blh_m" not in params and "blh_m" not in N.kept_features(params)
    z = N.apply_norm(rows, params).filter("split = 'train'").agg(F.avg("u10"), F.stddev_pop("u10")).first()
    assert z[0] == pytest.approx(0, abs=1e-12) and z[1] == pytest.approx(1)


def test_sample_index_is_dense_in_split_series_time_order(spark):
    p = pd.concat([series(i, 100 + 9 * i, i, s) for i, s in enumerate(("val", "train", "test", "train"))])
    m = M.manifest(feat.anchors(frame(spark, p), PLAIN)).toPandas().sort_values("sample_idx")
    assert m.sample_idx.tolist() == list(range(len(m)))
    want = m.assign(s=m.split.map({"train": 0, "val": 1, "test": 2})).sort_values(["s", "series_id", "target_end_utc"])
    assert want.sample_idx.tolist() == list(range(len(m)))


def test_assembly_drops_gaps_and_rows_without_covariates(spark):
    p = series("a", 10, 1)
    obs = frame(spark, p[["series_id", "slot_utc", "slot_type", "frp_sum_mw", "sat_fraction"]])
    obs = obs.withColumn("slot_type", F.when(F.col("slot_utc") == F.lit(p.slot_utc[3]), "missing").otherwise(F.col("slot_type")))
    cov = frame(spark, p.drop(columns=["slot_type", "frp_sum_mw", "sat_fraction", "split"]).drop(index=[6]))
    cat = spark.createDataFrame([("a", "train"), ("ghost", "val")], "series_id string, split string")
    assert A.assemble(obs, cov, cat).count() == 8
    assert [r.series_id for r in A.series_without_data(cat, obs).collect()] == ["ghost"]
    with pytest.raises(ValueError, match="ghost"):
        A.check_complete(cat, obs, cov)
    with pytest.raises(ValueError, match="missing columns"):
        A.assemble(obs, cov.drop("u10"), cat)


def test_gap_runs_with_leading_and_trailing_gaps(spark):
    kinds = ["missing", "missing", "fire", "missing", "no_fire", "no_fire", "missing", "missing"]
    p = pd.DataFrame({"series_id": "s", "slot_type": kinds, "slot_utc": pd.date_range("2024-01-01", periods=8, freq="h")})
    got = feat.gap_runs(frame(spark, p), PLAIN).orderBy("gap_start").collect()
    assert [(r.gap_start.hour, r.gap_end.hour, r.n_slots) for r in got] == [(0, 2, 2), (3, 4, 1), (6, 7, 2)]
    assert all(c in FEATURES for c in ("u10", "log_frp"))
