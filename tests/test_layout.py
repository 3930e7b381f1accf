import numpy as np
import pandas as pd
import pytest
from helpers import frame, series
from pyspark.sql import functions as F

from panelcast.operators import features as feat
from panelcast.operators import layout as lay
from panelcast.plans import normalise as N
from panelcast.plans import readiness as R

BLOCKED = lay.Layout(blocked=True, block_rows=97, chunk_days=2)
PLAIN = lay.Layout()


@pytest.fixture(scope="module")
def panel(spark):
    parts = [series("hot", 900, 1), series("b", 130, 2, "val"), series("c", 40, 3, "test"), series("one", 1, 4),
             series("sparse", 120, 5, gap=0.9)]
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[(pdf.series_id == "hot") & (pdf.index % 211 == 7), "u10"] = np.nan
    df = frame(spark, pdf)
    return df.withColumn("u10", F.when(~F.isnan("u10"), F.col("u10"))).cache()


def same(a, b, keys):
    cols = sorted(c for c in a.columns if c in b.columns)
    x = a.select(cols).toPandas().sort_values(keys).reset_index(drop=True)
    y = b.select(cols).toPandas().sort_values(keys).reset_index(drop=True)
    assert len(x) == len(y)
    for c in cols:
        if x[c].dtype == float:
            np.testing.assert_allclose(x[c], y[c], rtol=1e-9, atol=1e-9, err_msg=c)
        elif c == "targets":
            for p, q in zip(x[c], y[c]):
                np.testing.assert_allclose(np.array(p, float), np.array(q, float))
        else:
            assert x[c].astype(str).equals(y[c].astype(str)), c


def test_blocks_give_the_same_rows_as_whole_series(panel):
    for wind in (False, True):
        same(feat.build_rows(panel, PLAIN, wind=wind), feat.build_rows(panel, BLOCKED, wind=wind), ["series_id", "slot_utc"])


def test_running_sums_are_equal_to_the_last_bit(panel):
    whole = feat.feature_rows(panel, PLAIN).select("series_id", "slot_utc", "cumulative_frp").toPandas().sort_values(["series_id", "slot_utc"])
    for rows, days in ((97, 2), (140, 5)):
        part = feat.feature_rows(panel, lay.Layout(blocked=True, block_rows=rows, chunk_days=days)).toPandas().sort_values(["series_id", "slot_utc"])
        assert whole.cumulative_frp.tolist() == part.cumulative_frp.tolist()


def test_value_ranges_stay_within_their_share(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"v": rng.lognormal(0, 3, 40_000)})).cache()
    for share in (100_000, 700, 90):
        sizes = lay.value_range(df, "v", lay.splitters(df, "v", share=share), "r").groupBy("r").count().toPandas()["count"]
        assert sizes.max() <= 1.1 * max(min(share, 40_000 / 8), 1) + 1 and len(sizes) >= 8


def test_blocks_give_the_same_window_weights(panel):
    same(feat.weighted_rows(panel, PLAIN), feat.weighted_rows(panel, BLOCKED), ["series_id", "slot_utc"])


def test_blocks_give_the_same_summaries_and_wind_statistics(panel):
    some = ("log_frp", "u10", "cumulative_frp")
    same(feat.window_summary(panel, PLAIN, some), feat.window_summary(panel, BLOCKED, some), ["series_id", "slot_utc", "feature"])
    same(N.wind_statistics(panel, PLAIN), N.wind_statistics(panel, BLOCKED), ["feature"])


def test_blocks_give_the_same_gaps(panel):
    obs = panel.withColumn("slot_type", F.when(F.hash("series_id", "slot_utc") % 3 == 0, "missing").otherwise(F.col("slot_type")))
    same(feat.gap_runs(obs, PLAIN), feat.gap_runs(obs, BLOCKED), ["series_id", "gap_start"])
    w = feat.anchors(panel, PLAIN)
    same(R.start_gaps(w, PLAIN), R.start_gaps(w, BLOCKED), ["series_id", "gap_no"])


def test_no_task_sees_a_whole_series(panel):
    pw = feat.open_panel(panel, lay.Layout(blocked=True, block_rows=120, chunk_days=2))
    biggest = pw.df.groupBy("series_id", "_block").count().agg(F.max("count")).first()[0]
    assert biggest <= 120 + feat.ROWS_BACK + feat.ROWS_AHEAD


def test_layout_is_picked_from_the_time_span(panel):
    assert not lay.Layout.detect(panel).blocked
    assert lay.Layout.detect(panel, limit=100).blocked


def test_dense_number(spark):
    rows = [(k, t) for k, n in (("a", 500), ("b", 3), ("c", 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t long")
    got = lay.dense_number(df, ["k"], F.floor(F.col("t") / 37), ["t"], "no").toPandas()
    assert (got.no == got.t + 1).all()
    everyone = lay.dense_number(df, [], F.col("k"), ["t"], "no", 0).toPandas().no
    assert sorted(everyone) == list(range(504))


@pytest.mark.parametrize("parts", [4, 64])
def test_exact_quantiles_with_ties_and_a_hot_key(spark, parts):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({
        "k": ["hot"] * 4000 + ["ties"] * 500 + ["pair"] * 2 + ["one"],
        "v": np.concatenate([rng.lognormal(0, 2, 4000), np.repeat([0.0, 1.0], 250), [1.0, 4.0], [7.0]]),
    })
    df = spark.createDataFrame(pdf)
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99, "p0": 0.0, "p100": 1.0}
    got = lay.exact_quantiles(df, ["k"], "v", probs, parts).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for c, p in probs.items():
            assert got.loc[k, c] == pytest.approx(np.quantile(g.v, p), rel=1e-12), (k, c)
    whole = lay.exact_quantiles(df, [], "v", {"m": 0.5}, parts).first().m
    assert whole == pytest.approx(np.median(pdf.v))
