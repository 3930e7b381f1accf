"""Cases that once gave a wrong or no answer: ties, too few seeds, empty groups, lost inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelcast.plans import bootstrap, ensembles, normalise, quality
from panelcast.sources import readers


def test_audit_ties_go_to_the_even_digit(spark):
    r = spark.sql("SELECT 1 / 32D AS a, 0.25D AS b, 0.35D AS c, CAST(NULL AS DOUBLE) AS n").select(
        quality.half_even(F.col("a"), 4), quality.half_even(F.col("b"), 1), quality.half_even(F.col("c"), 1), quality.half_even(F.col("n"), 1)).first()
    assert tuple(r) == (0.0312, 0.2, 0.4, None)


def test_trimmed_mean_of_two_seeds_is_null(spark):
    p = spark.createDataFrame([(s, 1.0 * s) for s in range(2)], "seed int, pred double").withColumns({k: F.lit(1) for k in ensembles.KEYS})
    assert ensembles.trimmed_log_mean(p).first()["pred"] is None


def test_statistics_of_a_group_without_windows_are_null(spark):
    df = spark.createDataFrame([("train", 2.0, 1), ("train", 4.0, 1), ("val", 3.0, 0)], "split string, x double, window_weight int")
    got = {r["split"]: (r["m"], r["s"]) for r in df.groupBy("split").agg(
        *[c.alias(n) for c, n in zip(normalise.weighted_moments(df, ["split"], F.col("x"), F.col("window_weight")), "ms")]).collect()}
    assert got == {"train": (3.0, 1.0), "val": (None, None)}


def test_bootstrap_method_is_the_callers(spark):
    values = spark.createDataFrame([(0, 1.0), (1, 4.0)], "idx long, value double")
    exact = sorted(r.m for r in bootstrap.resample_means(values, 2, method="exact").collect())
    assert exact == [1.0, 2.5, 2.5, 4.0]
    assert bootstrap.resample_means(values, 2, n_boot=37).count() == 37
    with pytest.raises(ValueError):
        bootstrap.resample_means(values, 2, method="auto")


def test_names_in_paths_are_decoded(spark, tmp_path):
    (tmp_path / "b x+y_hourly.csv").write_text("slot_utc,slot_type,frp_sum_mw,sat_fraction,n_pixels\n2024-01-01 00:00:00,fire,1.0,0.5,2\n")
    assert [r.series_id for r in readers.read_observations(spark, str(tmp_path)).collect()] == ["b x+y"]
