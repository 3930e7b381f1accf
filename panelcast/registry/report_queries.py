"""Run selection, leaderboards, bootstrap, ridge models and model scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.plans import baselines as B
from panelcast.plans import bootstrap as BS
from panelcast.plans import evaluation as ev
from panelcast.plans import reporting as L
from panelcast.plans import readiness as R
from panelcast.plans import ridge as RG
from panelcast.registry.base import query, r, rc, register_table, sql
from panelcast.registry.evaluation_queries import baseline_metrics, ridge_windows, rows_at, seed_rows, six_metrics
from panelcast.registry.feature_queries import windows
from panelcast.registry.util import rd, rounded
from panelcast.schema import AR_RIDGE_FEATURES, WEATHER_RIDGE_FEATURES
from panelcast.session import cut, stage_path
from panelcast.sources import adapter as src
from panelcast.sources import readers, writers

# Run histories: each seed is a run, each lead an epoch, the score its mean skill over validation series.
register_table("hist", "seedss", """
  SELECT CAST(seed AS INTEGER) AS seed, CAST(lead AS INTEGER) AS epoch, avg(ss) AS val_ss FROM seedss WHERE split = 'val' GROUP BY 1, 2""")


def history(spark, d):
    rows = seed_rows(spark, d).filter("split = 'val'")
    per = ev.cross_event(ev.event_skill(rows, ("seed", "lead", "series_id")), by=("seed", "lead"))
    return per.select(F.col("seed"), F.col("lead").cast("int").alias("epoch"), F.col("mean").alias("val_SS_paper"))


@query("best_epoch", "L1", sql("hist", f"""
SELECT seed, epoch AS best_epoch, {rc('val_ss', 'best_val_SS_paper')} FROM
  (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY val_ss DESC, epoch) AS rn FROM hist WHERE val_ss IS NOT NULL) WHERE rn = 1"""))
def _(spark, d):
    return L.best_epoch(history(spark, d)).select("seed", "best_epoch", *rounded("best_val_SS_paper"))


@query("stop_epoch", "L2", sql("hist", """
SELECT seed, coalesce(min(epoch) FILTER (epoch >= 2 AND epoch - last_best >= 2), max(epoch)) AS stopped_at FROM (
  SELECT seed, epoch, coalesce(max(CASE WHEN better THEN epoch END) OVER (PARTITION BY seed ORDER BY epoch), 0) AS last_best FROM (
    SELECT *, val_ss > coalesce(max(val_ss) OVER (PARTITION BY seed ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) AS better
    FROM hist)) GROUP BY 1"""))
def _(spark, d):
    return L.stop_epoch(history(spark, d), patience=2)


@query("run_files", "IO11", sql("hist", f"SELECT seed, epoch, {rc('val_ss', 'val_SS_paper')} FROM hist"))
def _(spark, d):
    path = stage_path(spark)
    runs = history(spark, d).groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("epoch", "val_SS_paper"))).alias("history"))
    writers.write_report(runs, path)
    return readers.run_history(readers.read_runs(spark, path, one_per_file=False)).select("seed", "epoch", *rounded("val_SS_paper"))


@query("result_files", "IO12", sql("ss6", f"SELECT series_id, split, n_fire, {rc('mae_model', 'mae_model')}, {rc('ss', 'ss')} FROM ss6"))
def _(spark, d):
    path = stage_path(spark)
    s = ev.event_skill(rows_at(spark, d), ("series_id", "split"))
    writers.write_table(s, path)
    t = spark.read.schema(s.schema).option("header", True).csv(path)
    return t.select("series_id", "split", "n_fire", *rounded("mae_model", "ss"))


_paper = ", ".join(f"{rc(f'max(m) FILTER (lead = {k})', f'MAE_fire_t{k}_mean')}, {rc(f'max(s) FILTER (lead = {k})', f'MAE_fire_t{k}_std')}" for k in (1, 3, 6, 12))


@query("paper_table", "L3", sql("bm bss", f"""
SELECT t.*, {rc('ss_mean', 'ss_mean')}, {rc('ss_std', 'ss_std')}, {rc('ss_excl', 'ss_excl')} FROM (SELECT baseline, {_paper} FROM
  (SELECT baseline, lead, avg(mae_fire) AS m, stddev_samp(mae_fire) AS s FROM bm GROUP BY 1, 2) GROUP BY 1) t JOIN bss ON bss.baseline = t.baseline"""))
def _(spark, d):
    m = cut(baseline_metrics(spark, d))
    t = L.paper_table(ev.cross_event_by_lead(m, ("baseline", "lead")), ev.baseline_skill(m, exclude=[11]))
    return t.select("baseline", *rounded(*[c for c in t.columns if c != "baseline"]))


@query("best_baseline", "L5", sql("bm", f"""
SELECT baseline, lead, {rc('max(mae_fire) FILTER (series_id = 11)', 'series_mae')}, {rc('avg(mae_fire) FILTER (series_id <> 11)', 'others_mae')}
FROM bm WHERE baseline = (SELECT baseline FROM bm WHERE lead = 6 GROUP BY 1 ORDER BY avg(mae_fire), baseline LIMIT 1) GROUP BY 1, 2"""))
def _(spark, d):
    m = cut(baseline_metrics(spark, d))
    b = L.best_baseline(ev.cross_event_by_lead(m, ("baseline", "lead")), m, 11)
    return b.select("baseline", F.col("lead").cast("long").alias("lead"), *rounded("series_mae", "others_mae"))


@query("baseline_sanity", "C9", sql("bm bl", f"""
SELECT b AS lowest_at_t1, b = 'persistence' AS persistence_lowest,
  {rc("(SELECT avg(y) FROM bl WHERE split = 'val' AND fire_active)", 'mean_fire_value')},
  (SELECT count(DISTINCT (series_id, slot_utc)) FROM bl WHERE split = 'val') AS n_all,
  (SELECT count(DISTINCT (series_id, slot_utc)) FROM bl WHERE split = 'val' AND fire_active) AS n_fire FROM
  (SELECT baseline AS b FROM bm WHERE lead = 1 GROUP BY 1 ORDER BY avg(mae_fire), baseline LIMIT 1)"""))
def _(spark, d):
    w = ridge_windows(spark, d)
    s = R.baseline_sanity(ev.cross_event_by_lead(six_metrics(w), ("baseline", "lead")), w.filter("split = 'val'"))
    return s.select("lowest_at_t1", "persistence_lowest", *rounded("mean_fire_value"), "n_all", "n_fire")


@query("baseline_sanity_by_series", "C9", sql("anc", """
SELECT series_id, count(*) AS n_all, count(*) FILTER (fire_active) AS n_fire FROM anc WHERE split = 'val' GROUP BY 1"""))
def _(spark, d):
    return R.sanity_by_series(windows(spark, d).filter("split = 'val'"))


# Configurations: the stand-in seeds damped to 100, 75 and 50 percent.
register_table("cfg", "seedp", """
  SELECT s.* EXCLUDE (pred), c.config, s.pred * c.f AS pred FROM seedp s,
    (VALUES ('full', CAST(1 AS DOUBLE)), ('damped_75', 0.75), ('damped_50', 0.5)) c(config, f) WHERE s.split = 'val' AND s.lead = 6""")
register_table("lb", "cfg", """
  SELECT e.config, e.ens, e.excl, s.m, s.s, s.n FROM (
    SELECT config, avg(ss) AS ens, avg(ss) FILTER (series_id <> 11) AS excl FROM (
      SELECT config, series_id, 1 - avg(abs(pred - y)) / nullif(avg(abs(pers - y)), 0) AS ss FROM (
        SELECT config, series_id, slot_utc, any_value(y) AS y, any_value(pers) AS pers, greatest(exp(avg(ln(1 + pred))) - 1, 0) AS pred
        FROM cfg WHERE fire_active GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1) e
  JOIN (SELECT config, avg(v) AS m, stddev_samp(v) AS s, count(v) AS n FROM (
    SELECT config, seed, avg(ss) AS v FROM (
      SELECT config, seed, series_id, 1 - avg(abs(pred - y)) / nullif(avg(abs(pers - y)), 0) AS ss FROM cfg WHERE fire_active GROUP BY 1, 2, 3)
    GROUP BY 1, 2) GROUP BY 1) s ON s.config = e.config""")


@query("leaderboard", "L4 J9", sql("lb", f"""
SELECT config, {rc('ens', 'ensemble_val_SS')}, {rc('excl', 'ensemble_val_SS_excl')}, {rc('m', 'cross_seed_mean')}, {rc('s', 'cross_seed_std')}, n AS n_seeds,
  {rc("ens - (SELECT ens FROM lb WHERE config = 'full')", 'delta')} FROM lb"""))
def _(spark, d):
    rows = seed_rows(spark, d, 6).filter("split = 'val'")
    configs = F.explode(F.array(*[F.struct(F.lit(n).alias("config"), F.lit(f).alias("f"))
                                  for n, f in (("full", 1.0), ("damped_75", 0.75), ("damped_50", 0.5))]))
    rows = rows.withColumn("_c", configs).withColumns({"config": F.col("_c.config"), "pred": F.col("pred") * F.col("_c.f")}).drop("_c")
    b = L.leaderboard(rows, "full", exclude=[11])
    return b.select("config", *rounded("ensemble_val_SS", "ensemble_val_SS_excl", "cross_seed_mean", "cross_seed_std"), "n_seeds", *rounded("delta"))


@query("delta_to_reference", "J9", sql("bss", f"""
SELECT baseline, {rc('ss_mean', 'ss_mean')}, {rc("ss_mean - (SELECT ss_mean FROM bss WHERE baseline = 'linear_trend')", 'delta')} FROM bss"""))
def _(spark, d):
    s = ev.baseline_skill(baseline_metrics(spark, d), exclude=[11])
    return L.deltas(s, "baseline", "linear_trend", "ss_mean", "delta").select("baseline", *rounded("ss_mean", "delta"))


def _version_sql(split, extra=""):
    from panelcast.registry.base import TABLES

    bm = TABLES["bm4"][1].replace("split = 'val'", f"split = '{split}'")
    register_table(f"bm_{split}", "bl", bm)
    register_table(f"v_{split}", f"bm_{split}", f"""
      SELECT b.baseline, CASE WHEN b.baseline = 'persistence' THEN 0 ELSE avg(1 - b.mae_fire / nullif(p.mae_fire, 0)) END AS ss
      FROM bm_{split} b JOIN bm_{split} p ON p.series_id = b.series_id AND p.lead = 6 AND p.baseline = 'persistence'
      WHERE b.lead = 6 {extra} GROUP BY 1""")


_version_sql("test", "AND b.baseline <> 'linear_trend'")
_version_sql("val")
_version_sql("train")


@query("version_comparison", "J11", sql("v_test v_val v_train", f"""
SELECT coalesce(a.baseline, b.baseline, c.baseline) AS baseline, {rc('a.ss', 'v1')}, {rc('b.ss', 'v2')}, {rc('c.ss', 'v3')}, {rc('c.ss - b.ss', 'delta')}
FROM v_test a FULL JOIN v_val b ON a.baseline = b.baseline FULL JOIN v_train c ON c.baseline = coalesce(a.baseline, b.baseline)"""))
def _(spark, d):
    rows = cut(B.by_baseline(B.forecast_rows(cut(windows(spark, d))).filter("lead = 6")))
    m = {s: ev.baseline_skill(ev.lead_metrics(rows.filter(F.col("split") == s), ("baseline", "series_id", "lead")))
         for s in ("test", "val", "train")}
    t = L.compare_versions(m["test"].filter("baseline <> 'linear_trend'"), m["val"], m["train"])
    return t.select("baseline", *rounded("v1", "v2", "v3", "delta"))


# ----------------------------------------------------------------- bootstrap

register_table("bval", "ss6", """
  SELECT value, row_number() OVER (ORDER BY md5(wind)) - 1 AS idx, count(*) OVER () AS n FROM (
    SELECT substr('ABCD', CAST(series_id % 4 AS INT) + 1, 1) AS wind, avg(ss) AS value FROM ss6 WHERE ss IS NOT NULL GROUP BY 1)""")


@query("bootstrap_interval", "U5", sql("ss6", f"""
SELECT {rc('quantile_cont(m, 0.025)', 'ci_lo')}, {rc('quantile_cont(m, 0.975)', 'ci_hi')},
  quantile_cont(m, 0.025) > 0 OR quantile_cont(m, 0.975) < 0 AS ci_excludes_zero FROM (
  SELECT b, avg(value) AS m FROM (SELECT b, i, CAST('0x' || substr(md5('42:' || CAST(b AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 15) AS BIGINT) % n AS idx
    FROM (SELECT unnest(range(0, 10000)) AS b), (SELECT unnest(range(0, n)) AS i, n FROM (SELECT count(*) AS n FROM ss6 WHERE ss IS NOT NULL))) x
  JOIN (SELECT ss AS value, row_number() OVER (ORDER BY md5(CAST(series_id AS VARCHAR))) - 1 AS idx FROM ss6 WHERE ss IS NOT NULL) v ON v.idx = x.idx GROUP BY 1)"""))
def _(spark, d):
    s = ev.event_skill(rows_at(spark, d), ("series_id",))
    b = BS.bootstrap(s)
    return b.select(*rounded("ci_lo", "ci_hi"), "ci_excludes_zero")


@query("exact_bootstrap_interval", "U5", sql("bval", f"""
SELECT {rc('quantile_cont(m, 0.025)', 'ci_lo')}, {rc('quantile_cont(m, 0.975)', 'ci_hi')},
  quantile_cont(m, 0.025) > 0 OR quantile_cont(m, 0.975) < 0 AS ci_excludes_zero FROM (
  SELECT b, avg(value) AS m FROM (
    SELECT b, i, (b // CAST(pow(n, i) AS BIGINT)) % n AS idx FROM (SELECT DISTINCT n FROM bval) c,
      (SELECT unnest(range(0, (SELECT CAST(pow(max(n), max(n)) AS BIGINT) FROM bval))) AS b), (SELECT idx AS i FROM bval)) x
  JOIN bval v ON v.idx = x.idx GROUP BY 1)"""))
def _(spark, d):
    """The mean skill per wind regime: four values at any scale, so every resample is taken."""
    s = ev.event_skill(rows_at(spark, d), ("series_id",)).join(src.catalogue(spark, d).select("series_id", "wind_regime"), "series_id")
    b = BS.bootstrap(s.groupBy(F.col("wind_regime").alias("series_id")).agg(F.avg("ss").alias("ss")), method="exact")
    return b.select(*rounded("ci_lo", "ci_hi"), "ci_excludes_zero")


# ----------------------------------------------------------------- ridge

_gx = {}
for _kind, _fs in (("lag", AR_RIDGE_FEATURES), ("weather", WEATHER_RIDGE_FEATURES)):
    xs, ys = ["one", *_fs], [f"y{k}" for k in range(1, 13)]
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]] + [(a, y) for y in ys for a in xs] + [(y, y) for y in ys]
    register_table(f"{_kind}x", "man zfeat anc", f"""
      SELECT m.fold, CAST(1 AS DOUBLE) AS one, {', '.join('z.' + f for f in _fs)}, {', '.join(f'a.targets[{k}] AS y{k}' for k in range(1, 13))}
      FROM (SELECT series_id, slot_utc, CASE WHEN sample_idx < (n % 5) * (n // 5 + 1) THEN sample_idx // (n // 5 + 1)
              ELSE n % 5 + (sample_idx - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold
            FROM man, (SELECT count(*) AS n FROM man WHERE split = 'train') WHERE split = 'train') m
      JOIN zfeat z ON z.series_id = m.series_id AND z.slot_utc = m.slot_utc JOIN anc a ON a.series_id = m.series_id AND a.slot_utc = m.slot_utc""")
    _gx[_kind] = (pairs, _fs)


def _gram_query(name, covers, kind):
    pairs, fs = _gx[kind]
    body = ("SELECT fold, p.a, p.b, " + rc("p.v", "value", 3) + " FROM (SELECT CAST(fold AS INTEGER) AS fold, unnest(["
            + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'v': sum({a} * {b})}}" for a, b in pairs) + f"]) AS p FROM {kind}x GROUP BY 1)")

    @query(name, covers, sql(f"{kind}x", body))
    def run(spark, d):
        g = RG.gram(RG.training_rows(ridge_windows(spark, d)), fs, RG.raw_targets())
        return g.select("fold", "a", "b", *rounded("value", digits=3))


_gram_query("lag_gram", "B6", "lag")
_gram_query("weather_gram", "B7", "weather")


def _ridge_skill(w, preds):
    rows = RG.long_predictions(preds.filter("split <> 'train'"), "series_id", "split", "fire_active", "prior").withColumnRenamed("prior", "persistence")
    s = ev.event_skill(rows, ("split", "lead", "series_id"))
    return s.select("split", F.col("lead").cast("long").alias("lead"), "series_id", "n_fire", *rounded("mae_model", "mae_pers", "ss"))


def _skill_sql(table):
    return f"""
SELECT split, lead, series_id, n_fire, {rc('m', 'mae_model')}, {rc('p', 'mae_pers')}, {rc('1 - m / nullif(p, 0)', 'ss')} FROM (
  SELECT split, lead, series_id, count(*) FILTER (fire_active) AS n_fire, avg(abs(pred - y)) FILTER (fire_active) AS m,
    avg(abs(pers - y)) FILTER (fire_active) AS p FROM {table} WHERE split <> 'train' GROUP BY 1, 2, 3)"""


@query("lag_ridge", "B6", sql("lagp", _skill_sql("lagp")))
def _(spark, d):
    w = ridge_windows(spark, d)
    return _ridge_skill(w, RG.predict(w, RG.fit(w, AR_RIDGE_FEATURES)))


@query("weather_ridge", "B7", sql("weatherp", _skill_sql("weatherp")))
def _(spark, d):
    w = ridge_windows(spark, d)
    return _ridge_skill(w, RG.predict(w, RG.fit(w, WEATHER_RIDGE_FEATURES)))


@query("residual_ridge", "B8 P11", sql("residualp", _skill_sql("residualp")))
def _(spark, d):
    w = ridge_windows(spark, d)
    m = RG.fit(w, AR_RIDGE_FEATURES, RG.residual_targets())
    return _ridge_skill(w, RG.predict_residual(w, m))


def _coefficient_query(name, covers, kind, features, targets):
    body = f"""SELECT CAST(lead AS INTEGER) AS lead, {rc('alpha', 'alpha')}, unnest(['one', {', '.join(repr(f) for f in features)}]) AS feature,
      unnest(list_prepend({r('b')}, list_transform(w, lambda x: {r('x')}))) AS value FROM {kind}best"""

    @query(name, covers, sql(f"{kind}best", body))
    def run(spark, d):
        m = RG.fit(ridge_windows(spark, d), features, targets())
        rows = [(k + 1, m.alphas[k], f, v) for k in range(len(m.alphas)) for f, v in zip(("one", *features), (m.intercepts[k], *m.weights[k]))]
        return spark.createDataFrame(rows, "lead int, alpha double, feature string, value double").select("lead", *rounded("alpha"), "feature", *rounded("value"))


_coefficient_query("lag_ridge_coefficients", "B6", "lag", AR_RIDGE_FEATURES, RG.raw_targets)
_coefficient_query("weather_ridge_coefficients", "B7", "weather", WEATHER_RIDGE_FEATURES, RG.raw_targets)


@query("six_baselines", "A7 C9 L3", sql("bss", f"""
SELECT baseline, {rc('ss_mean', 'ss_mean')}, {rc('ss_std', 'ss_std')}, {rc('ss_excl', 'ss_excl')},
  (SELECT ss_mean FROM bss WHERE baseline = 'weather_ridge') < (SELECT ss_mean FROM bss WHERE baseline = 'ar_ridge') AS lags_beat_weather FROM bss"""))
def _(spark, d):
    """Skill of all six baselines on validation against gated persistence, and the lag-versus-weather check."""
    s = ev.baseline_skill(cut(baseline_metrics(spark, d)), exclude=[11])
    return L.lags_beat_weather(s).select("baseline", *rounded("ss_mean", "ss_std", "ss_excl"), "lags_beat_weather")
