"""Normalisation, manifest, sources and sinks, sampling, quality and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import assemble as A
from panelcast.operators import features as feat
from panelcast.plans import dataset as D
from panelcast.plans import manifest as M
from panelcast.plans import normalise as N
from panelcast.plans import quality as Q
from panelcast.plans import readiness as R
from panelcast.plans import sampling as S
from panelcast.registry.base import query, r, rc, register_table, sql
from panelcast.registry.feature_queries import windows
from panelcast.registry.util import rd, rounded
from panelcast.schema import COVARIATES, FEATURES, SCALED, WIND_FEATURES
from panelcast.session import cut, stage_path
from panelcast.sources import adapter as src
from panelcast.sources import readers, writers


def stored_rows(spark, d, *columns):
    """Feature and window rows written once: statistics, scaling and windows all read them."""
    lay = src.layout(spark, d)
    rows = feat.build_rows(src.panel(spark, d, lay), lay)
    return cut(rows.select(*columns) if columns else rows)


def weighted(spark, d, normalised=True):
    lay = src.layout(spark, d)
    rows = cut(feat.weighted_rows(src.panel(spark, d, lay), lay).select(
        "series_id", "split", "slot_utc", "window_weight", *FEATURES))
    return N.apply_norm(rows, N.norm_params(N.norm_table(rows))) if normalised else rows


def scaled(spark, d):
    """Scaled rows with window columns, written once, and what they were scaled by."""
    lay = src.layout(spark, d)
    panel = src.panel(spark, d, lay)
    scaling = D.fit(panel, lay, wind=False)
    return cut(D.scaled_rows(panel, scaling, lay).drop("n_pixels", *[f"raw_{f}" for f in scaling.params])), scaling, lay


def stored_windows(spark, d):
    return cut(windows(spark, d))


# ----------------------------------------------------------------- normalisation

@query("norm_parameters", "N1 IO8", sql("norm", f"SELECT feature, {rc('mean', 'mean')}, {rc('std', 'std')} FROM norm"))
def _(spark, d):
    lay = src.layout(spark, d)
    t = N.norm_table(feat.feature_rows(src.panel(spark, d, lay), lay))
    return t.select("feature", *rounded("mean", "std"))


@query("zscored_features", "P6 N1", sql("zfeat", f"SELECT series_id, slot_utc, {', '.join(rc(f, f) for f in FEATURES)} FROM zfeat"))
def _(spark, d):
    rows = stored_rows(spark, d, "series_id", "split", "slot_utc", *FEATURES)
    return N.apply_norm(rows, N.norm_params(N.norm_table(rows))).select("series_id", "slot_utc", *rounded(*FEATURES))


@query("unscaled_prior", "P7 IO8", sql("anc", f"SELECT series_id, slot_utc, {rc('pers', 'persistence')} FROM anc"))
def _(spark, d):
    from panelcast.functions.columns import floor0, unscale

    rows = stored_rows(spark, d, "series_id", "split", "slot_utc", "is_anchor", "frp_lag_1h")
    w = rows.filter("is_anchor")
    params = N.norm_table(rows, ["frp_lag_1h"])
    mean, std = readers.value_norm(params)
    z = N.apply_norm(w, {"frp_lag_1h": (mean, std)})
    return z.select("series_id", "slot_utc", rd(floor0(unscale(F.col("frp_lag_1h"), mean, std))).alias("persistence"))


register_table("wcell", "feat anc", """
  SELECT f.*, a.slot_utc AS anchor_utc, a.split AS asplit, f.row_no - a.row_no + 47 AS step
  FROM anc a JOIN feat f ON f.series_id = a.series_id AND f.row_no BETWEEN a.row_no - 47 AND a.row_no""")
register_table("wwind", "wcell", """
  SELECT shear_signed, hdw_product, wind_frp_coupling,
    stddev_pop(u10) OVER w + stddev_pop(v10) OVER w AS wind_var_12h, max(wind_speed_850) OVER w AS ws850_max_12h
  FROM wcell WHERE asplit = 'train'
  WINDOW w AS (PARTITION BY series_id, anchor_utc ORDER BY step ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")


@query("wind_statistics", "N2", sql("wwind", "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, {rc(f'avg({f})', 'mean')}, {rc(f'CASE WHEN stddev_pop({f}) < 1e-6 THEN 1 ELSE stddev_pop({f}) END', 'std')} FROM wwind"
    for f in WIND_FEATURES)))
def _(spark, d):
    lay = src.layout(spark, d)
    return N.wind_statistics(src.panel(spark, d, lay), lay).select("feature", *rounded("mean", "std"))


# ----------------------------------------------------------------- manifest and store

register_table("man", "anc", """
  SELECT row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, series_id, slot_utc) - 1 AS sample_idx,
    series_id, split, slot_utc, input_start_utc, target_end_utc, target_mean_frp, target_max_frp FROM anc""")
_man = f"sample_idx, series_id, split, input_start_utc, target_end_utc, {rc('target_mean_frp', 'target_mean_frp')}, {rc('target_max_frp', 'target_max_frp')}"


@query("manifest", "W2", sql("man", f"SELECT {_man} FROM man"))
def _(spark, d):
    return M.manifest(stored_windows(spark, d)).select(
        "sample_idx", "series_id", "split", "input_start_utc", "target_end_utc", *rounded("target_mean_frp", "target_max_frp"))


@query("manifest_file", "IO5 IO7", sql("man", f"SELECT {_man.replace('series_id,', 'CAST(series_id AS VARCHAR) AS series_id,')} FROM man WHERE split = 'val'"))
def _(spark, d):
    path = stage_path(spark)
    writers.write_manifest(M.manifest(stored_windows(spark, d)), path)
    return readers.read_manifest(spark, path, "val").select(
        "sample_idx", "series_id", "split", "input_start_utc", "target_end_utc", *rounded("target_mean_frp", "target_max_frp"))


@query("observation_files", "IO1", sql("hourly cat", f"""
SELECT series_name AS series_id, slot_utc, slot_type, {rc('frp_sum_mw', 'frp_sum_mw')}, {rc('sat_fraction', 'sat_fraction')}, n_pixels
FROM hourly JOIN cat ON cat.series_id = hourly.series_id"""))
def _(spark, d):
    folder = _series_files(spark, d)
    return readers.read_observations(spark, folder).select(
        "series_id", "slot_utc", "slot_type", *rounded("frp_sum_mw", "sat_fraction"), "n_pixels")


def _series_files(spark, d):
    """Both kinds of per-series files side by side in one folder."""
    lay = src.layout(spark, d)
    names = src.catalogue(spark, d).select("series_id", "series_name")
    folder = stage_path(spark)
    obs = src.hourly(spark, d, lay).join(names, "series_id").drop("series_id")
    cov = src.covariates(spark, d, lay).join(names, "series_id").drop("series_id").withColumn("tp_m", F.lit(0.0))
    writers.write_series_files(obs, folder, "series_name", "_hourly")
    cov = cut(cov)  # two kinds of files are written from it
    other = F.col("series_name").substr(-1, 1).isin("1", "3", "5")  # files of some years have other columns in another order
    writers.write_series_files(cov.filter(~other), folder, "series_name", "_era5_hourly")
    writers.write_series_files(cov.filter(other).select(*reversed([c for c in cov.columns if c != "tp_m"])), folder, "series_name", "_era5_hourly")
    return folder


@query("covariate_files", "IO2", sql("cov cat", f"""
SELECT series_name AS series_id, slot_utc, {', '.join(rc(c, c) for c in COVARIATES)} FROM cov JOIN cat ON cat.series_id = cov.series_id"""))
def _(spark, d):
    return readers.read_covariates(spark, _series_files(spark, d)).select("series_id", "slot_utc", *rounded(*COVARIATES))


@query("catalogue_file", "IO3", sql("cat", "SELECT series_name AS series_id, split FROM cat"))
def _(spark, d):
    path = stage_path(spark)
    writers.write_table(src.catalogue(spark, d).select(
        F.col("series_name").alias("series_id"), "split", "intensity_tier", "wind_regime", "country"), path)
    return readers.catalogue_splits(readers.read_catalogue(spark, path))


@query("norm_parameter_table", "IO8 IO12", sql("norm", f"SELECT feature, {rc('mean', 'mean')}, {rc('std', 'std')} FROM norm"))
def _(spark, d):
    path = stage_path(spark)
    lay = src.layout(spark, d)
    writers.write_norm_params(N.norm_table(feat.feature_rows(src.panel(spark, d, lay), lay)), path)
    return readers.read_norm_params(spark, path).select("feature", *rounded("mean", "std"))


# ----------------------------------------------------------------- sampling

def _h(*parts):
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 15) AS BIGINT)"


def _picks(size, count, *label):
    raw = ", ".join(f"[{_h(*label, repr(str(j)))} % greatest({size} - {j}, 1)]" for j in range(count))
    return f"""list_reduce([CAST([] AS BIGINT[]), {raw}][1:least({count}, {size}) + 1], lambda t, x: list_sort(list_append(t,
      list_reduce(list_concat(x, t), lambda v, c: CASE WHEN v >= c THEN v + 1 ELSE v END))))"""


register_table("pool", "anc", """
  SELECT series_id, slot_utc, row_number() OVER (PARTITION BY series_id ORDER BY slot_utc) - 1 AS pick FROM anc WHERE fire_active AND split = 'train'""")
register_table("psize", "pool", """
  SELECT series_id, count(*) AS pool_size, row_number() OVER (ORDER BY md5(CAST(series_id AS VARCHAR))) - 1 AS series_no FROM pool GROUP BY 1""")
register_table("chosen", "psize", f"""
  SELECT b AS batch, unnest({_picks('n', 8, "'0'", "'s'", 'CAST(b AS VARCHAR)')}) AS series_no
  FROM (SELECT unnest(range(0, greatest(1, total // 64))) AS b, n FROM (SELECT CAST(sum(pool_size) AS BIGINT) AS total, count(*) AS n FROM psize))""")
register_table("picked", "chosen psize", f"""
  SELECT batch, series_id, unnest(CASE WHEN pool_size >= 8 THEN {_picks('pool_size', 8, "'0'", "'w'", 'CAST(batch AS VARCHAR)', 'CAST(series_id AS VARCHAR)')}
    ELSE [{', '.join(_h("'0'", "'w'", 'CAST(batch AS VARCHAR)', 'CAST(series_id AS VARCHAR)', repr(str(j))) + ' % pool_size' for j in range(8))}] END) AS pick
  FROM chosen JOIN psize USING (series_no)""")


@query("event_balanced_batches", "R1", sql("picked pool", """
SELECT batch, p.series_id, w.slot_utc FROM picked p JOIN pool w ON w.series_id = p.series_id AND w.pick = p.pick"""))
def _(spark, d):
    return S.event_balanced_batches(windows(spark, d).filter("split = 'train'"))


register_table("spot", "anc", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || CAST(series_id AS VARCHAR) || ':' || strftime(slot_utc, '%Y-%m-%d %H:%M:%S'))) AS rn FROM anc)
  WHERE rn <= 5""")


@query("spot_sample", "R2", sql("spot", "SELECT split, series_id, slot_utc FROM spot"))
def _(spark, d):
    return S.spot_sample(windows(spark, d).select("split", "series_id", "slot_utc"))


# ----------------------------------------------------------------- quality gate

register_table("day", "hourly", """
  SELECT series_id, CAST(slot_utc AS DATE) AS day, count(*) AS n, count(*) FILTER (slot_type = 'missing') AS n_missing,
    avg(CASE WHEN slot_type = 'missing' THEN 1 ELSE 0 END) < 0.5 AS complete FROM hourly GROUP BY 1, 2""")
register_table("audit", "hourly day", """
  SELECT h.series_id, round_even(avg(CASE WHEN slot_type = 'missing' THEN 1.0::DOUBLE ELSE 0 END), 4) AS gap_rate,
    round_even(avg(CASE WHEN sat_fraction > 0.3 THEN 1.0::DOUBLE ELSE 0 END) FILTER (slot_type = 'fire' AND sat_fraction IS NOT NULL), 4) AS sat_rate,
    any_value(d.complete_days) AS complete_days,
    round_even(coalesce(max(frp_sum_mw) FILTER (slot_type = 'fire'), 0), 1) AS peak_frp_mw,
    count(*) AS total_slots, count(*) FILTER (slot_type = 'fire') AS n_fire_slots, count(*) FILTER (slot_type = 'missing') AS n_missing,
    any_value(d.n_days) AS n_days
  FROM hourly h JOIN (SELECT series_id, count(*) FILTER (complete) AS complete_days, count(*) AS n_days FROM day GROUP BY 1) d
    ON d.series_id = h.series_id GROUP BY 1""")


@query("audit_metrics", "Q1", sql("audit", "SELECT * FROM audit"))
def _(spark, d):
    return Q.audit(src.hourly(spark, d))


@query("complete_days", "Q2", sql("day", "SELECT series_id, CAST(day AS VARCHAR) AS day, complete FROM day"))
def _(spark, d):
    return Q.complete_days(src.hourly(spark, d)).withColumn("day", F.col("day").cast("string"))


_flag = lambda v, op, lim: f"CASE WHEN {v} IS NULL THEN 'N/A' WHEN {v} {op} {lim} THEN 'PASS' ELSE 'FAIL' END"
_gap, _sat, _days = _flag("gap_rate", "<=", "0.62"), _flag("sat_rate", "<=", "0.3"), _flag("complete_days", ">=", "3")
register_table("gatet", "audit", f"""
  SELECT series_id, {_gap} AS gap_flag, {_sat} AS sat_flag, {_days} AS days_flag,
    {_flag('n_fire_slots', '>=', '15')} AS fire_flag, {_flag('n_days', '>=', '5')} AS duration_flag FROM audit""")


@query("gate_verdicts", "Q3 P12", sql("gatet", """
SELECT series_id, gap_flag, sat_flag, days_flag,
  CASE WHEN gap_flag = 'PASS' AND sat_flag = 'PASS' AND days_flag = 'PASS' THEN 'OK' ELSE 'FLAG' END AS overall FROM gatet"""))
def _(spark, d):
    g = Q.gate(Q.audit(src.hourly(spark, d)), {"gap_rate": 0.62})
    return g.select("series_id", "gap_flag", "sat_flag", "days_flag", "overall")


@query("gate_with_documented_extras", "Q4", sql("gatet", """
SELECT series_id, gap_flag, sat_flag, days_flag, fire_flag, duration_flag, CASE WHEN gap_flag = 'PASS' AND sat_flag = 'PASS'
  AND days_flag = 'PASS' AND fire_flag = 'PASS' AND duration_flag = 'PASS' THEN 'OK' ELSE 'FLAG' END AS overall FROM gatet"""))
def _(spark, d):
    g = Q.gate(Q.audit(src.hourly(spark, d)), {"gap_rate": 0.62}, min_fire_slots=15, min_days=5)
    return g.select("series_id", "gap_flag", "sat_flag", "days_flag", "fire_flag", "duration_flag", "overall")


# ----------------------------------------------------------------- readiness

def all_rows(spark, d):
    lay = src.layout(spark, d)
    return feat.build_rows(src.panel(spark, d, lay), lay)


@query("window_audit", "W4 C1 J6", sql("win cat", """
SELECT cat.series_id, cat.split, coalesce(n, 0) AS n_rows, coalesce(k, 0) AS n_windows, coalesce(n, 0) - 59 AS max_possible,
  CASE WHEN k > 0 THEN 'ok' WHEN coalesce(n, 0) = 0 THEN 'no data' WHEN n - 59 <= 0 THEN 'too short' ELSE 'all windows incomplete' END AS status
FROM cat LEFT JOIN (SELECT series_id, count(*) AS n, count(*) FILTER (is_anchor) AS k FROM win GROUP BY 1) w ON w.series_id = cat.series_id"""))
def _(spark, d):
    return R.window_audit(all_rows(spark, d), src.catalogue(spark, d))


@query("split_leaks", "C2", sql("anc ev", """
SELECT series_id, min(split) AS first_split, max(split) AS last_split FROM
  (SELECT series_id, CASE WHEN k % 10 = 1 AND series_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM ev)
GROUP BY 1 HAVING min(split) <> max(split)"""))
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    marked = src.events(spark, d).select(F.floor(F.col("user_id") / 5).alias("series_id"), k.alias("k")).withColumn(
        "split", F.expr("CASE WHEN k % 10 = 1 AND series_id % 5 = 0 THEN 'val' ELSE 'train' END"))
    return R.split_leaks(marked)


register_table("sgap", "anc", """
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY input_start_utc) AS gap_no FROM (
    SELECT series_id, input_start_utc, epoch(input_start_utc - lag(input_start_utc) OVER (PARTITION BY series_id ORDER BY input_start_utc)) / 3600 AS gap_hours
    FROM anc) WHERE gap_hours > 1.5""")


@query("start_gaps", "F14 C2", sql("sgap", f"SELECT series_id, CAST(gap_no AS INTEGER) AS gap_no, input_start_utc, {rc('gap_hours', 'gap_hours')} FROM sgap WHERE gap_no <= 3"))
def _(spark, d):
    return R.start_gaps(windows(spark, d), src.layout(spark, d)).select("series_id", "gap_no", "input_start_utc", *rounded("gap_hours"))


@query("start_gap_counts", "C2", sql("sgap anc", """
SELECT a.series_id, (SELECT count(*) FROM sgap g WHERE g.series_id = a.series_id) AS n_gaps FROM (SELECT DISTINCT series_id FROM anc) a"""))
def _(spark, d):
    return R.start_gap_counts(windows(spark, d), src.layout(spark, d))


register_table("zcell", "zfeat anc", """
  SELECT z.*, a.split AS asplit FROM anc a JOIN zfeat z ON z.series_id = a.series_id AND z.row_no BETWEEN a.row_no - 47 AND a.row_no""")


register_table("icell", "zcell", "\nUNION ALL ".join(
    f"SELECT asplit AS split, '{f}' AS feature, count(*) FILTER ({f} IS NULL OR isnan({f})) AS n_nan, count(*) FILTER (isinf({f})) AS n_inf, "
    f"min({f}) = max({f}) AS is_constant, count(*) FILTER (abs({f}) > 10) AS n_extreme, {rc(f'max(abs({f}))', 'max_abs')} FROM zcell GROUP BY 1"
    for f in FEATURES))


@query("cell_integrity", "C3", sql("icell", "SELECT * FROM icell"))
def _(spark, d):
    c = R.cell_integrity(weighted(spark, d))
    return c.select("split", "feature", "n_nan", "n_inf", "is_constant", "n_extreme", *rounded("max_abs"))


@query("cell_integrity_verdict", "C3", sql("icell", """
SELECT split, CAST(sum(n_nan) AS BIGINT) AS n_nan, CAST(sum(n_inf) AS BIGINT) AS n_inf, count(*) FILTER (is_constant) AS n_constant,
  CAST(sum(n_extreme) AS BIGINT) AS n_extreme, sum(n_nan) = 0 AND sum(n_inf) = 0 AND count(*) FILTER (is_constant) = 0 AS passed FROM icell GROUP BY 1"""))
def _(spark, d):
    return R.integrity_verdict(R.cell_integrity(weighted(spark, d)))


@query("target_sanity", "C4 A13", sql("anc lng", f"""
SELECT a.split, count(*) AS n_samples, (SELECT count(*) FROM lng WHERE lng.split = a.split AND (y IS NULL OR isnan(y))) AS n_null, (SELECT count(*) FROM lng WHERE lng.split = a.split AND y < 0) AS n_negative,
  count(*) FILTER (target_max_frp = 0) AS all_zero, {rc('avg(CASE WHEN target_max_frp = 0 THEN 1 ELSE 0 END)', 'zero_fraction')},
  avg(CASE WHEN target_max_frp = 0 THEN 1 ELSE 0 END) > 0.6 AS flagged,
  (SELECT count(*) FROM lng WHERE lng.split = a.split AND (y IS NULL OR isnan(y) OR y < 0)) = 0 AS passed FROM anc a GROUP BY 1"""))
def _(spark, d):
    t = R.target_sanity(windows(spark, d))
    return t.select("split", "n_samples", F.col("n_null").cast("long").alias("n_null"), F.col("n_negative").cast("long").alias("n_negative"),
                    "all_zero", *rounded("zero_fraction"), "flagged", "passed")


_drift = [f for f in SCALED if f != "hours_since_first_fire"]


@query("normalisation_drift", "C5", sql("zcell", "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, {rc(f'avg({f})', 'mean')}, {rc(f'stddev_pop({f})', 'std')}, "
    f"abs(avg({f})) <= 0.15 AND stddev_pop({f}) BETWEEN 0.85 AND 1.15 AS match FROM zcell WHERE asplit = 'train'" for f in _drift)))
def _(spark, d):
    lay = src.layout(spark, d)
    return R.drift_of_raw(feat.weighted_rows(src.panel(spark, d, lay), lay)).select("feature", *rounded("mean", "std"), "match")


_compared = COVARIATES + ("sat_fraction",)
register_table("rawpos", "panel", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY slot_utc) AS pos FROM panel")
register_table("rebuilt", "spot rawpos", f"""
  SELECT s.split, s.series_id, s.slot_utc, s.targets, list(p.frp_sum_mw ORDER BY p.pos) FILTER (p.pos > b.pos + 47) AS expected,
    {', '.join(f'max(p.{c}) FILTER (p.pos = b.pos + 47) AS raw_{c}' for c in _compared)}
  FROM spot s JOIN rawpos b ON b.series_id = s.series_id AND b.slot_utc = s.input_start_utc
  JOIN rawpos p ON p.series_id = s.series_id AND p.pos BETWEEN b.pos + 47 AND b.pos + 59 GROUP BY 1, 2, 3, 4""")


def _alignment_sql(first="x.targets[1]", u10="z.u10"):
    """Stored values against those rebuilt from raw rows, number by number."""
    near = lambda a, b: f"abs({a} - {b}) <= 0.01 + 1e-4 * abs({b})"
    raw = {c: f"(x.raw_{c} - (SELECT mean FROM norm WHERE feature = '{c}')) / (SELECT std FROM norm WHERE feature = '{c}')" if c in SCALED else f"x.raw_{c}"
           for c in _compared}
    target = " AND ".join(near(first if k == 1 else f"x.targets[{k}]", f"x.expected[{k}]") for k in range(1, 13))
    inputs = " AND ".join(f"(x.raw_{c} IS NULL OR {near(u10 if c == 'u10' else f'z.{c}', raw[c])})" for c in _compared)
    return f"""SELECT x.split, x.series_id, x.slot_utc, len(x.expected) = 12 AND {target} AS target_ok, {inputs} AS input_ok
      FROM rebuilt x JOIN zfeat z ON z.series_id = x.series_id AND z.slot_utc = x.slot_utc"""


def aligned(spark, d, rows, scaling, lay, damage=None):
    """A few sampled windows of the scaled rows against a rebuild from the joined tables, of the sampled series alone."""
    keys = cut(S.spot_sample(rows.filter("is_anchor").select("split", "series_id", "slot_utc")))
    sample = rows.join(F.broadcast(keys.select("series_id", "slot_utc")), ["series_id", "slot_utc"], "left_semi")
    sample = damage(sample) if damage else sample
    joined = A.assemble(src.hourly(spark, d, lay, keys), src.covariates(spark, d, lay, keys), src.catalogue(spark, d))
    raw = feat.open_panel(joined, lay)
    raw = raw.close(raw.df).select("series_id", "slot_utc", "row_no", "frp_sum_mw", "sat_fraction", *COVARIATES)
    return R.alignment(sample, raw, params=scaling.params)


@query("alignment_check", "C6", sql("rebuilt zfeat", _alignment_sql()))
def _(spark, d):
    rows, scaling, lay = scaled(spark, d)
    return aligned(spark, d, rows, scaling, lay)


@query("alignment_of_damaged", "C6", sql("rebuilt zfeat", _alignment_sql(
    "(x.targets[1] + CASE WHEN x.series_id % 3 = 0 THEN 1 ELSE 0 END)", "(z.u10 + CASE WHEN x.series_id % 3 = 1 THEN 0.5 ELSE 0 END)")))
def _(spark, d):
    """The same on a store with some targets and inputs changed: the check has to find them."""
    def damage(df):
        y = F.transform("targets", lambda x, i: x + F.when((i == 0) & (F.col("series_id") % 3 == 0), 1.0).otherwise(0.0))
        return df.withColumns({"targets": y, "u10": F.col("u10") + F.when(F.col("series_id") % 3 == 1, 0.5).otherwise(0.0)})

    rows, scaling, lay = scaled(spark, d)
    return aligned(spark, d, rows, scaling, lay, damage)


def _balance_query(name, covers, attribute):
    @query(name, covers, sql("anc cat", f"""
SELECT s.split, v.value, (SELECT count(DISTINCT anc.series_id) FROM anc JOIN cat ON cat.series_id = anc.series_id
  WHERE anc.split = s.split AND cat.{attribute} IS NOT DISTINCT FROM v.value) AS n_series
FROM (VALUES ('train'), ('val'), ('test')) s(split), (SELECT DISTINCT {attribute} AS value FROM cat) v"""))
    def run(spark, d):
        return R.split_balance(windows(spark, d), src.catalogue(spark, d), attribute)


_balance_query("split_balance", "C7 J6", "intensity_tier")
_balance_query("wind_regime_balance", "C7", "wind_regime")
_balance_query("country_balance", "C7", "country")


@query("fire_content", "C7", sql("anc", f"""
SELECT split, count(*) AS total, count(*) FILTER (target_mean_frp > 0) AS fire_active, count(*) FILTER (target_mean_frp = 0) AS no_fire,
  {rc('avg(CASE WHEN target_mean_frp > 0 THEN 1 ELSE 0 END)', 'fire_fraction')} FROM anc GROUP BY 1"""))
def _(spark, d):
    return R.fire_content(windows(spark, d)).select("split", "total", "fire_active", "no_fire", *rounded("fire_fraction"))
