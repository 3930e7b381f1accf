"""Panel assembly, scalar expressions, series features and window construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions import columns as C
from panelcast.operators import assemble as A
from panelcast.operators import features as feat
from panelcast.registry.base import query, rc, register_table, sql
from panelcast.registry.util import rd, rounded
from panelcast.schema import COVARIATES, FEATURES, LAGS
from panelcast.sources import adapter as src


def _panel(spark, d):
    lay = src.layout(spark, d)
    return src.panel(spark, d, lay), lay


def _features(spark, d, wind=False):
    p, lay = _panel(spark, d)
    return feat.feature_rows(p, lay, wind=wind)


def windows(spark, d, wind=False):
    p, lay = _panel(spark, d)
    return feat.anchors(p, lay, wind=wind)


# ----------------------------------------------------------------- projections

@query("drop_gaps", "P1", sql("hourly", f"""
SELECT series_id, slot_utc, slot_type, {rc('frp_sum_mw', 'frp_sum_mw')} FROM hourly WHERE slot_type <> 'missing'"""))
def _(spark, d):
    return A.drop_gaps(src.hourly(spark, d)).select("series_id", "slot_utc", "slot_type", *rounded("frp_sum_mw"))


@query("fill_saturation", "P2", sql("hourly", f"""
SELECT series_id, slot_utc, {rc('coalesce(sat_fraction, 0)', 'sat_fraction')} FROM hourly"""))
def _(spark, d):
    return A.fill_saturation(src.hourly(spark, d)).select("series_id", "slot_utc", *rounded("sat_fraction"))


@query("calendar_codes", "P3", f"""
SELECT event_id, {rc("sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24)", 'hour_sin')},
  {rc("cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24)", 'hour_cos')},
  {rc("sin(2 * pi() * dayofyear(ts) / 365)", 'doy_sin')}, {rc("cos(2 * pi() * dayofyear(ts) / 365)", 'doy_cos')}
FROM events""")
def _(spark, d):
    cols = C.calendar("ts")
    return src.events(spark, d).select("event_id", *[rd(c).alias(n) for n, c in cols.items()])


@query("log_value", "P4", sql("panel", f"SELECT series_id, slot_utc, {rc('ln(1 + frp_sum_mw)', 'log_frp')} FROM panel"))
def _(spark, d):
    p, _ = _panel(spark, d)
    return p.select("series_id", "slot_utc", rd(F.log1p("frp_sum_mw")).alias("log_frp"))


@query("fire_flag", "P5", sql("hourly", """
SELECT series_id, slot_utc, CASE WHEN slot_type = 'fire' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_fire FROM hourly"""))
def _(spark, d):
    return src.hourly(spark, d).select("series_id", "slot_utc", C.fire_flag().alias("is_fire"))


@query("nonnegative_clip", "P8", sql("panel", f"""
SELECT series_id, slot_utc, {rc('greatest(u10, 0)', 'u10_pos')}, {rc('greatest(delta_wind_3h, 0)', 'delta_pos')} FROM panel"""))
def _(spark, d):
    p, _ = _panel(spark, d)
    return p.select("series_id", "slot_utc", rd(C.floor0(F.col("u10"))).alias("u10_pos"),
                    rd(C.floor0(F.col("delta_wind_3h"))).alias("delta_pos"))


@query("log_mean_value", "P9", sql("panel", f"""
SELECT series_id, {rc('exp(avg(ln(1 + frp_sum_mw))) - 1', 'log_mean_frp')} FROM panel GROUP BY 1"""))
def _(spark, d):
    p, _ = _panel(spark, d)
    return p.groupBy("series_id").agg(rd(F.expm1(F.avg(F.log1p("frp_sum_mw")))).alias("log_mean_frp"))


@query("fire_active_windows", "P10", sql("anc", "SELECT series_id, slot_utc, fire_active FROM anc"))
def _(spark, d):
    return windows(spark, d).select("series_id", "slot_utc", C.any_positive().alias("fire_active"))


@query("residual_forecast", "P11", sql("lng", f"""
SELECT series_id, slot_utc, lead, {rc('''greatest(exp(ln(1 + pers) + least(greatest(CAST(lead AS DOUBLE) / 10 - 0.2::DOUBLE, 0), 0.5::DOUBLE)
  * (ln(1 + greatest(frp_lag_24h, 0)) - ln(1 + pers))) - 1, 0)''', 'pred')} FROM lng"""))
def _(spark, d):
    lf = feat.long_form(windows(spark, d), "series_id", "slot_utc", "frp_lag_1h", "frp_lag_24h")
    p = C.floor0(F.col("frp_lag_1h"))
    res = F.log1p(C.floor0(F.col("frp_lag_24h"))) - F.log1p(p)
    return lf.select("series_id", "slot_utc", F.col("lead").cast("long").alias("lead"),
                     rd(C.residual_forecast(p, res, F.col("lead") / 10.0 - 0.2)).alias("pred"))


@query("hour_arithmetic", "P13", sql("lng", """
SELECT series_id, slot_utc, lead, target_end_utc - INTERVAL 12 HOUR AS t_last,
  CAST(hour(target_end_utc - INTERVAL 12 HOUR + to_hours(CAST(lead AS INTEGER))) AS INTEGER) AS target_hour FROM lng"""))
def _(spark, d):
    lf = feat.long_form(windows(spark, d), "series_id", "slot_utc", "target_end_utc")
    t_last = F.col("target_end_utc") - F.expr("INTERVAL 12 HOURS")
    return lf.select("series_id", "slot_utc", F.col("lead").cast("long").alias("lead"), t_last.alias("t_last"),
                     F.hour(C.hours_later(t_last, F.col("lead"))).alias("target_hour"))


@query("display_names", "P14", sql("cat", """
SELECT series_id, 'Unit ' || lpad(CAST(series_id AS VARCHAR), 6, '0') || ' ' || CAST(2017 + series_id % 8 AS VARCHAR) AS title,
  regexp_replace(series_name, '_[0-9]{4}$', '') AS short_name FROM cat"""))
def _(spark, d):
    return src.catalogue(spark, d).select("series_id", C.display_name(F.col("series_name")).alias("title"),
                                          C.without_year(F.col("series_name")).alias("short_name"))


_sel = [f"frp_lag_{k}h" for k in LAGS] + ["u10", "v10", "t2m_K", "d2m_K", "blh_m", "wind_speed_10m", "vpd_kPa",
                                          "precip_24h_mm", "delta_wind_3h"]


@query("anchor_inputs", "P15", sql("anc", f"SELECT series_id, slot_utc, {', '.join(rc(c, c) for c in _sel)} FROM anc"))
def _(spark, d):
    return windows(spark, d).select("series_id", "slot_utc", *rounded(*_sel))


_hyb = """(0.5 * abs(ln(1 + pers) - ln(1 + y)) + 0.5 * pow(ln(1 + pers) - ln(1 + y), 2))
  * CASE WHEN fire_active THEN 7 ELSE 1 END"""


@query("log_hybrid_error", "P16", sql("lng", f"SELECT series_id, slot_utc, lead, {rc(_hyb, 'err')} FROM lng"))
def _(spark, d):
    lf = feat.long_form(windows(spark, d), "series_id", "slot_utc", "fire_active", "frp_lag_1h")
    e = C.log_hybrid(C.floor0(F.col("frp_lag_1h")), F.col("y"), F.col("fire_active"))
    return lf.select("series_id", "slot_utc", F.col("lead").cast("long").alias("lead"), rd(e).alias("err"))


# ----------------------------------------------------------------- joins

@query("join_covariates", "J1", sql("hourly cov", f"""
SELECT h.series_id, h.slot_utc, h.slot_type, {rc('h.frp_sum_mw', 'frp_sum_mw')}, {', '.join(rc('c.' + x, x) for x in COVARIATES)}
FROM hourly h JOIN cov c ON h.series_id = c.series_id AND h.slot_utc = c.slot_utc"""))
def _(spark, d):
    lay = src.layout(spark, d)
    j = A.join_covariates(src.hourly(spark, d, lay), src.covariates(spark, d, lay))
    return j.select("series_id", "slot_utc", "slot_type", *rounded("frp_sum_mw", *COVARIATES))


@query("assemble_panel", "J1 J2 P1 P2", sql("panel", f"""
SELECT series_id, slot_utc, slot_type, split, {rc('frp_sum_mw', 'frp_sum_mw')}, {rc('sat_fraction', 'sat_fraction')},
  {', '.join(rc(x, x) for x in COVARIATES)} FROM panel"""))
def _(spark, d):
    lay = src.layout(spark, d)
    p = A.assemble(src.hourly(spark, d, lay), src.covariates(spark, d, lay), src.catalogue(spark, d))
    return p.select("series_id", "slot_utc", "slot_type", "split", *rounded("frp_sum_mw", "sat_fraction", *COVARIATES))


@query("attach_split", "J2", sql("hourly cat", """
SELECT h.series_id, h.slot_utc, cat.split FROM hourly h JOIN cat ON h.series_id = cat.series_id"""))
def _(spark, d):
    return A.attach_split(src.hourly(spark, d), src.catalogue(spark, d)).select("series_id", "slot_utc", "split")


@query("series_without_data", "J3", sql("cat ev", """
SELECT series_id, CAST(t AS INTEGER) AS table_no FROM (
  SELECT series_id, 1 AS t FROM cat WHERE series_id NOT IN (SELECT series_id FROM ev WHERE event_type = 'error' AND k >= 98)
  UNION ALL
  SELECT series_id, 2 AS t FROM cat WHERE series_id NOT IN (SELECT series_id FROM ev WHERE event_type = 'signup' AND k >= 98))"""))
def _(spark, d):
    lay = src.layout(spark, d)
    k = F.get_json_object("props", "$.k").cast("int")
    ev = src.events(spark, d).select(F.floor(F.col("user_id") / 5).alias("series_id"), "event_type", k.alias("k"))
    strong = ev.filter("event_type = 'error' AND k >= 98")
    signups = ev.filter("event_type = 'signup' AND k >= 98")
    return A.series_without_data(src.catalogue(spark, d), strong, signups)


@query("leaked_series", "J4", sql("cat ev", """
SELECT DISTINCT series_id, split FROM (
  SELECT series_id, CASE WHEN k % 10 = 1 AND series_id % 5 = 0 THEN 'val' WHEN series_id % 10 = 2 THEN 'test' ELSE 'train' END AS split FROM ev)
WHERE split <> 'train' AND series_id IN (SELECT series_id FROM ev
  WHERE NOT (k % 10 = 1 AND series_id % 5 = 0) AND series_id % 10 <> 2)"""))
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    ev = src.events(spark, d).select(F.floor(F.col("user_id") / 5).alias("series_id"), k.alias("k"))
    marked = ev.withColumn("split", F.expr(
        "CASE WHEN k % 10 = 1 AND series_id % 5 = 0 THEN 'val' WHEN series_id % 10 = 2 THEN 'test' ELSE 'train' END"))
    return A.leaked_series(marked)


@query("stack_series_tables", "J10", sql("hourly", f"""
SELECT series_id, slot_utc, slot_type, {rc('frp_sum_mw', 'frp_sum_mw')} FROM hourly"""))
def _(spark, d):
    h = src.hourly(spark, d)
    parts = [h.filter(F.col("slot_type") == t) for t in ("fire", "no_fire", "missing")]
    return A.stack_series(parts).select("series_id", "slot_utc", "slot_type", *rounded("frp_sum_mw"))


# ----------------------------------------------------------------- series features

def _feature_query(name, covers, cols, wind=False):
    @query(name, covers, sql("feat", f"SELECT series_id, slot_utc, {', '.join(rc(c, c) for c in cols)} FROM feat"))
    def run(spark, d):
        return _features(spark, d, wind).select("series_id", "slot_utc", *rounded(*cols))


_feature_query("row_lags", "F1", [f"frp_lag_{k}h" for k in LAGS])
_feature_query("rolling_mean", "F2", ["frp_rolling_6h_mean"])
_feature_query("rolling_std", "F3", ["frp_rolling_6h_std"])
_feature_query("rolling_trend", "F4", ["frp_trend_6h"])
_feature_query("running_total", "F5", ["cumulative_frp"])
_feature_query("hours_since_first_fire", "F6", ["hours_since_first_fire"])
_feature_query("wind_shear", "F7", ["shear_signed"], True)
_feature_query("wind_variability", "F8", ["wind_var_12h"], True)
_feature_query("upper_wind_peak", "F9", ["ws850_max_12h"], True)
_feature_query("hot_dry_windy", "F10", ["hdw_product"], True)
_feature_query("wind_fire_coupling", "F11", ["wind_frp_coupling"], True)
_feature_query("all_features", "F1 F2 F3 F4 F5 F6 P3 P4 P5", list(FEATURES))

_cells = ", ".join(f"{{'feature': '{f}', 'value': {f}}}" for f in FEATURES)
register_table("fcell", "win", f"""
  SELECT series_id, slot_utc, row_no, is_anchor, c.feature AS feature, c.value AS value FROM
    (SELECT series_id, slot_utc, row_no, is_anchor, unnest([{_cells}]) AS c FROM win)""")


@query("window_summary", "F12", sql("fcell", f"""
SELECT series_id, slot_utc, feature, {rc('m', 'mean')}, {rc('s', 'std')}, {rc('value', 'last')}, {rc('b', 'slope')} FROM (
  SELECT series_id, slot_utc, feature, value, is_anchor, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s,
    regr_slope(value, CAST(row_no AS DOUBLE)) OVER w AS b FROM fcell
  WINDOW w AS (PARTITION BY series_id, feature ORDER BY row_no ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)) WHERE is_anchor"""))
def _(spark, d):
    p, lay = _panel(spark, d)
    return feat.window_summary(p, lay).select("series_id", "slot_utc", "feature", *rounded("mean", "std", "last", "slope"))


@query("gap_runs", "F13", sql("hourly", """
SELECT series_id, min(slot_utc) AS gap_start, max(nxt) AS gap_end, count(*) AS n_slots FROM (
  SELECT series_id, slot_utc, slot_type,
    coalesce(lead(slot_utc) OVER (PARTITION BY series_id ORDER BY slot_utc), slot_utc) AS nxt,
    row_number() OVER (PARTITION BY series_id ORDER BY slot_utc)
      - row_number() OVER (PARTITION BY series_id, slot_type = 'missing' ORDER BY slot_utc) AS run
  FROM hourly) WHERE slot_type = 'missing' GROUP BY series_id, run"""))
def _(spark, d):
    lay = src.layout(spark, d)
    return feat.gap_runs(src.hourly(spark, d, lay), lay)


# ----------------------------------------------------------------- windows

@query("window_targets", "W1", sql("anc", f"""
SELECT series_id, slot_utc, row_no, input_start_utc, target_end_utc,
  {', '.join(rc(f'targets[{k}]', f'y{k}') for k in range(1, 13))} FROM anc"""))
def _(spark, d):
    a = windows(spark, d)
    return a.select("series_id", "slot_utc", "row_no", "input_start_utc", "target_end_utc",
                    *[rd(F.col("targets")[k - 1]).alias(f"y{k}") for k in range(1, 13)])


@query("window_inputs", "W1", sql("feat anc", f"""
SELECT a.series_id, a.slot_utc, count(*) AS n_steps, {', '.join(rc(f'sum(f.{c})', c, 4) for c in FEATURES)}
FROM anc a JOIN feat f ON f.series_id = a.series_id AND f.row_no BETWEEN a.row_no - 47 AND a.row_no GROUP BY 1, 2"""))
def _(spark, d):
    p, lay = _panel(spark, d)
    x = feat.input_windows(p, lay)
    total = lambda f: F.aggregate(F.col("inputs"), F.lit(0.0), lambda acc, s: acc + s[f])
    return x.select("series_id", "slot_utc", F.size("inputs").cast("long").alias("n_steps"),
                    *[rd(total(f), 4).alias(f) for f in FEATURES])


@query("long_form", "W3", sql("lng", f"SELECT series_id, slot_utc, lead, {rc('y', 'y')}, {rc('pers', 'persistence')} FROM lng"))
def _(spark, d):
    lf = feat.long_form(windows(spark, d), "series_id", "slot_utc", "frp_lag_1h")
    return lf.select("series_id", "slot_utc", F.col("lead").cast("long").alias("lead"), rd("y").alias("y"),
                     rd(C.floor0(F.col("frp_lag_1h"))).alias("persistence"))
