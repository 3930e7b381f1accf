"""Query registry and the shared table expressions of the check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from panelcast.schema import COVARIATES, FEATURES, LAGS, SCALED


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, oracle: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(covers.split()), fn, oracle)
        return fn
    return deco


def r(expr: str, digits: int = 6) -> str:
    """Double at ``digits`` decimals without negative zero (see ``util.rd``)."""
    p = f"CAST({10 ** digits} AS DOUBLE)"
    x = f"round(CAST({expr} AS DOUBLE) * {p} + CAST(0.0857864 AS DOUBLE)) / {p}"
    return f"CASE WHEN {x} = 0 THEN CAST(0 AS DOUBLE) ELSE {x} END"


def rc(expr: str, name: str, digits: int = 6) -> str:
    return f"{r(expr, digits)} AS {name}"


_lags = ",\n    ".join(f"lag(frp_sum_mw, {k}) OVER w AS frp_lag_{k}h" for k in LAGS)
_null = " OR ".join(f"{f} IS NULL" for f in FEATURES)
_hit = "event_type = 'error' AND k >= 75"

# name -> (tables it builds on, body)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """
  SELECT user_id // 5 AS series_id, date_trunc('hour', ts) AS slot_utc, event_type, value,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"""),
    "cells": (("ev",), f"""
  SELECT series_id, CAST(slot_utc AS TIMESTAMP) AS slot_utc,
    CASE WHEN count(*) FILTER ({_hit}) > 0 THEN 'fire' ELSE 'no_fire' END AS slot_type,
    coalesce(sum(value) FILTER ({_hit}), CAST(0 AS DOUBLE)) AS frp_sum_mw,
    avg(CASE WHEN k >= 90 THEN 1 ELSE 0 END) FILTER ({_hit}) AS sat_fraction,
    count(*) FILTER ({_hit}) AS n_pixels,
    (avg(k) - 50) / 10 AS u10,
    CAST(max(k) - min(k) AS DOUBLE) / 20 AS v10,
    avg(value) / 20 AS u850,
    (max(value) - min(value)) / 20 AS v850,
    CAST((7 * sum(k)) % 360 AS DOUBLE) AS wind_dir_10m,
    CAST(count(*) + 280 AS DOUBLE) AS d2m_K,
    CAST(sum(k) + 500 AS DOUBLE) AS blh_m,
    avg(value) / 50 AS vpd_kPa,
    CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) AS precip_1h_mm
  FROM ev GROUP BY 1, 2"""),
    "hourly": (("cells",), """
  SELECT g.series_id, g.slot_utc, coalesce(c.slot_type, 'missing') AS slot_type, c.frp_sum_mw, c.sat_fraction,
    coalesce(c.n_pixels, 0) AS n_pixels
  FROM (SELECT series_id, unnest(generate_series(min(slot_utc), max(slot_utc), INTERVAL 1 HOUR)) AS slot_utc
        FROM cells GROUP BY 1) g
  LEFT JOIN cells c ON c.series_id = g.series_id AND c.slot_utc = g.slot_utc"""),
    "cov": (("cells",), """
  SELECT series_id, slot_utc, u10, v10, CAST(290 + CAST(hour(slot_utc) AS DOUBLE) / 2 AS DOUBLE) AS t2m_K, d2m_K, blh_m,
    u850, v850, ws10 AS wind_speed_10m, wind_dir_10m, ws850 AS wind_speed_850, vpd_kPa, precip_1h_mm,
    sum(precip_1h_mm) OVER (PARTITION BY series_id ORDER BY slot_utc ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS precip_24h_mm,
    coalesce(ws10 - lag(ws10, 3) OVER (PARTITION BY series_id ORDER BY slot_utc), CAST(0 AS DOUBLE)) AS delta_wind_3h
  FROM (SELECT *, sqrt(u10 * u10 + v10 * v10) AS ws10, sqrt(u850 * u850 + v850 * v850) AS ws850 FROM cells)"""),
    "cat": ((), """
  SELECT series_id,
    'unit_' || lpad(CAST(series_id AS VARCHAR), 6, '0') || '_' || CAST(2017 + series_id % 8 AS VARCHAR) AS series_name,
    CASE series_id % 10 WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'train' END AS split,
    ['high', 'medium', 'low'][series_id % 3 + 1] AS intensity_tier,
    ['A', 'B', 'C', 'D'][series_id % 4 + 1] AS wind_regime,
    ['X', 'Y'][series_id % 2 + 1] AS country
  FROM (SELECT DISTINCT user_id // 5 AS series_id FROM events)"""),
    "panel": (("hourly", "cov", "cat"), f"""
  SELECT h.series_id, h.slot_utc, h.slot_type, h.frp_sum_mw,
    coalesce(h.sat_fraction, CAST(0 AS DOUBLE)) AS sat_fraction, h.n_pixels,
    {', '.join('c.' + x for x in COVARIATES)}, cat.split
  FROM hourly h JOIN cov c ON h.series_id = c.series_id AND h.slot_utc = c.slot_utc
  JOIN cat ON cat.series_id = h.series_id
  WHERE h.slot_type <> 'missing'"""),
    "feat": (("panel",), f"""
  SELECT *, CASE WHEN frp_lag_1h IS NOT NULL THEN wind_speed_850 * greatest(frp_lag_1h, 0) END AS wind_frp_coupling
  FROM (SELECT *,
    row_number() OVER w AS row_no,
    sin(2 * pi() * (hour(slot_utc) + minute(slot_utc) / 60.0) / 24) AS hour_sin,
    cos(2 * pi() * (hour(slot_utc) + minute(slot_utc) / 60.0) / 24) AS hour_cos,
    sin(2 * pi() * dayofyear(slot_utc) / 365) AS doy_sin,
    cos(2 * pi() * dayofyear(slot_utc) / 365) AS doy_cos,
    ln(1 + frp_sum_mw) AS log_frp,
    CASE WHEN slot_type = 'fire' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_fire,
    {_lags},
    avg(frp_sum_mw) OVER w6 AS frp_rolling_6h_mean,
    stddev_samp(frp_sum_mw) OVER w6 AS frp_rolling_6h_std,
    CASE WHEN count(frp_sum_mw) OVER w6 = 6 THEN regr_slope(frp_sum_mw, ix) OVER w6 END AS frp_trend_6h,
    sum(frp_sum_mw) OVER (w ROWS UNBOUNDED PRECEDING) AS cumulative_frp,
    coalesce(greatest(epoch(slot_utc - min(CASE WHEN slot_type = 'fire' THEN slot_utc END) OVER (PARTITION BY series_id))
       / 3600.0, CAST(0 AS DOUBLE)), CAST(0 AS DOUBLE)) AS hours_since_first_fire,
    wind_speed_850 - wind_speed_10m AS shear_signed,
    stddev_pop(u10) OVER w12 + stddev_pop(v10) OVER w12 AS wind_var_12h,
    max(wind_speed_850) OVER w12 AS ws850_max_12h,
    vpd_kPa * wind_speed_10m AS hdw_product
    FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY slot_utc) AS ix FROM panel)
    WINDOW w AS (PARTITION BY series_id ORDER BY slot_utc),
      w6 AS (PARTITION BY series_id ORDER BY slot_utc ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
      w12 AS (PARTITION BY series_id ORDER BY slot_utc ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""),
    "win": (("feat",), f"""
  SELECT *, list(frp_sum_mw) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS targets,
    avg(frp_sum_mw) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS target_mean_frp,
    max(frp_sum_mw) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS target_max_frp,
    lag(slot_utc, 47) OVER w AS input_start_utc, lead(slot_utc, 12) OVER w AS target_end_utc,
    row_no >= 48 AND sum(bad) OVER (w ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) = 0
      AND count(frp_sum_mw) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) = 12 AS is_anchor
  FROM (SELECT *, CASE WHEN {_null} THEN 1 ELSE 0 END AS bad FROM feat)
  WINDOW w AS (PARTITION BY series_id ORDER BY slot_utc)"""),
    "anc": (("win",), """
  SELECT *, target_max_frp > 0 AS fire_active, greatest(frp_lag_1h, CAST(0 AS DOUBLE)) AS pers
  FROM win WHERE is_anchor"""),
    "lng": (("anc",), """
  SELECT series_id, split, slot_utc, row_no, fire_active, pers, is_fire, frp_lag_1h, frp_lag_24h, target_end_utc,
    lead, targets[lead] AS y
  FROM anc, (SELECT unnest(range(1, 13)) AS lead)"""),
    "seedp": (("lng",), """
  SELECT *, pers * (0.6::DOUBLE + 0.1::DOUBLE * ((7 * seed + 3 * lead + series_id) % 9)) + ((seed + lead) % 4) AS pred
  FROM lng, (SELECT unnest(range(0, 10)) AS seed)"""),
    "norm": (("feat",), "\n  UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg({f}) AS mean, stddev_pop({f}) AS std FROM feat WHERE split = 'train'"
        for f in SCALED)),
    "zfeat": (("feat", "norm"), "SELECT " + ", ".join(
        ["series_id", "split", "slot_utc", "row_no", "slot_type", "frp_sum_mw AS raw_value"]
        + [f"(feat.{f} - (SELECT mean FROM norm WHERE feature = '{f}')) / (SELECT std FROM norm WHERE feature = '{f}') AS {f}"
           if f in SCALED else f for f in FEATURES]) + " FROM feat"),
}


def register_table(name: str, needs: str, body: str) -> None:
    TABLES[name] = (tuple(needs.split()), body)


def sql(needs: str, body: str) -> str:
    """``body`` behind the table expressions it needs, in dependency order."""
    order: list[str] = []

    def visit(n):
        for d in TABLES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needs.split():
        visit(n)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n][1]})" for n in order)
    return f"WITH {ctes}\n{body}" if order else body
