"""The build checks and the readiness verdict over the scaled dataset, sound and damaged."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.plans import dataset as D
from panelcast.plans import readiness as R
from panelcast.registry.base import query, register_table, sql
from panelcast.registry.dataset_queries import _alignment_sql, _drift, aligned, scaled
from panelcast.registry.store_queries import CHANNELS, dataset
from panelcast.schema import FEATURES, SCALED
from panelcast.session import cut, stage_path
from panelcast.sources import adapter as src
from panelcast.sources import readers, writers


def _checks_sql(lng="lng", shift="0", inputs="zwin"):
    nulls = " + ".join(f"count(*) FILTER ({c} IS NULL OR isnan({c}))" for c in CHANNELS)
    off = lambda cond: " + ".join(f"(SELECT CASE WHEN {cond(f)} THEN 1 ELSE 0 END FROM zfeat WHERE split = 'train')" for f in SCALED)
    mean = lambda f: f"abs(avg({f} + {shift if f == 'u10' else 0})) > 0.1"
    return f"""
  SELECT 'null_inputs' AS "check", {nulls} AS detail FROM {inputs}
  UNION ALL SELECT 'null_targets', count(*) FILTER (y IS NULL OR isnan(y)) FROM {lng}
  UNION ALL SELECT 'negative_targets', count(*) FILTER (y < 0) FROM {lng}
  UNION ALL SELECT 'feature_count', CAST(abs({len(CHANNELS)} - ({len(FEATURES) - len(SCALED)} + (SELECT count(*) FROM norm WHERE std <> 0) + (SELECT count(*) FROM wstat)))
    + (SELECT count(*) FROM (SELECT count(*) AS n FROM zwin GROUP BY series_id, slot_utc) WHERE n <> 48) AS BIGINT)
  UNION ALL SELECT 'mean_range', CAST({off(mean)} AS BIGINT)
  UNION ALL SELECT 'std_range', CAST({off(lambda f: f"stddev_pop({f}) NOT BETWEEN 0.9 AND 1.1")} AS BIGINT)
  UNION ALL SELECT 'leaked_series', count(DISTINCT series_id) FROM anc WHERE split <> 'train' AND series_id IN (SELECT series_id FROM anc WHERE split = 'train')"""


register_table("chk", "anc lng zfeat zwin norm wstat", _checks_sql())
register_table("lnghurt", "lng", "SELECT * EXCLUDE (y), CASE WHEN lead = 1 AND series_id % 3 = 0 THEN -1 WHEN lead = 2 AND series_id % 5 = 0 THEN NULL ELSE y END AS y FROM lng")
register_table("zhurt", "zwin", "SELECT * REPLACE (CASE WHEN step = 3 AND series_id % 7 = 0 THEN NULL ELSE vpd_kPa END AS vpd_kPa) FROM zwin")
register_table("chkhurt", "anc lnghurt zhurt zfeat zwin norm wstat", _checks_sql("lnghurt", "1", "zhurt"))


def _built(spark, d):
    """The store as files: windows and metadata read back, with the scaled rows beside them."""
    panel, lay, scaling = dataset(spark, d)
    path = stage_path(spark)
    writers.write_samples(D.scaled_windows(panel, scaling, lay), path, in_order=True)
    writers.write_metadata(spark, path, scaling.params | scaling.wind, scaling.channels)
    names = readers.read_metadata(spark, path).first()["feature_names"]  # one row: channel names
    rows = cut(D.scaled_rows(panel, scaling, lay).select("split", *scaling.params))
    return readers.read_samples(spark, path), rows, names, list(scaling.params)


@query("build_checks", "C8 J4", sql("chk", 'SELECT "check", detail = 0 AS passed, detail FROM chk'))
def _(spark, d):
    windows, rows, names, scaled_names = _built(spark, d)
    return R.build_checks(windows, rows, names, scaled_names)


@query("build_checks_of_damaged", "C8", sql("chkhurt", 'SELECT "check", detail = 0 AS passed, detail FROM chkhurt'))
def _(spark, d):
    """The same over a store with some targets, inputs and one scaling broken."""
    windows, rows, names, scaled_names = _built(spark, d)
    s = F.col("series_id")
    hurt = windows.withColumns({
        "targets": F.transform("targets", lambda y, i: F.when((i == 0) & (s % 3 == 0), -1.0).when(~((i == 1) & (s % 5 == 0)), y)),
        "inputs": F.when(s % 7 != 0, F.col("inputs")).otherwise(
            F.transform("inputs", lambda x, i: x.withField("vpd_kPa", F.when(i != 3, x["vpd_kPa"]))))})
    return R.build_checks(hurt, rows.withColumn("u10", F.col("u10") + 1.0), names, scaled_names)


def _evidence_sql(damaged=False):
    y = "lnghurt" if damaged else "lng"
    spots = _alignment_sql("(x.targets[1] + CASE WHEN x.series_id % 3 = 0 THEN 1 ELSE 0 END)" if damaged else "x.targets[1]")
    drift = " + ".join(f"(SELECT CASE WHEN abs(avg({f})) <= 0.15 AND stddev_pop({f}) BETWEEN 0.85 AND 1.15 THEN 0 ELSE 1 END FROM zcell WHERE asplit = 'train')" for f in _drift)
    rows = [
        ("coverage", "undocumented", "(SELECT count(*) FROM cat LEFT JOIN nrows n ON n.series_id = cat.series_id WHERE coalesce(n.k, 0) = 0 AND coalesce(n.n, 0) < 0)", True),
        ("coverage", "series_without_windows", "(SELECT count(*) FROM cat WHERE series_id NOT IN (SELECT series_id FROM anc))", False),
        ("leakage", "cross_split", "(SELECT count(*) FROM (SELECT series_id FROM anc GROUP BY 1 HAVING count(DISTINCT split) > 1))", True),
        ("leakage", "start_gaps", "(SELECT count(*) FROM sgap)", False),
        ("integrity", "n_nan", "(SELECT sum(n_nan) FROM icell)", True),
        ("integrity", "n_inf", "(SELECT sum(n_inf) FROM icell)", True),
        ("integrity", "constant", "(SELECT count(*) FROM icell WHERE is_constant)", True),
        ("integrity", "n_extreme", "(SELECT sum(n_extreme) FROM icell)", False),
        ("targets", "n_null", f"(SELECT count(*) FROM {y} WHERE y IS NULL OR isnan(y))", True),
        ("targets", "n_negative", f"(SELECT count(*) FROM {y} WHERE y < 0)", True),
        ("drift", "mismatches", f"({drift})", True),
        ("alignment", "targets", f"(SELECT count(*) FROM ({spots}) WHERE NOT target_ok)", True),
        ("alignment", "inputs", f"(SELECT count(*) FROM ({spots}) WHERE NOT input_ok)", True),
        ("tiers", "missing_tiers", """(SELECT count(*) FROM (VALUES ('high'), ('medium'), ('low')) t(x)
          WHERE x NOT IN (SELECT intensity_tier FROM anc JOIN cat ON cat.series_id = anc.series_id WHERE anc.split = 'train'))""", True),
    ]
    return "\n  UNION ALL ".join(
        f"""SELECT '{c}' AS "check", '{i}' AS item, CAST({e} AS BIGINT) AS detail, {f'CAST({e} AS BIGINT) = 0' if m else 'true'} AS passed""" for c, i, e, m in rows)


register_table("nrows", "win", "SELECT series_id, count(*) AS n, count(*) FILTER (is_anchor) AS k FROM win GROUP BY 1")
_needs = "nrows cat anc sgap icell lng zcell rebuilt zfeat"
register_table("evd", _needs, _evidence_sql())
register_table("evdhurt", _needs + " lnghurt", _evidence_sql(True))
_verdict = """SELECT bool_and(passed) AS ready, coalesce(string_agg(DISTINCT "check", ',' ORDER BY "check") FILTER (NOT passed), '') AS failed FROM """


def _evidence(spark, d, damage=None):
    rows, scaling, lay = scaled(spark, d)
    rows = damage(rows) if damage else rows
    return R.evidence(rows, aligned(spark, d, rows, scaling, lay), src.catalogue(spark, d), scaling.features, lay)


def _broken(rows):
    s = F.col("series_id")
    return rows.withColumn("targets", F.transform("targets", lambda y, i: F.when((i == 0) & (s % 3 == 0), -1.0).when(~((i == 1) & (s % 5 == 0)), y)))


@query("readiness_evidence", "C10 C1 C2 C3 C4 C5 C6 C7", sql("evd", "SELECT * FROM evd"))
def _(spark, d):
    return _evidence(spark, d)


@query("readiness_verdict", "C10", sql("evd", _verdict + "evd"))
def _(spark, d):
    return R.verdict(_evidence(spark, d))


@query("readiness_verdict_of_damaged", "C10", sql("evdhurt", _verdict + "evdhurt"))
def _(spark, d):
    return R.verdict(_evidence(spark, d, _broken))
