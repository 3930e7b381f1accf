"""Ridge regression in SQL, from its definition: matrices per fold, elimination by a recursive query, scores from predictions."""

from __future__ import annotations

from panelcast.registry.base import register_table
from panelcast.schema import AR_RIDGE_FEATURES, HORIZON, RIDGE_ALPHAS, WEATHER_RIDGE_FEATURES

_inputs = AR_RIDGE_FEATURES + WEATHER_RIDGE_FEATURES
register_table("ridgein", "man zfeat anc", f"""
  SELECT m.series_id, m.split, m.slot_utc, a.fire_active, a.pers, a.targets, {', '.join('z.' + f for f in _inputs)},
    CASE WHEN m.split <> 'train' THEN NULL WHEN m.sample_idx < (n % 5) * (n // 5 + 1) THEN m.sample_idx // (n // 5 + 1)
      ELSE n % 5 + (m.sample_idx - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold
  FROM man m, (SELECT count(*) AS n FROM man WHERE split = 'train') t
  JOIN zfeat z ON z.series_id = m.series_id AND z.slot_utc = m.slot_utc JOIN anc a ON a.series_id = m.series_id AND a.slot_utc = m.slot_utc""")


def ridge_tables(kind: str, features: tuple[str, ...], target: str, forecast: str) -> None:
    """``<kind>best`` (lead, alpha, b, w) and ``<kind>p`` (forecasts of all windows). ``target`` and ``forecast`` are expressions over
    a window's value ``y``, its prior ``pers``, and the linear predictor ``lin``."""
    d = len(features)
    xs = ["1", *features]
    ys = [target.replace("y_", f"targets[{k}]") for k in range(1, HORIZON + 1)]
    matrix = "[" + ", ".join("[" + ", ".join(f"sum(CAST(({a}) * ({c}) AS DOUBLE))" for c in [*xs, *ys]) + "]" for a in xs) + "]"
    minus = "list_transform(t.m, lambda r, i: list_transform(r, lambda x, j: x - f.m[i][j]))"
    # Rows and columns of the centred system: the constant is projected out, the penalty stands on the diagonal.
    centred = f"""list_transform(range(1, {d + 1}), lambda i: list_transform(range(1, {d + HORIZON + 1}), lambda j:
        m[i + 1][j + 1] - m[1][i + 1] * m[1][j + 1] / m[1][1] + CASE WHEN i = j THEN alpha ELSE 0 END))"""
    register_table(f"{kind}m", "ridgein", f"SELECT fold, {matrix} AS m FROM ridgein WHERE fold IS NOT NULL GROUP BY 1")
    register_table(f"{kind}sys", f"{kind}m ridgein", f"""
  SELECT s.fold, a.alpha, s.m FROM (
    SELECT -1 AS fold, {matrix} AS m FROM ridgein WHERE fold IS NOT NULL
    UNION ALL SELECT f.fold, {minus} FROM {kind}m f, (SELECT {matrix} AS m FROM ridgein WHERE fold IS NOT NULL) t) s,
    (SELECT CAST(unnest({list(RIDGE_ALPHAS)}) AS DOUBLE) AS alpha) a""")
    register_table(f"{kind}c", f"{kind}sys", f"""
  WITH RECURSIVE elim AS (
    SELECT fold, alpha, m, 0 AS k, {centred} AS a FROM {kind}sys
    UNION ALL
    SELECT fold, alpha, m, k + 1, list_transform(a, lambda r, i: list_transform(r, lambda x, j:
      CASE WHEN i = k + 1 THEN x / a[k + 1][k + 1] ELSE x - r[k + 1] * a[k + 1][j] / a[k + 1][k + 1] END))
    FROM elim WHERE k < {d})
  SELECT fold, alpha, lead, w, (m[1][{d + 1} + lead] - list_sum(list_transform(w, lambda x, i: x * m[1][i + 1]))) / m[1][1] AS b FROM (
    SELECT fold, alpha, m, lead, list_transform(a, lambda r: r[{d} + lead]) AS w
    FROM elim, (SELECT unnest(range(1, {HORIZON + 1})) AS lead) WHERE k = {d})""")
    value = target.replace("y_", "targets[lead]")
    linear = "c.b + " + " + ".join(f"c.w[{i + 1}] * x.{f}" for i, f in enumerate(features))
    register_table(f"{kind}best", f"{kind}c ridgein", f"""
  SELECT c.lead, c.alpha, c.b, c.w FROM {kind}c c JOIN (
    SELECT lead, alpha, row_number() OVER (PARTITION BY lead ORDER BY score DESC, alpha) AS rn FROM (
      SELECT lead, alpha, avg(CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse <= 0 THEN 1 ELSE 0 END) AS score FROM (
        SELECT fold, lead, alpha, sum(pow(v - lin, 2)) AS sse, sum(v * v) - pow(sum(v), 2) / count(*) AS sst FROM (
          SELECT x.fold, c.lead, c.alpha, {value} AS v, {linear} AS lin FROM ridgein x JOIN {kind}c c ON c.fold = x.fold)
        GROUP BY 1, 2, 3) GROUP BY 1, 2)) s ON s.lead = c.lead AND s.alpha = c.alpha AND s.rn = 1 WHERE c.fold = -1""")
    register_table(f"{kind}p", f"{kind}best ridgein", f"""
  SELECT series_id, split, slot_utc, fire_active, pers, lead, y, {forecast} AS pred FROM (
    SELECT x.*, c.lead, x.targets[c.lead] AS y, {linear} AS lin FROM ridgein x, {kind}best c)""")


ridge_tables("lag", AR_RIDGE_FEATURES, "y_", "greatest(lin, 0)")
ridge_tables("weather", WEATHER_RIDGE_FEATURES, "y_", "greatest(lin, 0)")
ridge_tables("residual", AR_RIDGE_FEATURES, "ln(1 + y_) - ln(1 + pers)", "greatest(exp(ln(1 + greatest(pers, 0)) + 0.5 * lin) - 1, 0)")
