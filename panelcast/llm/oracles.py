"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

# The contract's patterns, and the allow-list and windows that the operator documents.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ALLOWED = "(?i:example|placeholder|changeme|your[_-]?(?:key|token|secret)|abcdefghijklmnop|0123456789abcdef)"
ENTROPY = [("entropy_hex", 3, "0-9A-Fa-f", 24, 3_200_000), ("entropy_base64", 4, "A-Za-z0-9+/_=-", 24, 4_000_000)]


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _placed(kind: str, rank: int, pattern: str, keep: str = "true") -> str:
    """Matches of a kind with starts: lengths of the gaps and matches before each, as a running sum."""
    return f"""
  SELECT doc_row, {rank} AS rnk, '{kind}' AS kind, m, i,
    sum(length(g) + length(m)) OVER (PARTITION BY doc_row ORDER BY i) - length(m) AS s
  FROM (SELECT doc_row, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT doc_row, regexp_extract_all(t, {_text(pattern)}) AS ms, string_split_regex(t, {_text(pattern)}) AS gs FROM d)
        WHERE len(ms) > 0)
  QUALIFY {keep}"""


def _entropy(kind: str, rank: int, chars: str, window: int, least_bits: int) -> str:
    """Candidates without what the allow-list cuts out; every window's counts from scratch; qualifying windows merged where they touch."""
    cut = _text(f"[^/=]{{0,40}}{ALLOWED}[^/=]{{0,40}}")
    return f"""
  SELECT doc_row, {rank} AS rnk, '{kind}' AS kind, min(b) AS s, max(b) + {window} AS e FROM (
    SELECT doc_row, b, sum(fresh) OVER (PARTITION BY doc_row ORDER BY b) AS run FROM (
      SELECT doc_row, b, CASE WHEN piece = lag(piece) OVER w AND b - lag(b) OVER w <= {window} THEN 0 ELSE 1 END AS fresh
      FROM (
        SELECT doc_row, b, piece, sum(CAST(round(n * log2(n) * 1000000) AS BIGINT)) AS total FROM (
          SELECT doc_row, s + off AS b, s AS piece, substr(p, off + k, 1) AS ch, count(*) AS n
          FROM (SELECT *, unnest(range(0, length(p) - {window} + 1)) AS off FROM (
              SELECT doc_row, p, s + coalesce(sum(length(p) + length(x)) OVER (PARTITION BY doc_row, i ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
              FROM (SELECT doc_row, i, s, unnest(ps) AS p, unnest(list_concat(xs, [''])) AS x, unnest(range(1, len(ps) + 1)) AS o FROM (
                SELECT *, string_split_regex(m, {cut}) AS ps, regexp_extract_all(m, {cut}) AS xs
                FROM ({_placed(kind, rank, f'[{chars}]{{{window},}}')})))) WHERE length(p) >= {window}),
            (SELECT unnest(range(1, {window} + 1)) AS k)
          GROUP BY ALL)
        GROUP BY ALL HAVING total <= CAST(round({window} * log2({window}) * 1000000) AS BIGINT) - {least_bits * window})
      WINDOW w AS (PARTITION BY doc_row ORDER BY b)))
  GROUP BY doc_row, run"""


SECRETS = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc_row, doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT doc_row, rnk, kind, s, s + length(m) AS e FROM ({_placed("assign", 0, ASSIGN)})
  WHERE length(regexp_extract(m, {_text(ASSIGN)}, 1)) >= 12
  UNION ALL SELECT doc_row, rnk, kind, s, s + length(m) FROM ({_placed("access", 1, ACCESS)}) WHERE length(m) >= 18
  UNION ALL SELECT doc_row, rnk, kind, s, s + length(m) FROM ({_placed("hex", 2, HEX)}) WHERE length(m) >= 16),
found AS (SELECT * FROM base {" ".join(f"UNION ALL {_entropy(*c)}" for c in ENTROPY)}),
per AS (
  SELECT doc_row, count(*) FILTER (rnk = 0) AS n_assign, count(*) FILTER (rnk = 1) AS n_access, count(*) FILTER (rnk = 2) AS n_hex,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rnk, e) FILTER (rnk < 3) AS b,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rnk, e) AS spans
  FROM found GROUP BY doc_row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_row)"""

PERSPECTIVES = """
WITH t AS (
  SELECT conv_id, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS speaker, coalesce(text, '') AS body, turn FROM conversations),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, body) - 1 AS rnk,
    replace(body, '<|im_', '<| im_') || '<|im_end|>' AS said FROM t),
v AS (
  SELECT n.conv_id, p.speaker AS perspective, rnk // 256 AS part, rnk, said, n.speaker = p.speaker AS own,
    '<|im_start|>' || CASE WHEN n.speaker = p.speaker THEN 'assistant' WHEN n.speaker = 'system' THEN 'system'
      ELSE 'user name=' || replace(n.speaker, '<|im_', '<| im_') END || chr(10) AS head
  FROM n JOIN (SELECT DISTINCT conv_id, speaker FROM t WHERE speaker <> 'system') p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
w AS (
  SELECT *, CAST(sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY rnk) AS BIGINT) - 1 AS e FROM v)
SELECT conv_id, perspective, part, CAST(count(*) AS INT) AS n_turns,
  string_agg(head || said || chr(10), '' ORDER BY rnk) AS text,
  coalesce(string_agg(CAST(e - length(said) AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY rnk) FILTER (own), '') AS mask
FROM w GROUP BY conv_id, perspective, part"""
