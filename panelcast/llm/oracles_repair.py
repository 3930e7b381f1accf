"""DuckDB SQL for conversation repair, from its definition: one table of cheapest audits per row read, nothing searched."""

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def crc32(text: str) -> str:
    """The unsigned checksum of ASCII text, bit by bit."""
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
        lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""


def _add(state: str, letter: str, cost: str) -> str:
    """An audit (cost in nine digits, then letters) with one more edit; null stays null."""
    return f"(lpad(CAST(CAST({state}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {state}[10:] || '{letter}')"


def _inserts(s: list[str]) -> list[str]:
    """Least audits at the four places once up to two turns are put in."""
    one = [None, None, f"least({_add(s[0], 'I', '3')}, {_add(s[1], 'I', '3')}, {_add(s[3], 'I', '3')})", _add(s[2], "I", "3")]
    two = [None, None, _add(_add(s[2], "I", "3"), "I", "3"),
           f"least({', '.join(_add(_add(s[q], 'I', '3'), 'I', '3') for q in (0, 1, 3))})"]
    return [s[0], s[1], f"least({s[2]}, {one[2]}, {two[2]})", f"least({s[3]}, {one[3]}, {two[3]})"]


def _step() -> list[str]:
    """The four places after a row: deleted, kept where its initial may come next, or given the role that may come next."""
    p = ["p0", "p1", "p2", "p3"]
    gone = [_add(x, "D", "4") for x in p]
    extra = "CASE WHEN fault = 3 THEN 3 ELSE 0 END"
    may = "fault NOT IN (1, 2)"

    def kept(q: int, initial: str) -> str:
        return f"CASE WHEN {may} AND ini = '{initial}' THEN {_add(p[q], 'K', extra)} END"

    def said(q: int) -> str:
        return f"CASE WHEN {may} THEN {_add(p[q], 'R', f'3 + {extra}')} END"

    return [
        gone[0],
        f"least({gone[1]}, {kept(0, 's')})",
        f"least({gone[2]}, {', '.join(f'{kept(q, chr(117))}, {said(q)}' for q in (0, 1, 3))})",
        f"least({gone[3]}, {kept(2, 'a')}, {said(2)})",
    ]


def _select(exprs: list[str], names: str) -> str:
    return ", ".join(f"{e} AS {names}{i}" for i, e in enumerate(exprs))


REPAIR = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM src)),
hurt AS (
  SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text
  FROM src JOIN ids ON src.conv_id IS NOT DISTINCT FROM ids.conv_id
    CROSS JOIN LATERAL (SELECT unnest(CASE WHEN k = 3 THEN [0, 1] WHEN k = 0 THEN [] ELSE [0] END) AS copy) WHERE k <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM hurt),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, rtrim(text, {WHITE}) AS body FROM numbered),
faults AS MATERIALIZED (
  SELECT c, i, turn, role, text, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS two,
    CASE WHEN body = '' THEN 1 WHEN again THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM placed),
told AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faults GROUP BY c),
walk AS (
  SELECT c, 0 AS i, p0, p1, p2, p3 FROM told, (SELECT {_select(_inserts(["'000000000'", 'CAST(NULL AS VARCHAR)', 'CAST(NULL AS VARCHAR)', 'CAST(NULL AS VARCHAR)']), 'p')})
  UNION ALL
  SELECT c, i, {_select(_inserts(['q0', 'q1', 'q2', 'q3']), 'p')} FROM (
    SELECT walk.c, faults.i, {_select(_step(), 'q')} FROM walk JOIN faults ON faults.c = walk.c AND faults.i = walk.i + 1)),
done AS (SELECT walk.c, least(p0, p3) AS best FROM walk JOIN told ON told.c = walk.c AND told.n = walk.i),
edits AS (
  SELECT c, e, letter, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER w AS place
  FROM (SELECT c, unnest(range(10, length(best) + 1)) AS e, substr(best, e, 1) AS letter FROM done) WINDOW w AS (PARTITION BY c ORDER BY e)),
fresh AS (
  SELECT edits.*, faults.role, faults.text, faults.ini,
    max(CASE WHEN place = 1 AND letter = 'K' AND faults.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY edits.c) AS led
  FROM edits LEFT JOIN faults ON faults.c = edits.c AND faults.i = edits.i AND letter <> 'I'),
mended AS (
  SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY e) AS said
  FROM fresh WHERE letter <> 'D' GROUP BY c)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(best[1:9] AS BIGINT), 0) AS cost, coalesce(best[10:], '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM ids LEFT JOIN told USING (c) LEFT JOIN done USING (c) LEFT JOIN mended USING (c)"""
