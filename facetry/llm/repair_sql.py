"""The repair of damaged conversations as SQL: the same layers as a recursive query, a struct (cost, audit, text) for each state."""

from __future__ import annotations

_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: unicode(ch)::BIGINT)), lambda a, b: xor(a >> 8, bits[(xor(a, b) & 255) + 1]))"""


def least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w.c IS NOT NULL))[1]"


def way(of: str, cost: str, letter: str, line: str | None = None) -> str:
    text = f"{of}.t" if line is None else f"{of}.t || CASE WHEN {of}.t = '' THEN '' ELSE chr(10) END || {line}"
    return f"{{'c': {of}.c + {cost}, 'a': {of}.a || '{letter}', 't': {text}}}"


def only(test: str, of: str) -> str:
    return f"CASE WHEN {test} THEN {of} END"


def report_sql() -> str:
    """States: x0 nothing told, x1 a system row, x2 a user's last, x3 an assistant's last; u and y after inserted rows."""
    user, both = "'user:'", "'user:' || chr(10) || 'assistant:'"
    kept, cut = "role || ':' || text", "CASE WHEN cut THEN 3 ELSE 0 END"
    stays = lambda of, letter, cost, line: only("NOT gone", way(of, f"{cost} + {cut}", letter, line))
    keep = lambda of, initial: only(f"NOT gone AND ini = '{initial}'", way(of, cut, "K", kept))
    as_user, as_assistant = "'user:' || text", "'assistant:' || text"
    start = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    none = "{'c': NULL::BIGINT, 'a': NULL::VARCHAR, 't': NULL::VARCHAR}"
    u = least("x2", way("x0", "3", "I", user), way("x1", "3", "I", user), way("x3", "3", "I", user))
    y = least("x3", way("x2", "3", "I", "'assistant:'"), way("x0", "6", "II", both), way("x1", "6", "II", both))
    return rf"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS bits),
hit AS (SELECT src.*, xor({_CRC}, 4294967295) % 20 AS hit FROM src, crc),
dam AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit WHERE hit <> 0),
ord AS (SELECT conv_id, turn, role, text, left(role, 1) AS ini, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM dam),
rep AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM ord),
flt AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair FROM rep),
rws AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, fault = 'truncated' AS cut FROM flt),
cnt AS (SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rws GROUP BY conv_id),
lay AS (SELECT conv_id, 0::BIGINT AS pos, {start} AS x0, {none} AS x1, {none} AS x2, {none} AS x3 FROM cnt
  UNION ALL SELECT conv_id, pos, {least(way("x0", "4", "D"))}, {least(way("x1", "4", "D"), keep("x0", "s"))},
  {least(way("u", "4", "D"), *(keep(q, "u") for q in ("x0", "x1", "y")), *(stays(q, "R", "3", as_user) for q in ("x0", "x1", "y")))},
  {least(way("y", "4", "D"), keep("u", "a"), stays("u", "R", "3", as_assistant))}
  FROM (SELECT rws.*, x0, x1, {u} AS u, {y} AS y FROM lay JOIN rws ON rws.conv_id IS NOT DISTINCT FROM lay.conv_id AND rws.pos = lay.pos + 1)),
fin AS (SELECT cnt.*, {least("x0", "x3", way("x2", "3", "I", "'assistant:'"), way("x1", "6", "II", both))} AS best FROM cnt JOIN lay ON lay.conv_id IS NOT DISTINCT FROM cnt.conv_id AND lay.pos = cnt.n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM c.conv_id"""
