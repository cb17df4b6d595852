"""DuckDB SQL for the queries on conversations, written from the definitions."""

from __future__ import annotations

# crc32 of ASCII text: the table of the bytewise algorithm, then a fold over the bytes.
_CRC = """crc_row AS (SELECT n, list_reduce(list_prepend(CAST(n AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x:
   CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) t(n)),
crc_table AS (SELECT list(v ORDER BY n) AS t FROM crc_row)"""


def _crc(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda c:
  CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])))"""


_SPACE = r"\x20\x09-\x0D"


def chats(begin: str, end: str, control: str) -> str:
    """An escaped text is longer by one for each backslash and control string."""
    fixed = len(begin) + len(end) + 2
    lengths = " + ".join(f"length({x}) + length(regexp_replace({x}, '[^\\\\]', '', 'g')) + length(regexp_extract_all({x}, '{control}'))"
                         for x in ("role", "text"))
    return rf"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
whole AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum({fixed} + length(regexp_replace(role, '[^\n]', '', 'g')) + {lengths}) AS formatted FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
 CAST(formatted AS BIGINT) AS formatted_chars FROM whole"""


REPAIR = rf"""WITH RECURSIVE {_CRC},
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
  regexp_replace(text, '[{_SPACE}]', '', 'g') AS ink FROM damaged),
faults AS (SELECT *, left(role, 1) AS ini, CASE WHEN ink = '' THEN 'b'
   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
   WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault FROM placed),
pairs AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM faults),
strings AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
  count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM pairs GROUP BY conv_id),
ahead(i, k, added) AS (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 2, 'I'), (1, 3, 'II'), (2, 3, 'I'), (3, 2, 'I')),
step(ini, i, j) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
edits AS (SELECT i, j, ini, 'K' AS edit, 0 AS price FROM step UNION ALL SELECT i, j, NULL, 'R', 3 FROM step WHERE ini <> 's'
  UNION ALL SELECT i, i, NULL, 'D', 4 FROM range(4) t(i)),
ways AS (SELECT conv_id, 0 AS pos, 0 AS state, struct_pack(cost := 0, audit := '') AS best FROM strings
 UNION ALL SELECT w.conv_id, w.pos + 1, e.j, min(struct_pack(
   cost := w.best.cost + 3 * length(a.added) + e.price + CASE WHEN f.fault = 't' AND edit <> 'D' THEN 3 ELSE 0 END,
   audit := w.best.audit || a.added || e.edit))
  FROM ways w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1 JOIN ahead a ON a.i = w.state
   JOIN edits e ON e.i = a.k AND (edit = 'D' OR (f.fault IN ('k', 't') AND (e.ini IS NULL OR e.ini = f.ini)))
  GROUP BY w.conv_id, w.pos + 1, e.j),
solved AS (SELECT s.conv_id, min(struct_pack(cost := best.cost + 3 * length(e.added), audit := best.audit || e.added)) AS best
  FROM strings s JOIN ways w ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = s.n
  JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) e(state, added) USING (state) GROUP BY s.conv_id),
chars AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS nr FROM solved WHERE best.audit <> ''),
rows_at AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY nr) AS pos FROM chars),
kept AS (SELECT r.conv_id, nr, edit, f.role, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text,
  row_number() OVER (PARTITION BY r.conv_id ORDER BY nr) AS nth,
  max(CASE WHEN edit = 'K' AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY r.conv_id) AS led
  FROM rows_at r LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos AND edit <> 'I' WHERE edit <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY nr) AS whole
  FROM kept GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
 coalesce(illegal, 0) AS illegal, CAST(coalesce(v.best.cost, 0) AS BIGINT) AS cost, coalesce(v.best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN strings s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN solved v ON v.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id"""


TRIE = rf"""WITH {_CRC},
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, sha256(length(role) || ':' || role || text) AS digest, length(regexp_extract_all(text, '[^{_SPACE}]+')) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos FROM own),
ids AS (SELECT conv_id, {_crc("CAST(conv_id AS VARCHAR)")} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM own), crc_table),
rebuilt AS (SELECT i.conv_id, 0 AS part, pos, digest, words FROM ids i JOIN placed p ON p.conv_id = i.base AND pos <= h
 UNION ALL SELECT i.conv_id, 1, pos, digest, words FROM ids i JOIN placed p USING (conv_id) WHERE pos > h),
paths AS (SELECT conv_id, words, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path FROM rebuilt
 WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos) UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
sizes AS (SELECT conv_id, max(depth) AS size FROM paths GROUP BY conv_id),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, left(path, 64 * (depth - 1)) AS parent,
  coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = size), '') AS ends
  FROM paths JOIN sizes USING (conv_id) GROUP BY path, depth),
born AS (SELECT parent AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
full_nodes AS (SELECT n.*, coalesce(b.n, 0) AS n_children FROM nodes n LEFT JOIN born b USING (path)),
sums AS (SELECT p.path, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum(CASE WHEN f.depth > 0 THEN (f.n_convs - 1) * f.words ELSE 0 END) AS saved
  FROM full_nodes f JOIN paths p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.path)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN sums s USING (path) LEFT JOIN nodes u ON f.depth > 0 AND u.path = f.parent"""
