"""DuckDB SQL of the queries that SQL can express, by plain windows and joins."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the benchmark rule, of a column.
_FOLDED = f"regexp_extract_all(translate(coalesce({{}}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_FOLDED.format('text')} AS ws FROM documents),
b AS (SELECT item_id, {_FOLDED.format('text')} AS ws FROM benchmark),
pat AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS win
        FROM (SELECT *, least(13, len(ws)) AS m FROM b WHERE len(ws) > 0), unnest(range(1, len(ws) - m + 2)) AS t(i)),
spots AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win
        FROM d, (SELECT DISTINCT m FROM pat), unnest(range(1, len(ws) - m + 2)) AS t(i)),
found AS (SELECT doc_id, m, i, item_id FROM spots JOIN pat USING (m, win)),
hit AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT DISTINCT doc_id, m, i FROM found), unnest(range(0, m)) AS t(o) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM d, unnest(range(1, len(ws) - 48)) AS t(i)),
f AS (SELECT win, min(doc_id) AS lo FROM p GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT doc_id, i FROM p JOIN f USING (win) WHERE lo < doc_id), unnest(range(0, 50)) AS t(o)),
k AS (SELECT doc_id, count(*) AS n, string_agg(ws[i], ' ' ORDER BY i) AS kept
      FROM (SELECT doc_id, ws, i FROM d, unnest(range(1, len(ws) + 1)) AS t(i)) ANTI JOIN hit USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_FOLDED.format('text')} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + m - 1], ' ') AS gram
      FROM (SELECT *, least(5, len(ws)) AS m FROM d WHERE len(ws) > 0), unnest(range(1, len(ws) - m + 2)) AS t(i)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM inter i JOIN s u ON u.doc_id = a JOIN s v ON v.doc_id = b WHERE i.n >= 0.8::DOUBLE * (u.n + v.n - i.n) - 1e-9::DOUBLE),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT array_to_string(ws, ' ') AS words, count(*) AS n FROM d WHERE len(ws) > 0 GROUP BY 1)
SELECT d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS class_id, (SELECT count(*) FROM link WHERE a = d.doc_id) AS n_links,
  coalesce((SELECT any_value(n) - 1 FROM c WHERE words = array_to_string(ws, ' ')), 0) AS n_copies FROM d
"""

_SPACED = "coalesce(CAST({} AS VARCHAR), ' ')"
#: CRC-32 of conv_id:turn, bit by bit.
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({_SPACED.format('conv_id')} || ':' || {_SPACED.format('turn')}, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"""

# states: 0 nothing yet, 1 system, 2 user, 3 assistant; ins: turns inserted between two states
CONVERSATIONS = f"""
WITH RECURSIVE h AS (SELECT conv_id, turn, {_SPACED.format('role')} AS role, {_SPACED.format('text')} AS text, {_CRC} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM h, unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS t(copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM (
      SELECT *, row_number() OVER w AS i FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)))),
f AS (SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
        CASE WHEN prev IS NOT NULL AND left(prev, 1) || '>' || left(role, 1) NOT IN ('s>u', 'u>a', 'a>u') THEN 1 ELSE 0 END AS bad FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
      count(*) FILTER (fault = 3) AS truncated, sum(bad) AS illegal FROM f GROUP BY 1),
ins(a, b, k) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
t(conv_id, i, state, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 0, 0, '', CAST([] AS VARCHAR[]) FROM n
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT t.conv_id, t.i + 1 AS i, e.state, t.cost + 2 * k + e.cost AS cost, t.audit || repeat('I', k) || e.edit AS audit,
      t.lines || list_transform(range(CAST(k AS BIGINT)), lambda j: CASE WHEN (t.state = 2) = (j % 2 = 0) THEN 'assistant:' ELSE 'user:' END) || CASE WHEN e.line IS NULL THEN [] ELSE [e.line] END AS lines
    FROM t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i + 1 JOIN ins ON ins.a = t.state, LATERAL (
      SELECT ins.b AS state, 3 AS cost, 'D' AS edit, NULL AS line
      UNION ALL SELECT CASE WHEN ins.b = 2 THEN 3 ELSE 2 END, CASE WHEN fault = 3 THEN 3 ELSE 2 END, 'R', CASE WHEN ins.b = 2 THEN 'assistant:' ELSE 'user:' END || text WHERE fault IN (0, 3)
      UNION ALL SELECT CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE WHEN fault = 3 THEN 1 ELSE 0 END, 'K', role || ':' || text
        WHERE fault IN (0, 3) AND (c = 's' AND ins.b = 0 OR c = 'u' AND ins.b <> 2 OR c = 'a' AND ins.b = 2)) e)
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
z AS (SELECT t.conv_id, cost + 2 * k AS cost, audit || repeat('I', k) AS audit,
        lines || list_transform(range(CAST(k AS BIGINT)), lambda j: CASE WHEN (t.state = 2) = (j % 2 = 0) THEN 'assistant:' ELSE 'user:' END) AS lines
      FROM t JOIN n ON n.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = n.n JOIN ins ON ins.a = t.state AND ins.b IN (0, 3)
      QUALIFY row_number() OVER (PARTITION BY t.conv_id ORDER BY cost + 2 * k, audit || repeat('I', k)) = 1)
SELECT u.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) u LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM u.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM u.conv_id
"""
