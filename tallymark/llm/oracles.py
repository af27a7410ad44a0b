"""SQL that the queries of newer operators agree with, where a hash has to be spelled out."""

from __future__ import annotations

#: The table of crc32, a row with one list: fixed values, by rule.
CRC = """
tab AS (SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab)
"""


def crc(text: str) -> str:
    """crc32 of a text whose characters end at U+07FF, in SQL; ``tab`` is the table of all bytes."""
    octets = f"""flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT]
        ELSE [192 + (ord(c)::BIGINT >> 6), 128 + (ord(c)::BIGINT & 63)] END))"""
    return f"xor(list_reduce([4294967295] || {octets}, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


SPELLING_VARIANTS = f"""
WITH RECURSIVE {CRC.strip()}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), held AS (
  SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, k, {crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM held, tab
), w AS (
  SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND n >= 3
), parts AS (
  SELECT word, 0 AS pos, word AS part FROM w
  UNION ALL SELECT word, pos, substring(word, 1, pos - 1) || substring(word, pos + 1) FROM (SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM w)
), near AS (
  SELECT DISTINCT a.word, b.word AS other FROM parts a JOIN parts b USING (part) WHERE a.word <> b.word AND (a.pos = b.pos OR a.pos = 0 OR b.pos = 0)
), best AS (
  SELECT near.word, count(*) AS n_near, min({{'n': -w.n, 'other': other}}) AS best FROM near JOIN w ON w.word = other GROUP BY near.word
), f AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * w.n THEN best.other END AS form, CASE WHEN -best.n >= 2 * w.n THEN -best.n END AS form_n
  FROM w LEFT JOIN best USING (word)
), r AS (
  SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word
)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)
"""

CONVERSATION_REPAIR = rf"""
WITH RECURSIVE {CRC.strip()}, plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, tab
), copies AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM plain WHERE kind <> 0
), lined AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM copies
), marked AS (
  SELECT conv_id, turn, role, text, i, role[1:1] AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM lined
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id
), ways AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS state, {{'cost': 0::BIGINT, 'audit': '', 'turns': []::VARCHAR[]}} AS way FROM figures
  UNION ALL
  SELECT conv_id, i, o.state AS state, min(o.way) AS way FROM (
    SELECT conv_id, i, unnest([
        {{'state': state, 'way': {{'cost': cost + 2, 'audit': audit || 'D', 'turns': turns}}}},
        {{'state': CASE WHEN fault NOT IN ('blank', 'duplicate') AND (initial = due OR initial = 's' AND state = '') THEN initial END,
          'way': {{'cost': cost + extra, 'audit': audit || 'K', 'turns': turns || [role || ':' || text]}}}},
        {{'state': CASE WHEN fault NOT IN ('blank', 'duplicate') THEN due END,
          'way': {{'cost': cost + 1 + extra, 'audit': audit || 'R', 'turns': turns || [CASE due WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]}}}}]) AS o
    FROM (
      SELECT s.conv_id, m.i, s.state, s.cost, s.audit, s.turns, m.role, m.text, m.initial, m.fault, CASE m.fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra,
             CASE s.state WHEN 'u' THEN 'a' ELSE 'u' END AS due
      FROM (
        SELECT conv_id, i, state, way.cost AS cost, way.audit AS audit, way.turns AS turns FROM ways
        UNION ALL SELECT conv_id, i, CASE state WHEN 'u' THEN 'a' ELSE 'u' END, way.cost + 5, way.audit || 'I',
                         way.turns || [CASE state WHEN 'u' THEN 'assistant:' ELSE 'user:' END] FROM ways
      ) s JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.i = s.i + 1)
  ) WHERE o.state IS NOT NULL GROUP BY conv_id, i, o.state
), ends AS (
  SELECT conv_id, min(way) AS way FROM (
    SELECT w.conv_id, w.i, state, way FROM ways w
    UNION ALL SELECT conv_id, i, CASE state WHEN 'u' THEN 'a' ELSE 'u' END,
                     {{'cost': way.cost + 5, 'audit': way.audit || 'I', 'turns': way.turns || [CASE state WHEN 'u' THEN 'assistant:' ELSE 'user:' END]}} FROM ways
  ) e JOIN figures f USING (conv_id) WHERE e.i = f.n AND state IN ('', 'a') GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0) AS cost, coalesce(way.audit, '') AS audit,
       sha256(coalesce(array_to_string(way.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures USING (conv_id) LEFT JOIN ends USING (conv_id)
"""
