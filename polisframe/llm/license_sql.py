"""The license scan as DuckDB SQL: every window against every template, without signatures."""

from __future__ import annotations

from polisframe.llm.license_scan import CONTAINMENT, NOTICES, SHINGLE

_VALUES = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in NOTICES)
_SPLIT = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

SCAN_SQL = f"""
WITH t0 AS (SELECT license_id, {_SPLIT.format('notice')} AS w FROM (VALUES {_VALUES}) AS v(license_id, notice)),
t1 AS (SELECT license_id, w, least({SHINGLE}, len(w)) AS width FROM t0 WHERE len(w) > 0),
t2 AS (SELECT DISTINCT license_id, width, array_to_string(w[i:i + width - 1], ' ') AS s
       FROM (SELECT license_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM t1)),
t AS (SELECT license_id, width, s, count(*) OVER (PARTITION BY license_id) AS size FROM t2),
d0 AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
d1 AS (SELECT r, doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d0, (SELECT DISTINCT width FROM t)),
d AS (SELECT r, doc_id, width, i - 1 AS pos, len(w) - width + 1 AS n, array_to_string(w[i:i + width - 1], ' ') AS s FROM d1),
hits AS (SELECT r, doc_id, license_id, size, pos, n, t.s FROM d JOIN t ON d.width = t.width AND d.s = t.s),
starts AS (SELECT DISTINCT r, doc_id, license_id, size, pos - k AS start
           FROM (SELECT *, unnest(range(0, size)) AS k FROM hits) WHERE pos - k BETWEEN 0 AND greatest(n - size, 0)),
shares AS (SELECT s.r, s.doc_id, s.license_id, s.start, count(DISTINCT h.s) / any_value(s.size) AS share
           FROM starts s JOIN hits h ON s.r = h.r AND s.license_id = h.license_id AND h.pos >= s.start AND h.pos < s.start + s.size
           GROUP BY s.r, s.doc_id, s.license_id, s.start)
SELECT doc_id, license_id, count(DISTINCT start) AS windows, max(share) AS best, CAST(min(start) AS BIGINT) AS first_word
FROM shares WHERE share >= {CONTAINMENT} GROUP BY doc_id, license_id
"""
