"""DuckDB SQL written apart from the rules, for queries whose Spark form DuckDB can't run and
for the most used ones, so that agreement says more than that two engines run one text."""

from __future__ import annotations

_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SOLID = _WS.replace("[", "[^", 1)
_LINE = """(least(x.b, y.b) - greatest(x.t, y.t) >= 0.35 * greatest(least(x.b - x.t, y.b - y.t), 0.01)
  OR abs(x.t + x.b - y.t - y.b) / 2 <= 0.3 * greatest(x.b - x.t, y.b - y.t, 0.01))"""

ORACLES = {
    "exact_tokens": rf"""
SELECT doc_id, count(*) AS n_tokens, CAST(sum(a) AS BIGINT) AS sum_start, CAST(sum(a + length(regexp_replace(piece, '{_WS}+$', ''))) AS BIGINT) AS sum_end, CAST(sum(a + length(piece)) AS BIGINT) AS sum_actual_end, max(a + length(piece)) AS last_end
FROM (SELECT doc_id, piece, lead + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
      FROM (SELECT doc_id, length(regexp_extract(text, '^{_WS}+')) AS lead, unnest(regexp_extract_all(text, '{_SOLID}+{_WS}*')) AS piece, generate_subscripts(regexp_extract_all(text, '{_SOLID}+{_WS}*'), 1) AS i FROM documents WHERE text IS NOT NULL))
GROUP BY doc_id""",
    "fidelity_gate": """
WITH pages AS (SELECT a.label AS doc, CASE WHEN a.vec_id % 2 = 0 THEN 72 ELSE 150 END AS dpi, list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))) AS diffs
               FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
worst AS (SELECT doc, dpi, max(list_sum(diffs) / len(diffs)) AS mean, max(len(list_filter(diffs, lambda x: x > 0.2)) / len(diffs)) AS share FROM pages GROUP BY doc, dpi),
limits(dpi, most) AS (VALUES (72, 0.06), (150, 0.052))
SELECT w.doc, (SELECT count(*) FROM worst v WHERE v.doc = w.doc) AS resolutions, round((SELECT max(mean) FROM worst v WHERE v.doc = w.doc), 9) AS worst_mean,
       (SELECT count(*) FROM worst v JOIN limits m ON m.dpi = v.dpi WHERE v.doc = w.doc AND v.mean <= m.most AND v.share <= 0.25) = 2 AS within_tolerance
FROM (SELECT DISTINCT doc FROM worst) w""",
    "transformation_audit": r"""
WITH RECURSIVE own AS (SELECT * FROM changes WHERE role <> 'Figure'),
walk(id, nth, pos, rebuilt, visible, accessible) AS (
  SELECT id, 0, CAST(0 AS BIGINT), '', min(visible), min(accessible) FROM own GROUP BY id
  UNION ALL
  SELECT w.id, c.nth, CASE WHEN coalesce(c.s0 + c.s1 + c.t0 + c.t1, -1) < 0 OR c.s0 < w.pos THEN w.pos ELSE c.s1 END,
         CASE WHEN coalesce(c.s0 + c.s1 + c.t0 + c.t1, -1) < 0 OR c.s0 < w.pos THEN w.rebuilt ELSE w.rebuilt || substring(w.visible, w.pos + 1, c.s0 - w.pos) || c.replacement END, w.visible, w.accessible
  FROM walk w JOIN own c ON c.id = w.id AND c.nth = w.nth + 1),
seen AS (SELECT c.*, w.pos AS before, c.s0 IS NULL OR c.s1 IS NULL OR c.t0 IS NULL OR c.t1 IS NULL AS lacks FROM own c JOIN walk w ON w.id = c.id AND w.nth = c.nth - 1),
errors AS (
  SELECT id, 'formula_incomplete' AS error FROM seen WHERE kind = 'formula_spoken_equivalent' AND (trim(source) = '' OR trim(replacement) = '')
  UNION ALL SELECT id, 'lacks_spans' FROM seen WHERE lacks
  UNION ALL SELECT id, 'overlap' FROM seen WHERE NOT lacks AND s0 < before
  UNION ALL SELECT id, 'source_mismatch' FROM seen WHERE NOT lacks AND s0 >= before AND substring(visible, s0 + 1, greatest(s1 - s0, 0)) <> source
  UNION ALL SELECT id, 'target_mismatch' FROM seen WHERE NOT lacks AND s0 >= before AND substring(accessible, t0 + 1, greatest(t1 - t0, 0)) <> replacement
  UNION ALL SELECT id, 'not_rebuilt' FROM (SELECT id, max_by(rebuilt || substring(visible, pos + 1), nth) AS got, min(accessible) AS want FROM walk GROUP BY id) WHERE got <> want)
SELECT id, error, count(*) AS n FROM errors GROUP BY id, error""",
    "anomaly_report": r"""
WITH e AS (SELECT *, printf('p%04d-e%04d', page_number, ord) AS element_id FROM elements),
r AS (
  SELECT doc_id, page_number, NULL AS element_id, NULL AS role, 'warning' AS severity, 'page' AS category, message, '' AS chosen, -1.0 AS measure, [1, 0, nth] AS place FROM ambiguities
  UNION ALL SELECT doc_id, page_number, NULL, NULL, severity, category, message, coalesce(chosen, ''), -1, [2, 0, nth] FROM page_findings
  UNION ALL SELECT doc_id, page_number, e.element_id, e.role, severity, category, message, coalesce(chosen, ''), -1, [3, ord, nth] FROM element_findings JOIN e USING (doc_id, page_number, ord)
  UNION ALL SELECT doc_id, page_number, element_id, role, 'warning', 'low_confidence', 'One or more confidence dimensions are below threshold.', left(text, 300), conf, [3, ord, 1000000000] FROM e WHERE conf < 0.8
  UNION ALL SELECT doc_id, page_number, NULL, NULL, 'info', 'model_disagreement', 'The proposal and canonical review differ materially on this page.', '', min(agree), [4, 0, 0] FROM e GROUP BY doc_id, page_number HAVING min(agree) < 0.9),
n AS (SELECT * EXCLUDE message, trim(regexp_replace(message, '\s+', ' ', 'g')) AS message FROM r)
SELECT doc_id, page_number, element_id, severity, category, message, role, chosen, CAST(measure AS DOUBLE) AS measure
FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, element_id, severity, category, message ORDER BY place) = 1""",
    "page_transcripts": """
SELECT doc_id, page_number, count(*) AS n_elements, array_to_string(list(printf('[%s] %s', role, text) ORDER BY ord), chr(10) || chr(10)) AS transcript FROM elements GROUP BY ALL""",
    "region_collisions": f"""
WITH boxes AS (SELECT doc_id, page_number, ord, CAST((ord * 37) % 500 AS DOUBLE) AS l, t - ord % 3 * 4 AS t, CAST((ord * 37) % 500 + 120 + ord % 5 * 60 AS DOUBLE) AS r, b + ord % 2 * 6 AS b FROM elements)
SELECT x.doc_id, x.page_number, x.ord AS left_ord, y.ord AS right_ord FROM boxes x, boxes y
WHERE x.doc_id = y.doc_id AND x.page_number = y.page_number AND x.ord < y.ord AND {_LINE}
  AND least(x.r, y.r) - greatest(x.l, y.l) > greatest(1, 0.05 * greatest(least(x.r - x.l, y.r - y.l), 0.01))""",
    "table_grid_completion": """
WITH cells AS (SELECT DISTINCT l_orderkey AS table_id, l_partkey % 3 AS row_no, l_linenumber % 4 AS col_no FROM lineitem),
slots AS (SELECT table_id, row_no, CAST(c AS BIGINT) AS col_no FROM (SELECT DISTINCT table_id, row_no FROM cells) JOIN (SELECT table_id, max(col_no) AS last FROM cells GROUP BY table_id) USING (table_id), range(4) t(c) WHERE c <= last)
SELECT table_id, row_no, col_no, row_number() OVER (PARTITION BY table_id ORDER BY row_no, col_no) AS cell_ord, (table_id, row_no, col_no) NOT IN (SELECT (table_id, row_no, CAST(col_no AS BIGINT)) FROM cells) AS added FROM slots""",
    "words_in_fragment": """
WITH w AS (SELECT doc_id, page_number, ord, t, b, len(s) AS n, unnest(s) AS word, generate_subscripts(s, 1) AS i FROM (SELECT *, string_split(text, ' ') AS s FROM elements)),
c AS (SELECT doc_id, page_number, ord, (t + b) / 2 AS y, (1000.0::DOUBLE * (i - 1) / n + 1000.0::DOUBLE * i / n) / 2 AS x FROM w WHERE word <> '')
SELECT e.doc_id, e.page_number, e.ord, count(*) AS n_words, count_if(c.ord = e.ord) AS n_own FROM elements e JOIN c ON c.doc_id = e.doc_id AND c.page_number = e.page_number
WHERE c.x >= e.l - 3 AND c.x <= e.r + 3 AND c.y >= e.t - 3 AND c.y <= e.b + 3 GROUP BY ALL""",
    "fragment_regions": """
WITH RECURSIVE f AS (SELECT * FROM fragments),
near AS (SELECT x.doc_id, x.page_number, x.ord, x.nth AS a, y.nth AS z FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.page_number = y.page_number AND x.ord = y.ord
         WHERE greatest(x.l, y.l) - least(x.r, y.r) <= 12 AND greatest(x.t, y.t) - least(x.b, y.b) <= 12),
reach(doc_id, page_number, ord, nth, seen) AS (SELECT doc_id, page_number, ord, nth, nth FROM f UNION SELECT r.doc_id, r.page_number, r.ord, r.nth, n.z FROM reach r JOIN near n ON n.doc_id = r.doc_id AND n.page_number = r.page_number AND n.ord = r.ord AND n.a = r.seen)
SELECT doc_id, page_number, ord, nth, min(seen) AS region FROM reach GROUP BY ALL""",
    "release_gate": """
WITH status AS (SELECT doc_id, bool_and((page_id + ord) % 40 <> 0) AS plan_approved FROM elements GROUP BY doc_id),
critical AS (SELECT doc_id, count(*) AS n FROM element_findings WHERE severity = 'critical' GROUP BY doc_id),
names AS (SELECT unnest(['visual_match', 'source_visual_fidelity_ok', 'page_count_match', 'qpdf_ok', 'structure_matches_plan', 'fully_tagged', 'page_labels_present', 'transformations_valid', 'block_plan_valid', 'form_fields_preserved', 'form_descriptions_match_plan', 'form_accessibility_policy_ok', 'extraction_compatible', 'declares_pdfua', 'remediation_metadata_valid', 'verapdf_pdfua_ok']) AS name, generate_subscripts(range(16), 1) AS i),
bad AS (
  SELECT doc_id, name, i FROM status CROSS JOIN names WHERE (doc_id, name) NOT IN (SELECT (doc_id, name) FROM checks WHERE ok)
  UNION ALL SELECT doc_id, 'plan_approved', 17 FROM status WHERE NOT plan_approved
  UNION ALL SELECT doc_id, 'critical_findings', 18 FROM critical)
SELECT s.doc_id, coalesce(any_value(c.n), 0) AS critical, count(b.name) = 0 AS released, coalesce(string_agg(b.name || ';', '' ORDER BY b.i), '') AS failing
FROM status s LEFT JOIN bad b USING (doc_id) LEFT JOIN critical c USING (doc_id) GROUP BY s.doc_id""",
}
