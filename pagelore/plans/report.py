"""The anomaly report: five kinds of records, the first of equal ones kept.

Dedup keeps the record that comes first in report order, by a partial aggregation
(``min_by`` on the order), not a window: a key that repeats on a third of all rows is
combined before the shuffle."""

from __future__ import annotations

from pagelore.functions.dialect import Dialect
from pagelore.operators.layout import keyed

LOW_CONFIDENCE, DISAGREEMENT = 0.8, 0.9


def records(d: Dialect) -> str:
    """All records with their place in the report: page ambiguities, page findings, then element
    by element its findings and a low confidence, and last a page's least agreement."""
    e, none = f"(SELECT * FROM {keyed(d)})", "CAST(NULL AS STRING) AS element_id, CAST(NULL AS STRING) AS role"
    zero = "CAST(0 AS BIGINT)"
    return f"""(SELECT doc_id, page_number, {none}, 'warning' AS severity, 'page' AS category, message, CAST(NULL AS STRING) AS chosen, CAST(NULL AS DOUBLE) AS measure, 1 AS branch, {zero} AS ord, nth FROM {d.t('ambiguities')}
      UNION ALL SELECT doc_id, page_number, {none}, severity, category, message, chosen, NULL AS measure, 2 AS branch, {zero} AS ord, nth FROM {d.t('page_findings')}
      UNION ALL SELECT f.doc_id, f.page_number, e.element_id, e.role, f.severity, f.category, f.message, f.chosen, NULL AS measure, 3 AS branch, f.ord, f.nth FROM {d.t('element_findings')} f JOIN {e} e ON e.doc_id = f.doc_id AND e.page_number = f.page_number AND e.ord = f.ord
      UNION ALL SELECT doc_id, page_number, element_id, role, 'warning' AS severity, 'low_confidence' AS category, 'One or more confidence dimensions are below threshold.' AS message, substring(text, 1, 300) AS chosen, conf AS measure, 3 AS branch, ord, CAST(9223372036854775807 AS BIGINT) AS nth
        FROM {e} a WHERE conf < {LOW_CONFIDENCE}
      UNION ALL SELECT doc_id, page_number, {none}, 'info' AS severity, 'model_disagreement' AS category, 'The proposal and canonical review differ materially on this page.' AS message, NULL AS chosen, min(agree) AS measure, 4 AS branch, {zero} AS ord, {zero} AS nth
        FROM {e} a GROUP BY doc_id, page_number HAVING min(agree) < {DISAGREEMENT})"""


def _report(d: Dialect) -> str:
    key = f"doc_id, page_number, element_id, severity, category, {d.ws_norm('message')}"
    place = d.struct("branch", "ord", "nth")
    return f"SELECT doc_id, page_number, element_id, severity, category, {d.ws_norm('message')} AS message, min(role) AS role, min_by(coalesce(chosen, ''), {place}) AS chosen, min_by(coalesce(measure, -1), {place}) AS measure FROM {records(d)} q GROUP BY {key}"


def _by_page(d: Dialect) -> str:
    """Counts a page, in the order of documents and pages."""
    return f"SELECT doc_id, page_number, count(*) AS n_records, count_if(severity = 'critical') AS n_critical, count_if(severity = 'warning') AS n_warning, count_if(severity = 'info') AS n_info FROM ({_report(d)}) x GROUP BY doc_id, page_number ORDER BY doc_id, page_number"


def _page_text(d: Dialect) -> str:
    """Canonical transcript of every page, in reading order."""
    line = "concat('[', role, '] ', text)"
    return f"SELECT doc_id, page_number, count(*) AS n_elements, {d.agg_join(line, chr(10) + chr(10), 'ord')} AS transcript FROM {d.t('elements')} GROUP BY doc_id, page_number"


def _titles(d: Dialect) -> str:
    """Title of a document: its first title, else its name without underscores."""
    return f"SELECT doc_id, coalesce(min_by(CASE WHEN role = 'DocumentTitle' THEN {d.strip('text')} END, CASE WHEN role = 'DocumentTitle' THEN {d.struct('page_number', 'ord')} END), {d.replace('doc_id', '_', ' ')}) AS title FROM {d.t('elements')} GROUP BY doc_id"


QUERIES = {
    "anomaly_report": (("elements", "ambiguities", "page_findings", "element_findings"), _report),
    "anomalies_by_page": (("elements", "ambiguities", "page_findings", "element_findings"), _by_page),
    "page_transcripts": (("elements",), _page_text),
    "document_titles": (("elements",), _titles),
}
