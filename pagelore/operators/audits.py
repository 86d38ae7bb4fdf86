"""Audits: invariants, flows, transformations, forms, structure, gates, manifest, resume."""

from __future__ import annotations

from pagelore.functions.dialect import WORD, WS, Dialect
from pagelore.operators.layout import keyed
from pagelore.operators.text_rules import generic_description
from pagelore.sources.derived import CHECKS

SCHEMA_VERSION, PLAN_REVISION = 7, 11
APPROVED = ("model_reviewed", "manual_modified")
#: Review status of an adapted element.
_STATUS = "CASE (page_id + ord) % 40 WHEN 0 THEN 'proposal' WHEN 1 THEN 'manual_modified' ELSE 'model_reviewed' END"
# Largest mean difference by resolution, and the largest share of material differences.
FIDELITY_MEAN, FIDELITY_SHARE = ((72, 0.06), (150, 0.052)), 0.25
CRITERIA = (
    ("1.1.1", "Non-text Content", None), ("1.3.1", "Info and Relationships", "structure"), ("1.3.2", "Meaningful Sequence", "structure"), ("1.4.3", "Contrast (Minimum)", None), ("1.4.5", "Images of Text", None),
    ("1.4.10", "Reflow", None), ("2.4.2", "Page Titled", "title"), ("2.4.6", "Headings and Labels", None), ("3.1.1", "Language of Page", "language"),
)
NOT_TESTED = ("1.4.3", "1.4.10")

def element_error(d: Dialect) -> str:
    """The first schema rule that an element breaks, or null."""
    cell = "role IN ('TH', 'TD')"
    return f"""CASE WHEN role NOT IN ('Figure', 'TD') AND {d.strip("coalesce(nullif(accessible, ''), visible)")} = '' THEN 'text_required'
      WHEN {cell} AND {d.strip("coalesce(table_id, '')")} = '' THEN 'table_id_required'
      WHEN {cell} AND (row_no IS NULL OR col_no IS NULL) THEN 'position_required'
      WHEN role = 'TH' AND scope IS NULL THEN 'scope_required'
      WHEN role = 'TD' AND scope IS NOT NULL THEN 'scope_forbidden'
      WHEN NOT ({cell}) AND (table_id IS NOT NULL OR row_no IS NOT NULL OR col_no IS NOT NULL OR scope IS NOT NULL) THEN 'table_metadata_forbidden' END"""


def _invariants(d: Dialect) -> str:
    """The first broken rule of every table cell and element, and ids that a page has twice."""
    return f"""SELECT id, error FROM (SELECT id, {element_error(d)} AS error FROM {d.t('cells')}) x WHERE error IS NOT NULL
      UNION ALL SELECT concat(doc_id, '/', element_id) AS id, 'text_required' AS error FROM {keyed(d)} WHERE {d.strip('text')} = ''
      UNION ALL SELECT concat(doc_id, '/', CAST(page_number AS STRING)) AS id, 'duplicate_id' AS error FROM {keyed(d)} GROUP BY doc_id, page_number HAVING count(*) <> count(DISTINCT element_id)"""


def _row_major(d: Dialect) -> str:
    """Cells not after the cell before them in their run, and tables that start again."""
    w = "PARTITION BY page ORDER BY ord"
    runs = f"(SELECT *, sum(CASE WHEN coalesce(lag_id, '') <> coalesce(table_id, '') THEN 1 ELSE 0 END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT *, lag(table_id) OVER ({w}) AS lag_id, coalesce(row_no, 0) AS r, coalesce(col_no, 0) AS c FROM {d.t('cells')}) y)"
    before = "OVER (PARTITION BY page, run ORDER BY ord)"
    return f"""SELECT id, 'row_major' AS error FROM (SELECT id, r, c, lag(r) {before} AS r0, lag(c) {before} AS c0 FROM {runs} r WHERE role IN ('TH', 'TD')) x WHERE r0 > r OR (r0 = r AND c0 >= c)
      UNION ALL SELECT concat(CAST(page AS STRING), '/', table_id) AS id, 'not_consecutive' AS error FROM {runs} r WHERE role IN ('TH', 'TD') AND table_id IS NOT NULL GROUP BY page, table_id HAVING count(DISTINCT run) > 1"""


_FLOWS = [("p1", 1, "b1"), ("p1", 2, "b2"), ("p2", 1, "b1"), ("p2", 2, "b1"), ("p2", 3, "b3"), ("p3", 1, "b2"), ("p3", 2, "b1"), ("p4", 1, "b1")]
_BLOCKS = [("p1", 1, "b1"), ("p1", 2, "b2"), ("p2", 1, "b1"), ("p2", 2, "b2"), ("p3", 1, "b1"), ("p3", 2, "b2"), ("p4", 1, "b1"), ("p4", 2, "b2")]


def _flows(d: Dialect) -> str:
    """Flow ownership of blocks: owned twice, missing, unknown, out of order; and the rebuilt flow."""
    f, b = d.rows("f", "page STRING, ord BIGINT, block STRING", _FLOWS), d.rows("b", "page STRING, ord BIGINT, block STRING", _BLOCKS)
    flow = f"(SELECT page, block, ord FROM {f} UNION ALL SELECT concat(doc_id, '/', CAST(page_number AS STRING)) AS page, element_id AS block, ord + page_number % 2 * CASE WHEN ord = 1 THEN 2 ELSE 0 END AS ord FROM {keyed(d)})"
    block = f"(SELECT page, block, ord FROM {b} UNION ALL SELECT concat(doc_id, '/', CAST(page_number AS STRING)) AS page, element_id AS block, ord FROM {keyed(d)})"
    return f"""SELECT page, bool_or(n > 1) AS owned_twice, bool_or(n = 0) AS missing, bool_or(NOT planned) AS unknown, bool_or(n <> 1 OR NOT planned OR nth <> want) AS rebuilt FROM (
      SELECT coalesce(q.page, k.page) AS page, coalesce(q.n, 0) AS n, k.block IS NOT NULL AS planned, q.nth, k.want FROM
        (SELECT page, block, count(*) AS n, row_number() OVER (PARTITION BY page ORDER BY min(ord), block) AS nth FROM {flow} fl GROUP BY page, block) q FULL OUTER JOIN
        (SELECT page, block, row_number() OVER (PARTITION BY page ORDER BY ord) AS want FROM {block} bl) k ON q.page = k.page AND q.block = k.block) x GROUP BY page"""


def _transformations(d: Dialect) -> str:
    """Errors of declared text changes, element by element in order: what a formula lacks,
    missing or overlapping spans, texts that don't match, and an accessible text that the
    changes don't rebuild. A change that is overlapping or without spans is passed over."""
    lacks = "(x.s0 IS NULL OR x.s1 IS NULL OR x.t0 IS NULL OR x.t1 IS NULL)"
    part = lambda text, a, b: f"substring({text}, CAST({a} + 1 AS INT), CAST(greatest({b} - {a}, 0) AS INT))"
    fold = f"""aggregate(items, named_struct('at', CAST(0 AS BIGINT), 'rebuilt', '', 'errors', CAST(array() AS ARRAY<STRING>)), (acc, x) -> named_struct(
        'at', CASE WHEN {lacks} OR x.s0 < acc.at THEN acc.at ELSE x.s1 END,
        'rebuilt', CASE WHEN {lacks} OR x.s0 < acc.at THEN acc.rebuilt ELSE concat(acc.rebuilt, {part('visible', 'acc.at', 'x.s0')}, x.replacement) END,
        'errors', concat(acc.errors,
          CASE WHEN x.kind = 'formula_spoken_equivalent' AND ({d.strip('x.source')} = '' OR {d.strip('x.replacement')} = '') THEN array('formula_incomplete') ELSE CAST(array() AS ARRAY<STRING>) END,
          CASE WHEN {lacks} THEN array('lacks_spans') WHEN x.s0 < acc.at THEN array('overlap') ELSE concat(
            CASE WHEN {part('visible', 'x.s0', 'x.s1')} <> x.source THEN array('source_mismatch') ELSE CAST(array() AS ARRAY<STRING>) END,
            CASE WHEN {part('accessible', 'x.t0', 'x.t1')} <> x.replacement THEN array('target_mismatch') ELSE CAST(array() AS ARRAY<STRING>) END) END)))"""
    groups = f"(SELECT id, min(visible) AS visible, min(accessible) AS accessible, array_sort(collect_list(named_struct('nth', nth, 's0', s0, 's1', s1, 't0', t0, 't1', t1, 'source', source, 'replacement', replacement, 'kind', kind))) AS items FROM {d.t('changes')} WHERE role <> 'Figure' GROUP BY id)"
    done = f"(SELECT id, accessible, concat(f.rebuilt, substring(visible, CAST(f.at + 1 AS INT))) AS rebuilt, f.errors FROM (SELECT *, {fold} AS f FROM {groups} g) y)"
    return f"SELECT id, error, count(*) AS n FROM (SELECT id, explode(concat(errors, CASE WHEN rebuilt <> accessible THEN array('not_rebuilt') ELSE CAST(array() AS ARRAY<STRING>) END)) AS error FROM {done} z) e GROUP BY id, error"


def _form_policy(d: Dialect) -> str:
    rules = (
        ("missing_name", "tooltip = ''"),
        ("generic_name", f"tooltip <> '' AND {generic_description(d, 'tooltip')}"),
        ("missing_label", "label = ''"),
        ("label_differs", "tooltip <> '' AND label <> '' AND tooltip <> label"),
    )
    return " UNION ALL ".join(f"SELECT doc_id, page, idx, '{e}' AS error FROM {d.t('widgets')} WHERE {c}" for e, c in rules)


def _form_counts(d: Dialect) -> str:
    """Names of parts as widget names, brands as labels."""
    g = generic_description(d, "p_name")
    return f"""SELECT p_brand, count(*) AS widgets, count_if(p_name = '') AS missing_names, count_if({g}) AS generic_names, count_if(p_brand = '') AS missing_labels, count_if(p_name <> p_brand) AS label_mismatches,
      count(*) = count(DISTINCT p_name) AS names_agree FROM {d.t('part')} GROUP BY p_brand"""


_FIELDS = [("w1", "f1", None, None), ("f1", "g1", "name", None), ("g1", None, "applicant", "Tx"), ("w2", "g1", "own", "Btn"), ("c1", "c2", "x", None), ("c2", "c1", "y", None)]


def _fields(d: Dialect) -> str:
    """The nearest inherited type and the qualified name of every field; nations under regions
    stand in for a large hierarchy. Walks stop at a field that they have seen."""
    nodes = f"""SELECT id, parent, part, kind FROM {d.rows('c', 'id STRING, parent STRING, part STRING, kind STRING', _FIELDS)} UNION ALL
      SELECT concat('n', CAST(n_nationkey AS STRING)) AS id, concat('r', CAST(n_regionkey AS STRING)) AS parent, n_name AS part, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS kind FROM {d.t('nation')} UNION ALL
      SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, 'root' AS parent, r_name AS part, r_name AS kind FROM {d.t('region')} UNION ALL SELECT 'root' AS id, NULL AS parent, NULL AS part, 'Root' AS kind"""
    limit = "" if d.name == "duck" else " MAX RECURSION LEVEL 1000"
    return f"""WITH RECURSIVE nodes AS ({nodes}), walk(leaf, here, depth, part, kind, parent, seen){limit} AS (
      SELECT id, id, 0, part, kind, parent, {d.array('id')} FROM nodes UNION ALL
      SELECT w.leaf, n.id, w.depth + 1, n.part, n.kind, n.parent, {d.append('w.seen', 'n.id')} FROM walk w JOIN nodes n ON n.id = w.parent WHERE NOT {d.has('w.seen', 'n.id')})
      SELECT leaf, min_by(kind, CASE WHEN kind IS NOT NULL THEN depth END) AS field_type, {d.agg_join('part', '.', 'depth DESC')} AS qualified, count(*) AS depth FROM walk GROUP BY leaf"""


def _gate(d: Dialect) -> str:
    """Release gate of every document: every check is true (one that is null or absent fails),
    the plan is approved, and no finding is critical."""
    flags = ", ".join(f"bool_or(CASE WHEN name = '{c}' THEN ok END) AS {c}" for c in CHECKS)
    approved = f"(SELECT doc_id, coalesce(bool_and({d.in_(_STATUS, APPROVED)}), TRUE) AS plan_approved FROM {d.t('elements')} GROUP BY doc_id)"
    critical = f"(SELECT doc_id, count(*) AS critical FROM (SELECT doc_id FROM {d.t('page_findings')} WHERE severity = 'critical' UNION ALL SELECT doc_id FROM {d.t('element_findings')} WHERE severity = 'critical') f GROUP BY doc_id)"
    rows = f"(SELECT p.doc_id, p.plan_approved, coalesce(c.critical, 0) AS critical, q.* FROM {approved} p LEFT JOIN (SELECT doc_id AS own_id, {flags} FROM {d.t('checks')} GROUP BY doc_id) q ON q.own_id = p.doc_id LEFT JOIN {critical} c ON c.doc_id = p.doc_id)"
    gates = [(c, c) for c in CHECKS] + [("plan_approved", "plan_approved"), ("critical_findings", "critical = 0")]
    failing = " , ".join(f"CASE WHEN coalesce({c}, FALSE) THEN '' ELSE '{n};' END" for n, c in gates)
    return f"SELECT doc_id, critical, {' AND '.join(f'coalesce({c}, FALSE)' for _, c in gates)} AS released, concat({failing}) AS failing FROM {rows} r"


def _fidelity(d: Dialect) -> str:
    """Vectors as rendered channels: every vector against that of the next id, as pages of two
    resolutions. A page's mean difference and its share of material ones, at their worst, decide."""
    diffs = "zip_with(a.embedding, b.embedding, (x, y) -> abs(CAST(x AS DOUBLE) - CAST(y AS DOUBLE)))"
    pages = f"(SELECT a.label AS doc, CASE WHEN a.vec_id % 2 = 0 THEN 72 ELSE 150 END AS dpi, {diffs} AS diffs FROM {d.t('embeddings')} a JOIN {d.t('embeddings')} b ON b.vec_id = a.vec_id + 1)"
    sums = f"(SELECT doc, dpi, max(aggregate(diffs, CAST(0 AS DOUBLE), (s, x) -> s + x) / size(diffs)) AS worst, max(CAST(size(filter(diffs, x -> x > 0.2)) AS DOUBLE) / size(diffs)) AS worst_share FROM {pages} g GROUP BY doc, dpi)"
    return f"SELECT doc, count(*) AS resolutions, round(max(worst), 9) AS worst_mean, {within_tolerance('dpi', 'worst', 'worst_share')} AS within_tolerance FROM {sums} t GROUP BY doc"


def within_tolerance(dpi: str, mean: str, share: str) -> str:
    """Aggregate over a document's resolutions: all of them measured, none worse than allowed."""
    ok = " ".join(f"WHEN {dpi} = {x} THEN {mean} <= {most} AND {share} <= {FIDELITY_SHARE}" for x, most in FIDELITY_MEAN)
    return f"coalesce(bool_and(CASE {ok} END), FALSE) AND count(DISTINCT CASE WHEN {dpi} IN ({', '.join(str(x) for x, _ in FIDELITY_MEAN)}) AND {mean} IS NOT NULL AND {share} IS NOT NULL THEN {dpi} END) = {len(FIDELITY_MEAN)}"


def _multiset(d: Dialect) -> str:
    """Upper bound of the token agreement of a question and its answer, by counts alone."""
    tok = d.extract_all("lower(text)", rf"[{WORD}]+|[^{WORD}{WS}]")
    side = lambda role, shift: f"(SELECT conv_id, turn + {shift} AS turn, k AS tokens FROM (SELECT conv_id, turn, {tok} AS k FROM {d.t('conversations')} WHERE role = '{role}' AND text IS NOT NULL) s)"
    count = lambda src: f"(SELECT conv_id, turn, token, count(*) AS n FROM {d.explode(src + ' q', 'tokens', 'i', 'token')} e GROUP BY conv_id, turn, token)"
    size = lambda src: f"(SELECT conv_id, turn, {d.size('tokens')} AS n FROM {src} q)"
    u, a = side("user", 1), side("assistant", 0)
    return f"""SELECT x.conv_id, x.turn, CAST(2 AS DOUBLE) * coalesce(c.common, 0) / (x.n + y.n) AS bound FROM {size(u)} x JOIN {size(a)} y ON x.conv_id = y.conv_id AND x.turn = y.turn LEFT JOIN
      (SELECT p.conv_id, p.turn, CAST(sum(least(p.n, q.n)) AS BIGINT) AS common FROM {count(u)} p JOIN {count(a)} q ON p.conv_id = q.conv_id AND p.turn = q.turn AND p.token = q.token GROUP BY p.conv_id, p.turn) c
      ON c.conv_id = x.conv_id AND c.turn = x.turn WHERE x.n > 0 AND y.n > 0"""


def _pending(d: Dialect) -> str:
    anti = "ANTI JOIN" if d.name == "duck" else "LEFT ANTI JOIN"
    return f"SELECT p.page_id FROM {d.t('pages')} p {anti} {d.t('labels')} l ON p.page_id = l.doc_id"


def _titles(d: Dialect) -> str:
    """Most recent titles of a document, a repeated one moving to its last place; five are shown."""
    t = f"(SELECT doc_id, {d.ws_norm('text')} AS title, max(page_number) AS seq FROM {d.t('elements')} WHERE role = 'DocumentTitle' AND {d.ws_norm('text')} <> '' GROUP BY doc_id, {d.ws_norm('text')})"
    return f"SELECT doc_id, title, seq, nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC, title) AS nth FROM {t} q) x WHERE nth <= 5"


def _wcag(d: Dialect) -> str:
    rows = d.rows("c", "criterion STRING, name STRING, basis STRING", CRITERIA)
    docs = f"(SELECT doc_id, bool_or(role = 'DocumentTitle') AS title, min(page_id) % 2 = 0 AS structure, TRUE AS language FROM {d.t('elements')} GROUP BY doc_id)"
    verdict = f"CASE basis WHEN 'structure' THEN CASE WHEN structure THEN 'pass' ELSE 'fail' END WHEN 'title' THEN CASE WHEN title THEN 'pass' ELSE 'fail' END WHEN 'language' THEN CASE WHEN language THEN 'pass' ELSE 'fail' END ELSE CASE WHEN {d.in_('criterion', NOT_TESTED)} THEN 'not_tested' ELSE 'review' END END"
    return f"SELECT doc_id, criterion, name, {verdict} AS result FROM {docs} q CROSS JOIN {rows}"  # nine fixed rows


_MODES = [  # id, requested, encrypted, xfa, qpdf, render, tagged, valid, form errors, ratio, embedded, mapped
    (1, "auto", True, False, True, True, False, None, 0, 1.0, True, True), (2, "auto", False, True, True, True, False, None, 0, 1.0, True, True), (3, "auto", False, False, False, True, False, None, 0, 1.0, True, True),
    (4, "auto", False, False, True, True, True, True, 0, 1.0, True, True), (5, "auto", False, False, True, True, True, True, 2, 1.0, True, True), (6, "auto", False, False, True, True, True, None, 0, 0.5, True, True),
    (7, "pass-through", False, False, True, True, False, None, 0, 1.0, True, True), (8, "facsimile", False, False, True, True, False, None, 0, 1.0, True, True), (9, "native", True, False, True, True, False, None, 0, 1.0, True, True),
    (10, "auto", False, False, True, True, False, None, 0, 0.2, False, True),
]


def mode(d: Dialect) -> tuple[str, str]:
    """(automatic, selected) handling of a document from its preflight columns."""
    by_text = "CASE WHEN embedded AND mapped THEN CASE WHEN ratio >= 0.95 THEN 'native' ELSE 'hybrid' END ELSE 'facsimile' END"
    auto = f"CASE WHEN encrypted OR xfa OR NOT qpdf OR NOT render THEN 'unsupported' WHEN tagged AND coalesce(valid, FALSE) AND form_errors = 0 THEN 'pass-through' ELSE {by_text} END"
    return auto, f"CASE WHEN requested = 'pass-through' AND ({auto}) <> 'pass-through' THEN 'unsupported' WHEN requested = 'auto' OR ({auto}) = 'unsupported' THEN {auto} ELSE requested END"


def _modes(d: Dialect) -> str:
    """Documents by source as files: usable lines are those of 20 characters, fonts by source number."""
    cases = d.rows("c", "id BIGINT, requested STRING, encrypted BOOLEAN, xfa BOOLEAN, qpdf BOOLEAN, render BOOLEAN, tagged BOOLEAN, valid BOOLEAN, form_errors BIGINT, ratio DOUBLE, embedded BOOLEAN, mapped BOOLEAN", _MODES)
    docs = f"""SELECT 1000 + doc_id AS id, 'auto' AS requested, FALSE AS encrypted, FALSE AS xfa, TRUE AS qpdf, TRUE AS render, FALSE AS tagged, CAST(NULL AS BOOLEAN) AS valid, CAST(0 AS BIGINT) AS form_errors,
      coalesce(CAST(count_if(length(text) >= 20) AS DOUBLE) / nullif(count_if(text <> ''), 0), CAST(1 AS DOUBLE)) AS ratio, doc_id % 3 <> 0 AS embedded, doc_id % 5 <> 0 AS mapped FROM {d.t('lines')} GROUP BY doc_id"""
    auto, selected = mode(d)
    return f"SELECT id, {auto} AS automatic_mode, {selected} AS selected_mode FROM (SELECT * FROM {cases} UNION ALL {docs}) x"


def _migration(d: Dialect) -> str:
    """Plans of older schemas: version, least revision, coordinate space, and revoked approval."""
    src = d.t("plans")
    v, rev, st = f"CAST({d.json('plan', 'schema_version')} AS BIGINT)", f"CAST({d.json('plan', 'plan_revision')} AS BIGINT)", d.json("plan", "review_status")
    return f"""SELECT id, {SCHEMA_VERSION} AS schema_version, CASE WHEN v = {SCHEMA_VERSION} THEN coalesce(rev, 1) ELSE greatest(coalesce(rev, 1), 5) END AS plan_revision, CASE WHEN v = {SCHEMA_VERSION} OR v IN (2, 3) THEN st ELSE 'legacy_unreviewed' END AS review_status,
      CASE WHEN v = 2 THEN 'pdf_points' ELSE 'normalized_0_1000' END AS coordinate_space, coalesce(rev, 1) < {PLAN_REVISION} AS needs_refresh FROM (SELECT id, {v} AS v, {rev} AS rev, {st} AS st FROM {src}) x"""


def _approved(d: Dialect) -> str:
    """A plan is approved if it, all its pages and all their elements are (vacuously, if none)."""
    st = _STATUS
    return f"SELECT doc_id, coalesce(bool_and({d.in_(st, APPROVED)}), TRUE) AS approved, count_if(NOT ({d.in_(st, APPROVED)})) AS open_elements FROM {d.t('elements')} GROUP BY doc_id"


QUERIES = {
    "schema_invariants": (("elements", "cells"), _invariants),
    "row_major_violations": (("cells",), _row_major),
    "flow_ownership": (("elements",), _flows),
    "transformation_audit": (("changes",), _transformations),
    "form_policy": (("widgets",), _form_policy),
    "form_counters": (("part",), _form_counts),
    "field_inheritance": (("nation", "region"), _fields),
    "release_gate": (("elements", "checks", "page_findings", "element_findings"), _gate),
    "fidelity_gate": (("embeddings",), _fidelity),
    "multiset_agreement_bound": (("conversations",), _multiset),
    "pending_pages": (("pages", "labels"), _pending),
    "title_history": (("elements",), _titles),
    "wcag_matrix": (("elements",), _wcag),
    "preflight_mode": (("lines",), _modes),
    "plan_migration": (("plans",), _migration),
    "plan_approval": (("elements",), _approved),
}
