"""Structure of a plan against what an output file holds: regions, owners, records, reports."""

from __future__ import annotations

from pagelore.functions.dialect import Dialect
from pagelore.sources.derived import CHECKS

#: Fragments closer than this, across and down, are one region.
PROXIMITY = 12


def near(a: str, b: str) -> str:
    gap = lambda lo, hi: f"greatest(0, greatest({a}.{lo}, {b}.{lo}) - least({a}.{hi}, {b}.{hi}))"
    return f"{gap('l', 'r')} <= {PROXIMITY} AND {gap('t', 'b')} <= {PROXIMITY}"


def _regions(d: Dialect) -> str:
    """The region of every fragment: the first fragment of its element that chains of near ones
    reach. A walk over an element's few fragments; each step is a fold over the array."""
    items = f"(SELECT doc_id, page_number, ord, array_sort(collect_list(named_struct('nth', nth, 'text', text, 'l', l, 't', t, 'r', r, 'b', b))) AS f FROM {d.t('fragments')} GROUP BY doc_id, page_number, ord)"
    low = "transform(f, (x, i) -> aggregate(arrays_zip(f, s), s[i], (m, z) -> CASE WHEN {near} THEN least(m, z.s) ELSE m END))".replace("{near}", near("x", "z.f"))
    rounds = f"aggregate(sequence(1, size(f)), transform(f, x -> x.nth), (s, k) -> {low})"
    return f"SELECT doc_id, page_number, ord, v.z.f.nth AS nth, v.z.label AS region FROM (SELECT doc_id, page_number, ord, arrays_zip(f, label) AS zs FROM (SELECT *, {rounds} AS label FROM {items} g) q) w LATERAL VIEW explode(zs) v AS z"


def _wrong_owners(d: Dialect) -> str:
    """Marked content that the tree doesn't reference, references to none, and content whose owner isn't the one that references it."""
    cell = f"(SELECT doc_id, page_number, ord, role FROM {d.t('elements')})"
    marked, tree = f"(SELECT * FROM {cell} a WHERE ord % 7 <> 0)", f"(SELECT * FROM {cell} b WHERE ord % 5 <> 0)"
    owner = f"(SELECT doc_id, page_number, ord, CASE WHEN ord % 6 = 0 THEN 'P' ELSE role END AS role FROM {cell} c)"
    on = lambda x, y: f"{x}.doc_id = {y}.doc_id AND {x}.page_number = {y}.page_number AND {x}.ord = {y}.ord"
    anti = "ANTI JOIN" if d.name == "duck" else "LEFT ANTI JOIN"
    return f"""SELECT m.doc_id, m.page_number, m.ord, 'unreferenced' AS error FROM {marked} m {anti} {tree} s ON {on('m', 's')} UNION ALL SELECT s.doc_id, s.page_number, s.ord, 'missing' AS error FROM {tree} s {anti} {marked} m ON {on('m', 's')}
      UNION ALL SELECT s.doc_id, s.page_number, s.ord, 'wrong_owner' AS error FROM {tree} s JOIN {owner} o ON {on('o', 's')} WHERE o.role <> s.role"""


def _records(d: Dialect) -> str:
    """Structure records against planned elements, both as running text of a page: records that
    cross an element's border, that stand for no element, or whose role differs, and elements that none stands for."""
    page = d.idiv(d.idiv("record_ord", "2"), "1000000")
    runs = f"(SELECT doc_id, {page} AS page_number, record_ord, role, text, CAST(length(text) AS BIGINT) AS n, sum(CAST(length(text) AS BIGINT)) OVER (PARTITION BY doc_id, {page} ORDER BY record_ord) AS z FROM {d.t('records')})"
    own = f"(SELECT doc_id, page_number, ord, role, accessible_text AS text, CAST(length(accessible_text) AS BIGINT) AS n, sum(CAST(length(accessible_text) AS BIGINT)) OVER (PARTITION BY doc_id, page_number ORDER BY ord) AS z FROM {d.t('planned')})"
    met = f"""(SELECT r.doc_id, r.page_number, r.record_ord, p.ord, r.z - r.n >= p.z - p.n AND r.z <= p.z AS inside, r.role = p.role AS same_role, substring(p.text, CAST(r.z - r.n - (p.z - p.n) + 1 AS INT), CAST(r.n AS INT)) = r.text AS same_text
      FROM {runs} r JOIN {own} p ON p.doc_id = r.doc_id AND p.page_number = r.page_number AND r.z - r.n < p.z AND p.z - p.n < r.z)"""
    return f"""SELECT doc_id, page_number, record_ord, CASE WHEN NOT inside THEN 'crosses' WHEN NOT same_text THEN 'text_differs' ELSE 'role_differs' END AS error, count(*) AS n FROM {met} m WHERE NOT (inside AND same_text AND same_role)
      GROUP BY doc_id, page_number, record_ord, CASE WHEN NOT inside THEN 'crosses' WHEN NOT same_text THEN 'text_differs' ELSE 'role_differs' END"""


def _report(d: Dialect) -> str:
    """The validation report of a document: its checks by name (not run where one wasn't), pages and failures."""
    cols = ", ".join(f"bool_or(CASE WHEN name = '{c}' THEN ok END) AS {c}" for c in CHECKS)
    shown = ", ".join(f"coalesce(CAST(q.{c} AS STRING), 'not run') AS {c}" for c in CHECKS)
    pages = f"(SELECT doc_id, count(DISTINCT page_number) AS page_count, count(*) AS n_elements FROM {d.t('elements')} GROUP BY doc_id)"
    return f"SELECT p.doc_id AS source, p.page_count, p.n_elements, coalesce(q.n_checks, 0) AS n_checks, coalesce(q.n_failed, 0) AS n_failed, {shown} FROM {pages} p LEFT JOIN (SELECT doc_id, count(*) AS n_checks, count_if(NOT ok) AS n_failed, {cols} FROM {d.t('checks')} GROUP BY doc_id) q ON q.doc_id = p.doc_id"


def _formula_pairs(d: Dialect) -> str:
    """Expected and actual formulas of an element by place, as far as both go, beside a difference in number."""
    spans = lambda w: f"(SELECT id, source, replacement, row_number() OVER (PARTITION BY id ORDER BY coalesce(s0, -1), nth) AS place, count(*) OVER (PARTITION BY id) AS n FROM {d.t('changes')} WHERE {w})"
    return f"""SELECT id, 'formula_differs' AS error, count(*) AS n FROM (SELECT x.id FROM {spans('nth > 0')} x JOIN {spans("kind <> 'formula_spoken_equivalent' OR nth = 2")} y ON y.id = x.id AND y.place = x.place WHERE x.source <> y.source OR x.replacement <> y.replacement) q GROUP BY id
      UNION ALL SELECT x.id, 'formula_count' AS error, max(x.n) AS n FROM {spans('nth > 0')} x LEFT JOIN {spans("kind <> 'formula_spoken_equivalent' OR nth = 2")} y ON y.id = x.id AND y.place = 1 WHERE x.n <> coalesce(y.n, 0) GROUP BY x.id"""


def _paired(d: Dialect) -> str:
    """Elements and their regions by place: pages on which the two aren't equally many."""
    return f"""SELECT doc_id, page_number, elements, regions FROM (SELECT coalesce(e.doc_id, r.doc_id) AS doc_id, coalesce(e.page_number, r.page_number) AS page_number, count(e.ord) AS elements, count(r.ord) AS regions
      FROM (SELECT doc_id, page_number, ord FROM {d.t('elements')}) e FULL OUTER JOIN (SELECT DISTINCT doc_id, page_number, ord FROM {d.t('fragments')}) r ON r.doc_id = e.doc_id AND r.page_number = e.page_number AND r.ord = e.ord
      GROUP BY coalesce(e.doc_id, r.doc_id), coalesce(e.page_number, r.page_number)) q WHERE elements <> regions"""


QUERIES = {
    "fragment_regions": (("fragments",), _regions),
    "mcid_audit": (("elements",), _wrong_owners),
    "structure_records": (("records", "planned"), _records),
    "validation_report": (("elements", "checks"), _report),
    "formula_pairs": (("changes",), _formula_pairs),
    "element_regions_paired": (("elements", "fragments"), _paired),
}
