"""Page evidence: words, widgets, annotations and fields; what a plan's page is joined with,
and the projections that prompts, reports and layouts need of it."""

from __future__ import annotations

from pagelore.functions.dialect import WS, Dialect
from pagelore.operators.layout import keyed
from pagelore.operators.text_rules import generic_description

#: A page's size in points, and the least distance at which two layouts differ.
WIDTH, HEIGHT = 612.0, 792.0
LAYOUT_STEP = 0.5
MOST_PAGES = 12
WORKERS = 4


def _number(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def _word_scan(d: Dialect) -> str:
    """Words of a page in reading order with their boxes in points as shares of 1000 (neither
    clamped nor rounded) and the key of their line."""
    w, h = _number(WIDTH), _number(HEIGHT)
    return f"""SELECT doc_id, page_number, source, row_number() OVER (PARTITION BY doc_id, page_number, source ORDER BY block_no, line_no, word_no) AS word_ord, text, l / {w} * 1000 AS l, t / {h} * 1000 AS t, r / {w} * 1000 AS r, b / {h} * 1000 AS b,
      concat(CAST(block_no AS STRING), ':', CAST(line_no AS STRING)) AS line_key FROM {d.t('words')}"""


def _word_fallback(d: Dialect) -> str:
    """The recognised words of a page, or its own where recognition gave none."""
    n = f"(SELECT doc_id, page_number, count_if(source = 'ocr') AS ocr, count_if(source = 'native') AS native FROM {d.t('words')} GROUP BY doc_id, page_number)"
    return f"SELECT doc_id, page_number, CASE WHEN ocr > 0 THEN ocr ELSE native END AS n_words, ocr = 0 AS fell_back FROM {n} q"


def _widget_scan(d: Dialect) -> str:
    """Widget annotations with the index that they have among all annotations of their page."""
    return f"SELECT page, annotation_index, obj FROM {d.t('annotations')} WHERE subtype = 'Widget'"


def _snapshot(d: Dialect) -> str:
    """A form's counts: widgets, names and labels that are missing, generic or differ."""
    tip, label = d.strip("coalesce(tooltip, '')"), d.strip("coalesce(label, '')")
    w = f"(SELECT doc_id, {tip} AS tip, {label} AS lab FROM {d.t('widgets')})"
    missing, generic = "count_if(tip = '')", f"count_if(tip <> '' AND {generic_description(d, 'tip')})"
    return f"""SELECT doc_id, count(*) > 0 AS acroform_present, FALSE AS xfa_present, count(*) AS widget_count, {missing} AS missing_descriptions, {generic} AS generic_descriptions, {missing} AS missing_tooltips, {generic} AS generic_tooltips,
      count_if(lab = '') AS missing_labels, count_if(tip <> '' AND lab <> '' AND tip <> lab) AS mismatched_labels FROM {w} x GROUP BY doc_id"""


def _widget_labels(d: Dialect) -> str:
    """A widget's label in the structure tree, the last of several; empty without one."""
    labels = f"(SELECT obj, max_by(label, {d.struct('page', 'idx')}) AS label FROM {d.t('widgets')} WHERE label <> '' GROUP BY obj)"
    return f"SELECT w.doc_id, w.page, w.idx, coalesce(s.label, '') AS structure_label FROM {d.t('widgets')} w LEFT JOIN {labels} s ON s.obj = w.obj"


def _field_count(d: Dialect) -> str:
    """Fields with an own or inherited type under each root, by walks that never enter a field twice."""
    edges = f"(SELECT parent, kid, field_type FROM {d.t('field_edges')})"
    start = f"SELECT kid AS root, kid, field_type, {d.array('kid')} AS seen FROM {edges} e WHERE parent = 'root'"
    limit = "" if d.name == "duck" else " MAX RECURSION LEVEL 1000"
    return f"""WITH RECURSIVE walk(root, kid, field_type, seen){limit} AS ({start} UNION ALL
      SELECT w.root, e.kid, coalesce(e.field_type, w.field_type), {d.append('w.seen', 'e.kid')} FROM walk w JOIN {edges} e ON e.parent = w.kid WHERE NOT {d.has('w.seen', 'e.kid')})
      SELECT root, count(DISTINCT kid) AS visited, count(DISTINCT CASE WHEN field_type IS NOT NULL THEN kid END) AS field_count FROM walk GROUP BY root"""


def _evidence(d: Dialect) -> str:
    """A page's packet, evidence, proposal and review, where all four are there."""
    packet = f"(SELECT doc_id, page_number, count(*) AS n_elements FROM {d.t('elements')} GROUP BY doc_id, page_number)"
    evidence = f"(SELECT doc_id, page_number, count_if(source = 'native') AS native_words, count_if(source = 'ocr') AS ocr_words FROM {d.t('words')} GROUP BY doc_id, page_number)"
    proposal = f"(SELECT doc_id, page_number, count_if(role = 'Figure') AS figures FROM {d.t('planned')} GROUP BY doc_id, page_number)"
    review = f"(SELECT doc_id, page_number, count(*) AS n_findings FROM {d.t('element_findings')} GROUP BY doc_id, page_number)"
    on = lambda x: f"{x}.doc_id = p.doc_id AND {x}.page_number = p.page_number"
    return f"SELECT p.doc_id, p.page_number, p.n_elements, e.native_words, e.ocr_words, q.figures, r.n_findings FROM {packet} p JOIN {evidence} e ON {on('e')} JOIN {proposal} q ON {on('q')} JOIN {review} r ON {on('r')}"


def _planned_pages(d: Dialect) -> str:
    """The planned ones among a document's first pages; pages without a plan are passed over."""
    pages = f"(SELECT DISTINCT doc_id, page_number FROM {d.t('elements')} WHERE page_number <= {MOST_PAGES})"
    plan = f"(SELECT doc_id, page_number, count(*) AS planned FROM {d.t('planned')} WHERE role <> 'LI' GROUP BY doc_id, page_number)"
    return f"SELECT g.doc_id, g.page_number, p.planned, {d.idiv('g.page_number - 1', str(WORKERS))} AS batch FROM {pages} g JOIN {plan} p ON p.doc_id = g.doc_id AND p.page_number = g.page_number"


def _semantic(d: Dialect) -> str:
    """What an element says: a figure its alternative text; a kept figure without one is a critical finding."""
    alt = "coalesce(alt_text, '')"
    return f"SELECT doc_id, page_number, ord, role, CASE WHEN role = 'Figure' THEN {alt} ELSE accessible_text END AS semantic_text, CASE WHEN role = 'Figure' AND {d.strip(alt)} = '' THEN 'critical' END AS missing_alt FROM {d.t('planned')}"


def _formula_spans(d: Dialect) -> str:
    """Formulas' places in the extracted text: a formula keeps its notation there, other changes their replacement."""
    usable = f"(SELECT id, bool_and(s0 IS NOT NULL AND s1 IS NOT NULL AND t0 IS NOT NULL AND t1 IS NOT NULL) AS exact FROM {d.t('changes')} GROUP BY id)"
    formula = "c.kind = 'formula_spoken_equivalent'"
    order = "PARTITION BY c.id ORDER BY coalesce(c.s0, -1), coalesce(c.s1, -1), c.nth"
    grown = f"CASE WHEN {formula} THEN length(c.source) ELSE length(c.replacement) END"
    rows = f"(SELECT c.id, c.nth, c.source, c.replacement, {formula} AS formula, c.s0 - coalesce(sum(c.s1 - c.s0 - {grown}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM {d.t('changes')} c JOIN {usable} u ON u.id = c.id AND u.exact)"
    return f"SELECT id, nth, CAST(place AS BIGINT) AS span_start, CAST(place + length(source) AS BIGINT) AS span_end, source AS notation, replacement AS alt_text FROM {rows} x WHERE formula"


def _prompts(d: Dialect) -> str:
    """The text that a page is asked about with: its size, its words by either reader, and recent titles on the first page."""
    words = lambda s: f"(SELECT doc_id, page_number, {d.agg_join('text', ' ', 'block_no, line_no, word_no')} AS words FROM {d.t('words')} WHERE source = '{s}' GROUP BY doc_id, page_number)"
    titles = f"(SELECT doc_id, {d.agg_join('line', chr(10), 'page_number, ord')} AS titles FROM (SELECT doc_id, page_number, ord, concat('- ', text) AS line FROM {d.t('elements')} WHERE role = 'DocumentTitle' AND page_number <= 5) t GROUP BY doc_id)"
    nl = "chr(10)"
    size = f"concat('Page ', CAST(n.page_number AS STRING), ', {WIDTH:.1f} by {HEIGHT:.1f} points.')"
    recent = f"CASE WHEN n.page_number = 1 THEN concat({nl}, 'Recent titles:', {nl}, coalesce(h.titles, '(none yet)')) ELSE '' END"
    return f"SELECT n.doc_id, n.page_number, concat({size}, {nl}, 'Native: ', coalesce(nullif(n.words, ''), '(none)'), {nl}, 'Recognised: ', coalesce(nullif(o.words, ''), '(none)'), {recent}) AS prompt FROM {words('native')} n LEFT JOIN {words('ocr')} o ON o.doc_id = n.doc_id AND o.page_number = n.page_number LEFT JOIN {titles} h ON h.doc_id = n.doc_id"


def _plan_hash(d: Dialect) -> str:
    """Digest of a plan's elements in order, with nulls written out."""
    q = lambda x: f"CASE WHEN {x} IS NULL THEN 'null' ELSE concat('\"', {d.replace(x, '([\"])', '_')}, '\"') END"
    line = f"concat('[', CAST(page_number AS STRING), ',', CAST(ord AS STRING), ',', {q('role')}, ',', {q('accessible_text')}, ',', {q('alt_text')}, ']')"
    pages = f"(SELECT doc_id, page_number, {d.sha(d.agg_join(line, ',', 'ord'))} AS page_sha FROM {d.t('planned')} GROUP BY doc_id, page_number)"
    return f"SELECT doc_id, {d.sha(d.agg_join('page_sha', ',', 'page_number'))} AS plan_sha256 FROM {pages} p GROUP BY doc_id"


#: What a run writes beside a source, by kind.
OUTPUTS = {"preflight": ".preflight.json", "base": ".ocr-base.pdf", "plan": ".plan.json", "draft": ".draft.pdf", "output": ".accessible.pdf", "validation": ".validation.json", "anomalies": ".anomalies.jsonl", "anomaly_html": ".anomalies.html", "wcag": ".wcag.json", "manifest": ".manifest.json"}


def _paths(d: Dialect) -> str:
    """Where a source's outputs go: a folder by its name without ending, files by kind."""
    stem = d.replace(d.replace("coalesce(url, '')", r"\A.*/", ""), r"(.)\.[^.]*\z", r"\1")
    files = ", ".join(f"concat('/out/', stem, '/', stem, '{end}') AS {kind}_path" for kind, end in OUTPUTS.items())
    return f"SELECT page_id, concat('/out/', stem) AS workdir, {files} FROM (SELECT page_id, {stem} AS stem FROM {d.t('pages')}) p"


def _metrics(d: Dialect) -> str:
    """Font metrics per 1000 of an em, halves to even."""
    even = "bround(v * 1000 / upem)" if d.name == "spark" else "round_even(v * 1000 / upem, 0)"
    return f"SELECT p_partkey, CAST({even} AS BIGINT) AS scaled FROM (SELECT p_partkey, CAST(p_partkey * 13 - 900 AS DOUBLE) AS v, CASE p_size % 2 WHEN 0 THEN 2048 ELSE 1000 END AS upem FROM {d.t('part')}) x"


def _points(d: Dialect) -> str:
    """Fragments' boxes in points inside the page, their element's where they have none; and the box of an element's fragments in shares of 1000."""
    w, h, zero = _number(WIDTH), _number(HEIGHT), _number(0)
    both = f"(SELECT f.doc_id, f.page_number, f.ord, f.nth, CASE WHEN f.nth = 3 THEN NULL ELSE f.l END AS fl, f.t AS ft, f.r AS fr, f.b AS fb, e.l, e.t, e.r, e.b FROM {d.t('fragments')} f JOIN {d.t('elements')} e ON e.doc_id = f.doc_id AND e.page_number = f.page_number AND e.ord = f.ord)"
    pick = lambda a, b: f"CASE WHEN fl IS NULL THEN {b} ELSE {a} END / 1000"
    p = f"(SELECT doc_id, page_number, ord, greatest({zero}, {pick('fl', 'l')} * {w}) AS x0, greatest({zero}, {pick('ft', 't')} * {h}) AS y0, least({w}, {pick('fr', 'r')} * {w}) AS x1, least({h}, {pick('fb', 'b')} * {h}) AS y1 FROM {both} q)"
    return f"SELECT doc_id, page_number, ord, count(*) AS n, sum(round(x0 + y0 + x1 + y1, 6)) AS points_sum, round(min(x0) / {w} * 1000, 3) AS l, round(min(y0) / {h} * 1000, 3) AS t, round(max(x1) / {w} * 1000, 3) AS r, round(max(y1) / {h} * 1000, 3) AS b FROM {p} x GROUP BY doc_id, page_number, ord"


def _proposals(d: Dialect) -> str:
    """A page's proposal: its checkpoint, else the page of an older plan."""
    return f"SELECT p.page_id, CASE WHEN l.doc_id IS NOT NULL THEN 'checkpoint' WHEN o.id IS NOT NULL THEN 'legacy' END AS proposal FROM {d.t('pages')} p LEFT JOIN {d.t('labels')} l ON l.doc_id = p.page_id LEFT JOIN (SELECT id FROM {d.t('plans')} WHERE id % 2 = 0) o ON o.id = p.page_id"


def _layouts(d: Dialect) -> str:
    """Pages whose lines by the two readers differ: in number, in text, or in a place by more than half a unit."""
    line = lambda s, shift: f"(SELECT doc_id, page_number, block_no, {d.agg_join('text', ' ', 'word_no')} AS text, min(l) AS l, min(t) + {shift} AS t, max(r) AS r, max(b) AS b FROM {d.t('words')} WHERE source = '{s}' GROUP BY doc_id, page_number, block_no)"
    far = " OR ".join(f"abs(x.{c} - y.{c}) > {LAYOUT_STEP}" for c in "ltrb")
    moved = "CASE WHEN block_no % 9 = 4 AND length(min(text)) % 2 = 0 THEN 1 ELSE 0 END"
    return f"""SELECT doc_id, page_number, bool_or(differs) AS layouts_differ, count_if(differs) AS n_lines FROM (
      SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.page_number, y.page_number) AS page_number, x.doc_id IS NULL OR y.doc_id IS NULL OR x.text <> y.text OR {far} AS differs
      FROM {line('native', '0')} x FULL OUTER JOIN {line('ocr', moved)} y ON x.doc_id = y.doc_id AND x.page_number = y.page_number AND x.block_no = y.block_no) q GROUP BY doc_id, page_number"""


def _stripped_marks(d: Dialect) -> str:
    """A content stream without its marking operators: what is kept of every line's words as instructions."""
    each = d.explode(f"(SELECT doc_id, ord, {d.extract_all('text', f'[^{WS}]+')} AS w FROM {d.t('lines')}) s", "w", "nth", "operand")
    operator = "CASE nth % 5 WHEN 1 THEN 'BDC' WHEN 0 THEN 'EMC' WHEN 2 THEN 'BMC' ELSE 'Tj' END"
    return f"SELECT doc_id, ord, count(*) AS instructions, count_if(operator NOT IN ('BMC', 'BDC', 'EMC')) AS kept FROM (SELECT doc_id, ord, {operator} AS operator FROM {each} x) y GROUP BY doc_id, ord"


def _tagged(d: Dialect) -> str:
    """Tagged pages and bookmarks of a document; fully tagged if every page is."""
    pages = f"(SELECT doc_id, page_number, bool_or(role <> 'P') AS tagged, count_if(role IN ('DocumentTitle', 'H1')) AS bookmarks FROM {keyed(d)} GROUP BY doc_id, page_number)"
    return f"SELECT doc_id, count(*) AS page_count, count_if(tagged) AS tagged_pages, CAST(sum(bookmarks) AS BIGINT) AS bookmark_count, count_if(tagged) = count(*) AS fully_tagged FROM {pages} p GROUP BY doc_id"


QUERIES = {
    "word_scan": (("words",), _word_scan),
    "page_fallback": (("words",), _word_fallback),
    "widget_scan": (("annotations",), _widget_scan),
    "form_snapshot": (("widgets",), _snapshot),
    "widget_labels": (("widgets",), _widget_labels),
    "field_count": (("field_edges",), _field_count),
    "page_evidence": (("elements", "words", "planned", "element_findings"), _evidence),
    "planned_pages": (("elements", "planned"), _planned_pages),
    "semantic_text": (("planned",), _semantic),
    "formula_spans": (("changes",), _formula_spans),
    "page_prompts": (("words", "elements"), _prompts),
    "plan_hash": (("planned",), _plan_hash),
    "output_paths": (("pages",), _paths),
    "font_metrics": (("part",), _metrics),
    "fragment_points": (("fragments", "elements"), _points),
    "page_proposals": (("pages", "labels", "plans"), _proposals),
    "layouts_differ": (("words",), _layouts),
    "unmarked_content": (("lines",), _stripped_marks),
    "tagged_pages": (("elements",), _tagged),
}
