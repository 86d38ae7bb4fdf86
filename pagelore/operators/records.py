"""Records around a plan: source metadata, fonts, boxes, tables, forms, coverage, numbering."""

from __future__ import annotations

from pagelore.functions.dialect import WS, Dialect
from pagelore.operators.layout import keyed
from pagelore.operators.text_rules import fingerprint, spoken_dates, without_markers
from pagelore.sources.derived import EXPECTED

# Encodings that map to Unicode, and glyph advances of the stand-in font (per mille of its size).
MAPPED_ENCODINGS = ("WinAnsiEncoding", "MacRomanEncoding", "MacExpertEncoding")
ADVANCES = (("[ ]", 250), ("[A-Z]", 700), ("[0-9]", 500), ("[a-z]", 450))
FALLBACK_ADVANCE = 600
LEAST_SPACE = 0.25


def _metadata(d: Dialect) -> str:
    """Encoders in first-seen order without repeats, and creation date from either field."""
    src = d.t("sources")
    long = " UNION ALL ".join(f"SELECT id, {i} AS pos, trim(c{i}) AS encoder FROM {src}" for i in range(1, 5))
    first = f"SELECT id, encoder, min(pos) AS pos FROM ({long}) l WHERE coalesce(encoder, '') <> '' GROUP BY id, encoder"
    stamp = d.extract("coalesce(created, '')", r"\AD:([0-9]{14})", 1)
    part = lambda a, n: f"substring({stamp}, {a}, {n})"
    iso = f"CASE WHEN {stamp} <> '' THEN concat({part(1, 4)}, '-', {part(5, 2)}, '-', {part(7, 2)}, 'T', {part(9, 2)}, ':', {part(11, 2)}, ':', {part(13, 2)}) END"
    return f"SELECT s.id, e.encoders, coalesce(nullif(trim(s.xmp_created), ''), {iso}) AS creation_date FROM {src} s LEFT JOIN (SELECT id, {d.agg_join('encoder', '; ', 'pos')} AS encoders FROM ({first}) f GROUP BY id) e ON e.id = s.id"


def _fonts(d: Dialect) -> str:
    """Part types as fonts of brands as documents: embedded and mapped fonts; a document without fonts has neither."""
    fonts = f"(SELECT p_brand, CASE WHEN p_size % 9 = 0 THEN 'n/a' WHEN p_size % 7 = 0 THEN '' ELSE 'ttf' END AS ext, CASE p_size % 3 WHEN 0 THEN 'WinAnsiEncoding' WHEN 1 THEN 'Identity-H' ELSE 'Custom' END AS enc, p_size % 4 <> 0 AS to_unicode FROM {d.t('part')})"
    ok = "ext NOT IN ('n/a', '')"
    mapped = f"({d.in_('enc', MAPPED_ENCODINGS)} OR to_unicode)"
    return f"SELECT p_brand, count(*) AS fonts, coalesce(bool_and({ok}), FALSE) AS fonts_embedded, coalesce(bool_and({mapped}), FALSE) AS fonts_unicode, count_if(NOT ({ok})) AS open_fonts FROM {fonts} f GROUP BY p_brand"


def _blank(d: Dialect) -> str:
    """Vectors as grey samples: a page is blank if fewer than one in a thousand is dark, or it has none."""
    x = d.explode(f"(SELECT vec_id, embedding FROM {d.t('embeddings')}) s", "embedding", "i", "v")
    return f"SELECT vec_id, count_if(v > 0.25) AS dark, CAST(count_if(v > 0.25) AS DOUBLE) / count(*) < 0.001 AS blank FROM {x} q GROUP BY vec_id"


def _direct(d: Dialect) -> str:
    """Text that a font with Latin letters can show: white space as a space, the rest as ?."""
    shown = d.replace(d.replace("text", rf"[{WS}]", " "), r"[^\x20-\x7e\x{c0}-\x{ff}]", "?")
    return f"SELECT doc_id, {d.sha(shown)} AS direct_sha, {d.count(shown, '[?]')} AS replaced FROM (SELECT doc_id, coalesce(text, '') AS text FROM {d.t('documents')}) x"


def metrics(d: Dialect, text: str, width: str, height: str) -> tuple[str, str, str]:
    """(font size, horizontal scale, advance of a space) of a run of text in a box."""
    counted = " + ".join(f"{n} * {d.count(text, p)}" for p, n in ADVANCES)
    others = d.count(text, r"[^ A-Za-z0-9]")
    em = f"greatest(({counted} + {FALLBACK_ADVANCE} * {others}) / CAST(1000 AS DOUBLE), 0.01)"
    room = f"greatest({width}, 0.01)"
    size = f"greatest(1.0, least(greatest(1.0, least(72.0, ({height}) * 0.82)), {room} / {em}))"
    scale = f"greatest(10.0, least(1000.0, {room} / greatest({em} * {size}, 0.01) * 100))"
    return size, scale, f"CASE WHEN contains({text}, ' ') THEN 0.25 * {size} * {scale} / 100 END"


def _metrics(d: Dialect) -> str:
    size, scale, space = metrics(d, "text", "r - l", "b - t")
    return f"SELECT doc_id, page_number, ord, {size} AS font_size, {scale} AS horizontal_scale, {space} AS space_advance, coalesce({space} < {LEAST_SPACE}, FALSE) AS dense FROM {d.t('elements')}"


def _unions(d: Dialect) -> str:
    """Union box of a page's paragraphs, in points of a 612 x 792 page with the origin below."""
    return f"SELECT doc_id, page_number, count(*) AS n, min(l) / 1000 * 612 AS x0, 792 - max(b) / 1000 * 792 AS y0, max(r) / 1000 * 612 AS x1, 792 - min(t) / 1000 * 792 AS y1, bool_and(l >= 0 AND l < r AND r <= 1000 AND t >= 0 AND t < b AND b <= 1000) AS valid FROM {d.t('elements')} WHERE role = 'P' GROUP BY doc_id, page_number"


def _shares(d: Dialect) -> str:
    """Words of an element dealt over three source words: each takes an equal part of its source's box."""
    words = f"(SELECT doc_id, page_number, ord, l, r, {d.size(d.keep(d.split('text', ' '), 'w', chr(119) + ' <> ' + chr(39) * 2))} AS m FROM {d.t('elements')} )"
    slots = d.seq(f"{words} q", "0", "m - 1", "i")
    own = d.idiv("i * 3", "m")
    return f"""SELECT doc_id, page_number, ord, i, source, l + (r - l) / 3 * (source + CAST(place AS DOUBLE) / places) AS x0, l + (r - l) / 3 * (source + CAST(place + 1 AS DOUBLE) / places) AS x1 FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, ord, source ORDER BY i) - 1 AS place, count(*) OVER (PARTITION BY doc_id, page_number, ord, source) AS places FROM (SELECT *, least({own}, 2) AS source FROM {slots} s) y) x"""


def _grid_bounds(d: Dialect) -> str:
    """Left and right of every column of an order's grid, from cells that span one or two columns; proportional where none."""
    cells = f"(SELECT l_orderkey AS table_id, CAST(l_linenumber - 1 AS BIGINT) AS c0, l_partkey % 2 + 1 AS span, CAST((l_linenumber - 1) * 100 AS DOUBLE) AS x0, CAST((l_linenumber - 1) * 100 + (l_partkey % 2 + 1) * 90 AS DOUBLE) AS x1 FROM {d.t('lineitem')})"
    size = f"(SELECT table_id, max(c0 + span) AS n_cols, min(x0) AS lo, max(x1) AS hi FROM {cells} c GROUP BY table_id)"
    slots = d.seq(f"{size} q", "0", "n_cols - 1", "col_no")
    return f"""SELECT s.table_id, s.col_no, coalesce(min(c.x0 + (c.x1 - c.x0) / c.span * (s.col_no - c.c0)), min(s.lo + (s.hi - s.lo) * s.col_no / s.n_cols)) AS x0,
      coalesce(max(c.x0 + (c.x1 - c.x0) / c.span * (s.col_no - c.c0 + 1)), max(s.lo + (s.hi - s.lo) * (s.col_no + 1) / s.n_cols)) AS x1
      FROM {slots} s LEFT JOIN {cells} c ON c.table_id = s.table_id AND c.c0 <= s.col_no AND s.col_no < c.c0 + c.span GROUP BY s.table_id, s.col_no"""


def _span_placeholders(d: Dialect) -> str:
    """Slots of an order's grid that a cell from a row above covers (three rows of cells, one in three two rows high)."""
    cells = f"(SELECT DISTINCT l_orderkey AS table_id, l_partkey % 3 AS row_no, CAST(l_linenumber % 4 AS BIGINT) AS col_no, CASE WHEN l_partkey % 9 = 0 THEN 2 ELSE 1 END AS down FROM {d.t('lineitem')})"
    covered = d.seq(f"{cells} q", "row_no + 1", "row_no + down - 1", "low_row")
    anti = "ANTI JOIN" if d.name == "duck" else "LEFT ANTI JOIN"
    return f"SELECT DISTINCT s.table_id, s.low_row, s.col_no FROM {covered} s {anti} {cells} c ON c.table_id = s.table_id AND c.row_no = s.low_row AND c.col_no = s.col_no"


def _descriptions(d: Dialect) -> str:
    """Planned and actual widget names by page and index; a page that doesn't match in number is one error (index -1)."""
    p, a = f"(SELECT doc_id, page, idx, description FROM {d.t('widgets')} WHERE description IS NOT NULL)", f"(SELECT doc_id, page, idx, tooltip, label FROM {d.t('widgets')})"
    both = f"(SELECT coalesce(p.doc_id, a.doc_id) AS doc_id, coalesce(p.page, a.page) AS page, coalesce(p.idx, a.idx) AS idx, description, tooltip, label, p.idx IS NULL OR a.idx IS NULL AS odd FROM {p} p FULL OUTER JOIN {a} a ON p.doc_id = a.doc_id AND p.page = a.page AND p.idx = a.idx)"
    flagged = f"(SELECT *, bool_or(odd) OVER (PARTITION BY doc_id, page) AS incomplete FROM {both} b)"
    return f"""SELECT DISTINCT doc_id, page, CAST(-1 AS BIGINT) AS idx, 'incomplete' AS error FROM {flagged} f WHERE incomplete
      UNION ALL SELECT doc_id, page, idx, 'name_differs' AS error FROM {flagged} f WHERE NOT incomplete AND tooltip <> description UNION ALL SELECT doc_id, page, idx, 'label_differs' AS error FROM {flagged} f WHERE NOT incomplete AND label <> description"""


def _field_agreement(d: Dialect) -> str:
    """Lines of one part as widgets of one field: their flags must agree."""
    return f"SELECT l_partkey, count(*) AS widgets, count(DISTINCT l_returnflag) AS names FROM {d.t('lineitem')} GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1"


def _form_preserved(d: Dialect) -> str:
    """Rows of the customer table that a copy with some balances changed doesn't have, and the reverse."""
    src = f"SELECT c_custkey, c_name, c_acctbal FROM {d.t('customer')}"
    out = f"SELECT c_custkey, c_name, CASE WHEN c_custkey % 50 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM {d.t('customer')}"
    return f"SELECT c_custkey, 'lost' AS what FROM (({src}) EXCEPT ALL ({out})) l UNION ALL SELECT c_custkey, 'new' AS what FROM (({out}) EXCEPT ALL ({src})) n"


def _coverage(d: Dialect) -> str:
    """Alignment coverage of a page, weighted by words; whether any element has usable evidence."""
    n = f"greatest({d.size(d.split('text', ' '))}, 1)"
    return f"SELECT doc_id, page_number, CAST(sum(CAST(round(agree * 100) AS BIGINT) * {n}) AS DOUBLE) / CAST(sum(100 * {n}) AS DOUBLE) AS coverage, bool_or(agree >= 0.5 AND text <> '') AS usable, min(agree) AS least_agreement FROM {d.t('elements')} GROUP BY doc_id, page_number"


def _best_font(d: Dialect) -> str:
    """Of four stand-in fonts the one that covers most characters of a language; the first of equal ones."""
    need = f"(SELECT DISTINCT lang, {d.code('ch')} AS cp FROM {d.explode('(SELECT lang, ' + d.distinct(d.chars('text')) + ' AS c FROM ' + d.t('documents') + ' WHERE text IS NOT NULL) s', 'c', 'p', 'ch')} q WHERE ch <> '')"
    fonts = d.rows("f", "font BIGINT, gap BIGINT", [(0, 5), (1, 17), (2, 11), (3, 17)])
    score = f"SELECT lang, font, count_if(cp % gap <> 0) AS covered FROM {need} n CROSS JOIN {fonts} GROUP BY lang, font"  # four fixed fonts
    return f"SELECT lang, max_by(font, covered * 10 - font) AS font, max(covered) AS covered FROM ({score}) x GROUP BY lang"


def _demotion(d: Dialect) -> str:
    """Cells of a page whose table is incomplete become paragraphs, with a finding; empty ones go."""
    bad = "(role IN ('TH', 'TD') AND (table_id IS NULL OR row_no IS NULL OR col_no IS NULL))"
    x = f"(SELECT *, bool_or({bad}) OVER (PARTITION BY page) AS broken FROM {d.t('cells')})"
    return f"SELECT page, ord, CASE WHEN broken AND role IN ('TH', 'TD') THEN 'P' ELSE role END AS role, accessible, CASE WHEN broken THEN NULL ELSE table_id END AS table_id, CASE WHEN broken AND role IN ('TH', 'TD') THEN 'warning' END AS finding FROM {x} q WHERE NOT (broken AND role IN ('TH', 'TD') AND {d.strip('accessible')} = '')"


def _legacy(d: Dialect) -> str:
    """Old elements: one text for both, one confidence for all four, an ambiguity as a warning."""
    j = lambda k: d.json("e", k)
    conf = f"coalesce(CAST({j('confidence')} AS DOUBLE), CAST(1 AS DOUBLE))"
    return f"""SELECT id, coalesce({j('visible_text')}, {j('text')}) AS visible_text, coalesce({j('accessible_text')}, {j('text')}) AS accessible_text, {conf} AS transcription, {conf} AS semantic_role, {conf} AS geometry, {conf} AS reading_order,
      CASE WHEN {j('ambiguity')} IS NOT NULL THEN 'legacy_ambiguity' END AS category, {j('ambiguity')} AS message FROM {d.t('old_elements')}"""


def _extraction_gate(d: Dialect) -> str:
    """Is extracted text compatible: return code, agreement and ratio of token counts; empty text agrees with empty."""
    agree = "CASE WHEN expected > 0 THEN ratio WHEN actual = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    count = "CASE WHEN expected > 0 THEN CAST(actual AS DOUBLE) / nullif(expected, 0) WHEN actual = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(999 AS DOUBLE) END"
    return f"SELECT id, rc = 0 AND {agree} >= 0.99 AND {count} BETWEEN 0.98 AND 1.02 AS compatible FROM {d.t('extractions')}"


def _metadata_status(d: Dialect) -> str:
    """The 21 checks of a remediated file's metadata; absent values are empty, and hashes count only with a plan."""
    e = lambda x: f"coalesce({x}, '')"
    fixed = {"tool": "tool", "version": "1", "schema_version": str(7), "producer": "producer", "creator": "", "xmp_creator_tool": "", "remediation": "summary", "info_remediation": "summary"}
    checks = {k: f"{e(k)} = '{v}'" for k, v in fixed.items()} | {"remediation_date": f"{e('remediation_date')} <> ''"}
    checks |= {k: f"{e(k)} = {e('expected_' + k)}" + (" OR NOT has_plan" if k in ("source_sha256", "canonical_plan_sha256") else "") for k in EXPECTED}
    failing = ", ".join(f"CASE WHEN {c} THEN '' ELSE '{k};' END" for k, c in sorted(checks.items()))
    return f"SELECT id, {' AND '.join(f'({c})' for c in checks.values())} AS valid, concat({failing}) AS failing FROM {d.t('file_metadata')}"


def _chunks(d: Dialect) -> str:
    """Chunks of a document: its lines' words, each with the white space behind it, numbered through the page."""
    words = d.explode(f"(SELECT doc_id, page_number, ord, {d.extract_all('text', rf'[^{WS}]+[{WS}]*')} AS w FROM {d.t('lines')}) s", "w", "word_ord", "chunk")
    return f"SELECT doc_id, page_number, max(mcid) AS last_mcid, count(*) AS n_chunks, CAST(sum(mcid * length(chunk)) AS BIGINT) AS weight FROM (SELECT doc_id, page_number, chunk, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY ord, word_ord) - 1 AS mcid FROM {words} q) x GROUP BY doc_id, page_number"


def _plan_reuse(d: Dialect) -> str:
    """Can a stored plan be reused: approved, refreshed, and with all pages asked for?"""
    per = f"(SELECT doc_id, count(DISTINCT page_number) AS pages, min(page_id) AS k FROM {d.t('elements')} GROUP BY doc_id)"
    return f"SELECT doc_id, k % 3 <> 0 AND k % 12 >= 1 AND pages >= k % 4 AS reused FROM {per} p"


def _links(d: Dialect) -> str:
    return f"SELECT id, nth, CASE WHEN coalesce(contents, '') <> '' THEN contents WHEN uri IS NOT NULL THEN concat('Link to ', uri) WHEN internal THEN 'Internal link' ELSE 'Link' END AS description FROM {d.t('links')}"


def _refined(d: Dialect) -> str:
    """The refinement chain: lone list items, artifacts out, markers and dates, new numbers."""
    from pagelore.operators.layout import _list_items, with_reasons

    w = "PARTITION BY doc_id, page_number ORDER BY ord"
    text = spoken_dates(d, f"CASE WHEN {d.match('text', '_{3,}|[☐□◻]')} THEN {without_markers(d, 'text')} ELSE text END")
    kept = f"(SELECT r.doc_id, r.page_number, r.ord, i.role, {text.replace('text', 'r.text')} AS accessible_text, i.demoted FROM {with_reasons(d)} r JOIN ({_list_items(d)}) i ON i.doc_id = r.doc_id AND i.page_number = r.page_number AND i.ord = r.ord WHERE r.reason IS NULL)"
    return f"SELECT doc_id, page_number, ord, row_number() OVER ({w}) AS new_ord, concat({d.id4('p', 'page_number')}, {d.id4('-e', f'row_number() OVER ({w})')}) AS new_id, role, accessible_text, demoted FROM {kept} k"


def _artifact_numbers(d: Dialect) -> str:
    from pagelore.operators.layout import with_reasons

    w = "PARTITION BY doc_id, page_number ORDER BY ord"
    return f"SELECT doc_id, page_number, concat({d.id4('p', 'page_number')}, {d.id4('-a', f'row_number() OVER ({w})')}) AS artifact_id, reason, text FROM {with_reasons(d)} r WHERE reason IS NOT NULL"


def _margin_text(d: Dialect) -> str:
    """What each margin says, by fingerprint: the margin candidates before counting."""
    fp = fingerprint(d, "text", "t", "b")
    return f"SELECT doc_id, page_number, ord, element_id, {fp} AS fp FROM {keyed(d)} WHERE {fp} IS NOT NULL"


QUERIES = {
    "source_metadata": (("sources",), _metadata),
    "font_flags": (("part",), _fonts),
    "blank_pages": (("embeddings",), _blank),
    "direct_text": (("documents",), _direct),
    "text_metrics": (("elements",), _metrics),
    "region_boxes": (("elements",), _unions),
    "replacement_boxes": (("elements",), _shares),
    "grid_bounds": (("lineitem",), _grid_bounds),
    "span_placeholders": (("lineitem",), _span_placeholders),
    "widget_descriptions": (("widgets",), _descriptions),
    "field_agreement": (("lineitem",), _field_agreement),
    "form_preserved": (("customer",), _form_preserved),
    "alignment_coverage": (("elements",), _coverage),
    "best_font": (("documents",), _best_font),
    "table_demotion": (("cells",), _demotion),
    "legacy_elements": (("old_elements",), _legacy),
    "extraction_gate": (("extractions",), _extraction_gate),
    "metadata_status": (("file_metadata",), _metadata_status),
    "anchor_chunks": (("lines",), _chunks),
    "plan_reuse": (("elements",), _plan_reuse),
    "link_descriptions": (("links",), _links),
    "refined_elements": (("elements",), _refined),
    "artifact_numbers": (("elements",), _artifact_numbers),
    "margin_text": (("elements",), _margin_text),
}
