"""Page layout: furniture, artifacts, order, runs, grids, boxes and spatial joins.

Spatial joins have the page among their keys, so they stay hash joins with a residual
condition. ``QUERIES`` applies the rules to the page elements."""

from __future__ import annotations

from pagelore.functions.dialect import WS, Dialect
from pagelore.operators.text_rules import fingerprint

# List markers, epigraphs, decorative words, generic figure descriptions.
LIST_MARKER = rf"\A(?:[•◦▪‣*]|[-–—]|\(?[0-9]+[.)]|[A-Za-z][.)])[{WS}]+"
EPIGRAPH = rf"[.!?][\"'”’]?[{WS}]*[–—][{WS}]*[^{WS}]"
DECORATIVE = ("decorative", "flourish", "ornament")
GENERIC_ALT = ("historical document image", "historical image", "document image")
WRITING_LINE = rf"[{WS}_.·…-]{{12,}}"


def keyed(d: Dialect) -> str:
    """Elements with their stable ids."""
    return f"(SELECT *, concat({d.id4('p', 'page_number')}, {d.id4('-e', 'ord')}) AS element_id FROM {d.t('elements')}) k"


def same_line(a: str, b: str) -> str:
    """Do boxes a and b stand on one visual line: overlap by 0.35 of the lower, or close centres?"""
    low = f"greatest(least({a}.b - {a}.t, {b}.b - {b}.t), 0.01)"
    high = f"greatest({a}.b - {a}.t, {b}.b - {b}.t, 0.01)"
    return f"((least({a}.b, {b}.b) - greatest({a}.t, {b}.t)) / {low} >= 0.35 OR abs(({a}.t + {a}.b) / 2 - ({b}.t + {b}.b) / 2) <= {high} * 0.3)"


def overlap(a: str, b: str) -> str:
    """Would text runs in boxes a and b compete: one line, and more than a sliver in common?"""
    return f"({same_line(a, b)} AND least({a}.r, {b}.r) - greatest({a}.l, {b}.l) > greatest(1.0, greatest(least({a}.r - {a}.l, {b}.r - {b}.l), 0.01) * 0.05))"


def repeated_furniture(d: Dialect) -> str:
    fp = fingerprint(d, "text", "t", "b")
    return f"SELECT doc_id, fp, count(*) AS n FROM (SELECT doc_id, {fp} AS fp FROM {d.t('elements')}) x WHERE fp IS NOT NULL GROUP BY doc_id, fp HAVING count(*) >= 2"


def artifact_reason(d: Dialect, page: str, text: str, role: str, alt: str, width: str, height: str, reviewed: str, repeated: str) -> str:
    """Why an element isn't content, or null; the order of the branches decides."""
    s, a = d.strip(text), f"lower({d.strip(f'coalesce({alt}, {chr(39)}{chr(39)})')})"
    number = d.extract(s, rf"(?i)\A(?:page[{WS}]*)?0*([1-9][0-9]*)\z", 1)
    figure = f"{d.any_of(a, DECORATIVE)} OR ({d.in_(a, GENERIC_ALT)} AND ({width} <= 80 OR {height} <= 25)) OR ({a} = '' AND {reviewed})"
    return f"""CASE WHEN {number} = CAST({page} AS STRING) THEN 'page_number'
      WHEN length({s}) >= 12 AND NOT {d.match(s, '[A-Za-z0-9]')} THEN 'writing_line'
      WHEN {role} = 'Figure' AND ({figure}) THEN 'decoration'
      WHEN {repeated} THEN 'running_furniture' END"""


def with_reasons(d: Dialect) -> str:
    """Elements with element_id and the reason they are artifacts (null for content)."""
    fp = fingerprint(d, "text", "t", "b")
    reason = artifact_reason(d, "e.page_number", "e.text", "e.role", "NULL", "e.r - e.l", "e.b - e.t", "FALSE", "f.fp IS NOT NULL")
    return f"(SELECT e.*, {reason} AS reason FROM (SELECT *, {fp} AS own_fp FROM {keyed(d)}) e LEFT JOIN ({repeated_furniture(d)}) f ON e.doc_id = f.doc_id AND e.own_fp = f.fp)"


# ------------------------------------------------------------------ queries


def _scan(d: Dialect) -> str:
    return f"SELECT doc_id, page_number, ord, element_id, role, text, t AS box_top, b AS box_bottom FROM {keyed(d)}"


def _artifacts(d: Dialect) -> str:
    q = chr(39) * 2
    cases = d.rows("c", "id STRING, page BIGINT, text STRING, role STRING, alt STRING, w DOUBLE, h DOUBLE, rev BOOLEAN, rep BOOLEAN", [
        ("a", 2, "Page 002", "P", None, 900.0, 20.0, False, False), ("b", 2, "3", "P", None, 9.0, 20.0, False, False), ("c", 1, ". . . . . . . . .", "P", None, 900.0, 20.0, False, False),
        ("d", 1, "", "Figure", "Decorative rule", 900.0, 20.0, False, False), ("e", 1, "", "Figure", "historical image", 70.0, 200.0, False, False), ("f", 1, "", "Figure", None, 900.0, 90.0, True, False),
        ("g", 1, "", "Figure", "historical image", 700.0, 200.0, False, False), ("h", 1, "Footer", "P", None, 9.0, 9.0, False, True), ("i", 1, "Text", "P", None, 9.0, 9.0, False, False),
    ])
    del q
    return f"""SELECT doc_id, element_id, reason FROM {with_reasons(d)} x WHERE reason IS NOT NULL
      UNION ALL SELECT 'cases' AS doc_id, id AS element_id, {artifact_reason(d, 'page', 'text', 'role', 'alt', 'w', 'h', 'rev', 'rep')} AS reason FROM {cases}"""


def _fragment_artifacts(d: Dialect) -> str:
    cases = d.rows("c", "doc_id BIGINT, ord BIGINT, text STRING", [(-1, 1, "________________"), (-1, 2, ". . . . . . ."), (-1, 3, "Name: ____"), (-1, 4, "-----_____.....")])
    return f"SELECT doc_id, ord, 'writing_line' AS reason FROM (SELECT doc_id, ord, text FROM {d.t('lines')} UNION ALL SELECT doc_id, ord, text FROM {cases}) x WHERE {d.full('text', WRITING_LINE)}"


def _list_items(d: Dialect) -> str:
    w = "OVER (PARTITION BY doc_id, page_number ORDER BY ord)"
    return f"""SELECT doc_id, page_number, ord, CASE WHEN lone THEN 'P' ELSE role END AS role, lone AS demoted FROM (
      SELECT doc_id, page_number, ord, role, role = 'LI' AND coalesce(lag(role) {w}, '') <> 'LI' AND coalesce(lead(role) {w}, '') <> 'LI' AND NOT {d.match('trim(text)', LIST_MARKER)} AS lone FROM {d.t('elements')}) x"""


def _epigraphs(d: Dialect) -> str:
    head = "min(CASE WHEN role IN ('H1', 'H2', 'H3') THEN ord END) OVER (PARTITION BY doc_id, page_number)"
    return f"""SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN ord >= first_heading THEN 2 WHEN epigraph THEN 1 ELSE 0 END, ord) AS new_ord FROM (
      SELECT doc_id, ord, coalesce(first_heading, ord + 1) AS first_heading, role = 'P' AND {d.match('text', EPIGRAPH)} AS epigraph FROM (
        SELECT doc_id, page_number, ord, role, text, {head} AS first_heading FROM {d.t('elements')} WHERE page_number = 1) y) x"""


def _running_headers(d: Dialect) -> str:
    first = f"lower(min_by(text, {d.struct('page_number', 'ord')}))"
    title = f"SELECT doc_id, {d.ws_norm(first)} AS title FROM {d.t('elements')} WHERE role = 'DocumentTitle' GROUP BY doc_id"
    return f"""SELECT doc_id, page_number, ord, CASE WHEN role = 'DocumentTitle' AND nth = 1 AND page_number = 1 THEN 'title' WHEN running AND (role = 'DocumentTitle' OR t < 180) THEN 'artifact' WHEN role = 'DocumentTitle' THEN 'H1' ELSE role END AS outcome FROM (
      SELECT e.doc_id, e.page_number, e.ord, e.role, e.t, row_number() OVER (PARTITION BY e.doc_id, e.role, e.page_number ORDER BY e.ord) AS nth,
             e.page_number > 1 AND coalesce(h.title, '') <> '' AND contains({d.ws_norm('lower(e.text)')}, h.title) AS running
      FROM {d.t('elements')} e LEFT JOIN ({title}) h ON e.doc_id = h.doc_id) x"""


def _islands(d: Dialect) -> str:
    w = "PARTITION BY doc_id, page_number ORDER BY ord"
    return f"""SELECT doc_id, page_number, island, min(ord) AS first_ord, count(*) AS n_items FROM (
      SELECT *, sum(starts) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
        SELECT doc_id, page_number, ord, role, CASE WHEN role = 'LI' AND coalesce(lag(role) OVER ({w}), '') <> 'LI' THEN 1 ELSE 0 END AS starts FROM {d.t('elements')}) y) x
      WHERE role = 'LI' GROUP BY doc_id, page_number, island"""


def _grid(d: Dialect) -> str:
    """Lines of an order as table cells: row part mod 3, column line number mod 4."""
    cells = f"(SELECT DISTINCT l_orderkey AS table_id, l_partkey % 3 AS row_no, CAST(l_linenumber % 4 AS BIGINT) AS col_no FROM {d.t('lineitem')})"
    bounds = f"(SELECT table_id, max(col_no) + 1 AS n_cols FROM {cells} c GROUP BY table_id)"
    rows = f"(SELECT DISTINCT c.table_id, c.row_no, b.n_cols FROM {cells} c JOIN {bounds} b ON c.table_id = b.table_id)"
    slots = d.seq(f"{rows} q", "0", "n_cols - 1", "col_no")
    return f"""SELECT table_id, row_no, col_no, row_number() OVER (PARTITION BY table_id ORDER BY row_no, col_no) AS cell_ord, added FROM (
      SELECT s.table_id, s.row_no, s.col_no, c.table_id IS NULL AS added FROM {slots} s LEFT JOIN {cells} c ON s.table_id = c.table_id AND s.row_no = c.row_no AND s.col_no = c.col_no) x"""


def _geometry(d: Dialect) -> str:
    """Boxes of unknown space: points where none exceeds the page by 5 %, else normalised; clamped and sorted."""
    src = f"(SELECT doc_id, page_number, ord, l, t * (1 + page_id % 2) AS t, r, b * (1 + page_id % 2) AS b FROM {d.t('elements')})"
    clamp = lambda x: f"greatest(CAST(0 AS DOUBLE), least(CAST(1000 AS DOUBLE), {x}))"
    y = lambda v: clamp(f"CASE WHEN points THEN {v} / 1200 * 1000 ELSE {v} END")
    x = lambda v: clamp(f"CASE WHEN points THEN {v} / 1000 * 1000 ELSE {v} END")
    return f"""SELECT doc_id, page_number, ord, points, round(least({x('l')}, {x('r')}), 3) AS left_1000, round(least({y('t')}, {y('b')}), 3) AS top_1000, round(greatest({x('l')}, {x('r')}), 3) AS right_1000, round(greatest({y('t')}, {y('b')}), 3) AS bottom_1000 FROM (
      SELECT *, max(greatest(l, t, r, b)) OVER (PARTITION BY doc_id, page_number) <= 1200 * 1.05 AS points FROM {src} s) x"""


def _words(d: Dialect) -> str:
    """Words of every element, dealt evenly over its band."""
    words = d.explode(f"(SELECT doc_id, page_number, ord, t, b, {d.split('text', ' ')} AS w FROM {d.t('elements')})", "w", "word_ord", "word")
    return f"(SELECT doc_id, page_number, ord AS own_ord, word_ord, word, 1000.0 * (word_ord - 1) / {d.size('w')} AS l, t, 1000.0 * word_ord / {d.size('w')} AS r, b FROM {words} x WHERE word <> '')"


def _words_in(d: Dialect) -> str:
    return f"""SELECT e.doc_id, e.page_number, e.ord, count(*) AS n_words, CAST(sum(CASE WHEN w.own_ord = e.ord THEN 1 ELSE 0 END) AS BIGINT) AS n_own
      FROM {d.t('elements')} e JOIN {_words(d)} w ON e.doc_id = w.doc_id AND e.page_number = w.page_number
       AND (w.l + w.r) / 2 BETWEEN e.l - 3 AND e.r + 3 AND (w.t + w.b) / 2 BETWEEN e.t - 3 AND e.b + 3 GROUP BY e.doc_id, e.page_number, e.ord"""


def _boxes(d: Dialect) -> str:
    """Elements as boxes of differing width and height."""
    return f"(SELECT doc_id, page_number, ord, element_id, CAST((ord * 37) % 500 AS DOUBLE) AS l, t - ord % 3 * 4 AS t, CAST((ord * 37) % 500 + 120 + ord % 5 * 60 AS DOUBLE) AS r, b + ord % 2 * 6 AS b FROM {keyed(d)})"


def _collisions(d: Dialect) -> str:
    return f"SELECT x.doc_id, x.page_number, x.ord AS left_ord, y.ord AS right_ord FROM {_boxes(d)} x JOIN {_boxes(d)} y ON x.doc_id = y.doc_id AND x.page_number = y.page_number AND x.ord < y.ord AND {overlap('x', 'y')}"


def _corridor(d: Dialect) -> str:
    """Room to either side of a box on its line; null where another box stands in it."""
    return f"""SELECT x.doc_id, x.page_number, x.ord,
      CASE WHEN coalesce(bool_or(y.ord IS NOT NULL AND y.r > x.l AND y.l < x.r), FALSE) THEN NULL ELSE greatest(least(max(x.l), 18.0), coalesce(max(CASE WHEN y.r <= x.l THEN y.r + 5 END), 0.0)) END AS left_limit,
      CASE WHEN coalesce(bool_or(y.ord IS NOT NULL AND y.r > x.l AND y.l < x.r), FALSE) THEN NULL ELSE least(greatest(max(x.r), 982.0), coalesce(min(CASE WHEN y.l >= x.r THEN y.l - 5 END), 1000.0)) END AS right_limit
      FROM {_boxes(d)} x LEFT JOIN {_boxes(d)} y ON x.doc_id = y.doc_id AND x.page_number = y.page_number AND x.ord <> y.ord AND {same_line('x', 'y')} GROUP BY x.doc_id, x.page_number, x.ord"""


def _consensus(d: Dialect) -> str:
    moved = f"(SELECT doc_id, page_number, CAST((page_id * 7 + ord * 3) % 45 AS DOUBLE) AS dx, CAST((page_id + ord * 5) % 9 AS DOUBLE) AS dy FROM {d.t('elements')})"
    return f"""SELECT doc_id, page_number, count(*) AS n_moved, median(dx) AS shift_x, median(dy) AS shift_y FROM {moved} x WHERE abs(dx) > 1 OR abs(dy) > 1
      GROUP BY doc_id, page_number HAVING count(*) >= 2 AND max(dx) - min(dx) <= 40 AND max(dy) - min(dy) <= 40"""


def _fill(d: Dialect) -> str:
    """Placements without a value take the previous one of their user, else the next."""
    w = "PARTITION BY user_id ORDER BY ts, event_id"
    return f"""SELECT event_id, coalesce(p, {d.last_value('p')} OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {d.first_value('p')} OVER ({w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS placement
      FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS p FROM {d.t('events')}) x"""


def _logical(d: Dialect) -> str:
    """Logical lines of a document's chunks (words with the white space behind them): one ends after a chunk with a line break."""
    chunks = d.explode(f"(SELECT doc_id, {d.extract_all(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')', rf'[^{WS}]+[{WS}]*')} AS p FROM {d.t('documents')}) s", "p", "nth", "chunk")
    return f"""SELECT doc_id, line_no, min(nth) AS first_chunk, count(*) AS n_chunks, CAST(sum(length(chunk)) AS BIGINT) AS n_chars FROM (
      SELECT doc_id, nth, chunk, coalesce(sum(CASE WHEN {d.match('chunk', '[\\r\\n]')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no FROM {chunks} c) x GROUP BY doc_id, line_no"""


def _outline(d: Dialect) -> str:
    return f"SELECT doc_id, page_number, ord, role, substring(text, 1, 240) AS title, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY ord) - 1 AS mcid FROM {d.t('elements')} WHERE role IN ('DocumentTitle', 'H1', 'H2')"


def _component_pairs(d: Dialect) -> str:
    """Paragraph boxes of a page within 12 of each other, each pair once."""
    p = f"(SELECT doc_id, page_number, ord, l, t, r, b FROM {d.t('elements')} WHERE role = 'P')"
    return f"SELECT x.doc_id, x.page_number, x.ord AS a, y.ord AS z FROM {p} x JOIN {p} y ON x.doc_id = y.doc_id AND x.page_number = y.page_number AND x.ord < y.ord AND greatest(0.0, greatest(x.t, y.t) - least(x.b, y.b)) <= 12 AND greatest(0.0, greatest(x.l, y.l) - least(x.r, y.r)) <= 12"


def _source_choice(d: Dialect) -> str:
    """Of two word sources the better aligned one; a tie keeps the first."""
    q = f"(SELECT doc_id, page_number, 'ocr' AS source, 0 AS rank_no, avg(conf) AS quality FROM {d.t('elements')} GROUP BY doc_id, page_number UNION ALL SELECT doc_id, page_number, 'native' AS source, 1 AS rank_no, avg(agree) AS quality FROM {d.t('elements')} GROUP BY doc_id, page_number)"
    return f"SELECT doc_id, page_number, CASE WHEN max(CASE WHEN source = 'native' THEN quality END) > max(CASE WHEN source = 'ocr' THEN quality END) THEN 'native' ELSE 'ocr' END AS source FROM {q} x GROUP BY doc_id, page_number"


QUERIES = {
    "page_elements_scan": (("elements",), _scan),
    "furniture_fingerprints": (("elements",), repeated_furniture),
    "artifact_reasons": (("elements",), _artifacts),
    "fragment_artifacts": (("lines",), _fragment_artifacts),
    "isolated_list_items": (("elements",), _list_items),
    "epigraph_order": (("elements",), _epigraphs),
    "running_headers": (("elements",), _running_headers),
    "list_islands": (("elements",), _islands),
    "table_grid_completion": (("lineitem",), _grid),
    "geometry_normalize": (("elements",), _geometry),
    "words_in_fragment": (("elements",), _words_in),
    "region_collisions": (("elements",), _collisions),
    "widen_corridor": (("elements",), _corridor),
    "consensus_shift": (("elements",), _consensus),
    "geometry_source_choice": (("elements",), _source_choice),
    "fragment_proximity": (("elements",), _component_pairs),
    "placement_fill": (("events",), _fill),
    "logical_lines": (("documents",), _logical),
    "outline": (("elements",), _outline),
}
