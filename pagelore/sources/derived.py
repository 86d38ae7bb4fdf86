"""Plan tables that the stored tables stand in for.

Each is SQL over stored or other derived tables, in a dialect's spelling, so that a rule's
query and its oracle read the same rows. The rows are this library's invention; the rules
themselves take any table of these columns (:func:`pagelore.registry.apply`).
"""

from __future__ import annotations

from collections.abc import Callable

from pagelore.functions.dialect import Dialect


def _ambiguities(d: Dialect) -> str:
    return f"SELECT doc_id, page_number, CAST(1 AS BIGINT) AS nth, 'The page has no heading.' AS message FROM {d.t('elements')} GROUP BY doc_id, page_number HAVING count_if(role = 'H1') = 0"


def _page_findings(d: Dialect) -> str:
    return f"SELECT doc_id, page_number, CAST(1 AS BIGINT) AS nth, 'info' AS severity, 'reading_order' AS category, 'The  page has many elements.' AS message, CAST(NULL AS STRING) AS chosen FROM {d.t('elements')} GROUP BY doc_id, page_number HAVING count(*) > 20"


def _element_findings(d: Dialect) -> str:
    """Two findings on loud elements, the second one a repetition."""
    loud = f"(SELECT doc_id, page_number, ord, CASE WHEN contains(text, '!!') THEN 'critical' ELSE 'warning' END AS severity, substring(text, 1, 300) AS chosen FROM {d.t('elements')} WHERE contains(text, '!!') OR contains(text, '###') OR contains(text, '$$$'))"
    pick = "SELECT doc_id, page_number, ord, CAST({n} AS BIGINT) AS nth, severity, 'transcription' AS category, {m} AS message, {c} AS chosen FROM {src} a{n}"
    return pick.format(n=1, m="'Text needs a second look.'", c="chosen", src=loud) + " UNION ALL " + pick.format(n=2, m="' Text needs  a second look. '", c="'again'", src=loud)


def _changes(d: Dialect) -> str:
    """The first two spaces of an element spoken as ', ': some with spans that are shifted, absent or overlapping."""
    p1 = "CAST(strpos(text, ' ') - 1 AS BIGINT)" if d.name == "duck" else "CAST(instr(text, ' ') - 1 AS BIGINT)"
    tail = "substring(text, CAST(p1 + 2 AS INT))"
    p2 = f"CAST(strpos({tail}, ' ') + p1 AS BIGINT)" if d.name == "duck" else f"CAST(instr({tail}, ' ') + p1 AS BIGINT)"
    base = f"(SELECT concat(doc_id, '/', CAST(page_number AS STRING), '/', CAST(ord AS STRING)) AS id, role, page_id + ord AS k, text, p1, {p2} AS p2 FROM (SELECT *, {p1} AS p1 FROM {d.t('elements')} WHERE contains(text, ' ')) x)"
    spoken = "concat(substring(text, 1, CAST(p1 AS INT)), ', ', substring(text, CAST(p1 + 2 AS INT)))"
    both = f"CASE WHEN p2 > p1 THEN concat(substring({spoken}, 1, CAST(p2 + 1 AS INT)), ', ', substring(text, CAST(p2 + 2 AS INT))) ELSE {spoken} END"
    cols = f"id, role, text AS visible, {both} AS accessible"
    return f"""SELECT {cols}, CAST(1 AS BIGINT) AS nth, CASE WHEN k % 11 = 0 THEN NULL ELSE p1 + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END END AS s0, p1 + 1 + CASE WHEN k % 5 = 0 THEN p2 - p1 ELSE 0 END AS s1, p1 AS t0, p1 + 2 AS t1,
        CASE WHEN k % 13 = 0 THEN '' ELSE ' ' END AS source, ', ' AS replacement, CASE WHEN k % 13 = 0 THEN 'formula_spoken_equivalent' ELSE 'structural_separator_normalization' END AS kind FROM {base} a
      UNION ALL SELECT {cols}, CAST(2 AS BIGINT) AS nth, p2 AS s0, p2 + 1 AS s1, p2 + 1 AS t0, p2 + 3 AS t1, ' ' AS source, ', ' AS replacement, 'structural_separator_normalization' AS kind FROM {base} b WHERE p2 > p1"""


def _text_changes(d: Dialect) -> str:
    """Neighbouring words' separators as the two sides of a change."""
    pieces = d.explode(f"(SELECT doc_id, page_number, ord, {d.extract_all('text', '[^A-Za-z0-9]+')} AS p FROM {d.t('lines')}) s", "p", "nth", "s")
    return f"SELECT doc_id, ord, nth, s, CASE (doc_id + nth) % 4 WHEN 0 THEN '' WHEN 1 THEN ', ' WHEN 2 THEN ' ' ELSE ' to ' END AS r FROM {pieces} x"


def _findings(d: Dialect) -> str:
    """Findings on what two roles say: the message is a sentence of the resolver's vocabulary."""
    words = ("'The first-model bbox values were image-pixel coordinates.'", "'Running header and page number are omitted.'", "'The proposal omitted a line; the canonical page restores it.'", "'The first proposal used H2; canonical plan uses P.'", "'Proposal read Smyth; the page image supports Smith.'", "'Proposal read Smyth; the image is ambiguous evidence.'", "'Unclear word.'")
    kinds = ("geometry", "content_coverage", "content_coverage", "semantic_role", "name", "transcription", "date_number")
    message = "CASE (conv_id + turn) % 7 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(words)) + " END"
    kind = "CASE conv_id % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " ELSE 'formula' END"
    return f"SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'warning' ELSE 'critical' END AS severity, {kind} AS category, {message} AS message, CASE WHEN length(coalesce(text, '')) % 4 = 0 THEN NULL ELSE substring(text, 1, 20) END AS chosen FROM {d.t('conversations')}"


def _cells(d: Dialect) -> str:
    """Orders as pages of table cells, two a row; some without a place, out of order or without a scope."""
    nth = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"
    return f"""SELECT concat('c', CAST(page AS STRING), '-', CAST(ord AS STRING)) AS id, page, ord, role, text AS visible, CASE WHEN k % 31 = 0 THEN ' ' ELSE text END AS accessible, CASE WHEN k % 37 = 0 THEN NULL WHEN k % 41 = 0 THEN 'other' ELSE 'table' END AS table_id,
        CASE WHEN k % 43 = 0 THEN NULL WHEN k % 29 = 0 THEN 0 ELSE (ord - 1 - (ord - 1) % 2) / 2 END AS row_no, CASE WHEN k % 47 = 0 THEN 5000 ELSE (ord - 1) % 2 END AS col_no, CASE WHEN role = 'TH' AND k % 23 <> 0 THEN 'Column' WHEN role = 'TD' AND k % 53 = 0 THEN 'Row' END AS scope
      FROM (SELECT l_orderkey AS page, CAST({nth} AS BIGINT) AS ord, l_partkey AS k, CASE WHEN l_linenumber = 1 THEN 'TH' WHEN l_partkey % 19 = 0 THEN 'P' ELSE 'TD' END AS role, l_linestatus AS text FROM {d.t('lineitem')}) x""".replace(
        "(ord - 1 - (ord - 1) % 2) / 2", d.idiv("ord - 1", "2")
    )


def _widgets(d: Dialect) -> str:
    """Parts as the widgets of a brand's form, on pages by size."""
    return f"""SELECT doc_id, page, idx, tooltip, CASE WHEN k % 17 = 0 THEN '' WHEN k % 11 = 0 THEN kind ELSE tooltip END AS label, kind, k AS obj, CASE WHEN k % 19 = 0 THEN NULL ELSE tooltip END AS description FROM (
      SELECT p_brand AS doc_id, CAST(p_size AS BIGINT) AS page, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS idx, CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN concat('Text field ', CAST(p_size AS STRING)) ELSE p_name END AS tooltip, p_type AS kind, p_partkey AS k FROM {d.t('part')}) x"""


def _sources(d: Dialect) -> str:
    return f"""SELECT s_suppkey AS id, s_name AS c1, CASE WHEN s_suppkey % 3 = 0 THEN '  ' ELSE concat('Tool ', CAST(s_nationkey AS STRING)) END AS c2, concat(' ', s_name) AS c3, CASE WHEN s_suppkey % 2 = 0 THEN concat('Tool ', CAST(s_nationkey AS STRING), ' ') END AS c4,
      CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('D:', lpad(CAST(20060000000000 + s_suppkey AS STRING), 14, '0'), 'Z') WHEN 2 THEN 'yesterday' ELSE 'D:19991231235959' END AS created, CASE WHEN s_suppkey % 7 = 0 THEN '2001-01-01' END AS xmp_created FROM {d.t('supplier')}"""


def _links(d: Dialect) -> str:
    """The first two links of a page."""
    found = d.explode(f"(SELECT page_id, {d.extract_all(chr(99) + 'oalesce(html, ' + chr(39) * 2 + ')', '<a [^>]*>[^<]*')} AS a FROM {d.t('pages')}) s", "a", "nth", "link")
    href, text = d.extract("link", "href=\"([^\"]*)\"", 1), d.extract("link", ">([^<]*)$", 1)
    return f"SELECT page_id AS id, nth, CASE WHEN nth % 2 = 0 THEN {text} END AS contents, CASE WHEN page_id % 5 = 0 THEN NULL ELSE nullif({href}, '') END AS uri, page_id % 10 = 0 AS internal FROM {found} x"


def _plans(d: Dialect) -> str:
    """Plans of pages as JSON of schema versions 1 to 7."""
    body = "concat('{\"schema_version\":', CAST(page_id % 7 + 1 AS STRING), CASE WHEN page_id % 3 = 0 THEN '' ELSE concat(',\"plan_revision\":', CAST(page_id % 12 AS STRING)) END, ',\"review_status\":\"', CASE page_id % 4 WHEN 0 THEN 'proposal' WHEN 1 THEN 'manual_modified' ELSE 'model_reviewed' END, '\"}')"
    return f"SELECT page_id AS id, {body if d.name == 'duck' else body.replace('{', '{{').replace('}', '}}')} AS plan FROM {d.t('pages')}"


def _old_elements(d: Dialect) -> str:
    """Events as elements of older plans, in JSON."""
    body = "concat('{', CASE WHEN event_id % 3 = 0 THEN '\"visible_text\":\"seen\",' ELSE '' END, CASE WHEN event_id % 4 = 0 THEN '\"accessible_text\":\"spoken\",' ELSE '' END, CASE WHEN event_id % 5 = 0 THEN concat('\"confidence\":0.', CAST(event_id % 90 + 10 AS STRING), ',') ELSE '' END, CASE WHEN event_id % 7 = 0 THEN '\"ambiguity\":\"unsure\",' ELSE '' END, '\"text\":\"', event_type, '\"}')"
    return f"SELECT event_id AS id, {body if d.name == 'duck' else body.replace('{', '{{').replace('}', '}}')} AS e FROM {d.t('events')}"


def _extractions(d: Dialect) -> str:
    return f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS rc, CASE WHEN o_orderkey % 120 = 0 THEN NULL ELSE 1 - CAST(o_custkey % 25 AS DOUBLE) / 1000 END AS ratio, o_orderkey % 120 AS expected, CASE WHEN o_orderkey % 120 = 0 THEN o_custkey % 2 ELSE o_orderkey % 120 + o_custkey % 5 - 2 END AS actual FROM {d.t('orders')}"


#: Columns of a file's own metadata that must equal what is expected of it.
EXPECTED = ("original_encoding_software", "info_original_encoding", "author", "subject", "keywords", "xmp_authors", "description", "xmp_keywords", "creation_date", "xmp_creation_date", "source_sha256", "canonical_plan_sha256")


def _file_metadata(d: Dialect) -> str:
    """Customers as output files; every column is right but for a few rows."""
    fixed = {"tool": "'tool'", "version": "'1'", "remediation_date": "'2026-01-01'", "schema_version": "'7'", "producer": "'producer'", "creator": "NULL", "xmp_creator_tool": "''", "remediation": "'summary'", "info_remediation": "'summary'"}
    cols = [f"CASE WHEN c_custkey % {211 + 2 * i} = 0 THEN 'x{i % 2}' ELSE {v} END AS {k}" for i, (k, v) in enumerate(fixed.items()) if k != "remediation_date"] + ["CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE '2026-01-01' END AS remediation_date"]
    for i, k in enumerate(EXPECTED):
        cols += [f"CASE WHEN c_custkey % {101 + 2 * i} = 0 THEN 'wrong' WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS {k}", f"CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 8 = 0 THEN '' END ELSE c_mktsegment END AS expected_{k}"]
    return f"SELECT c_custkey AS id, c_custkey % 6 <> 0 AS has_plan, {', '.join(cols)} FROM {d.t('customer')}"


#: Checks of a release, in the order of the report.
CHECKS = ("visual_match", "source_visual_fidelity_ok", "page_count_match", "qpdf_ok", "structure_matches_plan", "fully_tagged", "page_labels_present", "transformations_valid", "block_plan_valid", "form_fields_preserved", "form_descriptions_match_plan", "form_accessibility_policy_ok", "extraction_compatible", "declares_pdfua", "remediation_metadata_valid", "verapdf_pdfua_ok")


def _checks(d: Dialect) -> str:
    """One row a document and check; a check that wasn't run has a null, and some are absent."""
    names = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS nth, '{c}' AS name" for i, c in enumerate(CHECKS))
    docs = f"(SELECT doc_id, min(page_id) AS k FROM {d.t('elements')} GROUP BY doc_id)"
    return f"SELECT doc_id, name, CASE WHEN (k + 7 * nth) % 61 = 0 THEN FALSE WHEN (k + 5 * nth) % 67 = 0 THEN NULL ELSE TRUE END AS ok FROM {docs} q CROSS JOIN ({names}) n WHERE (k + 3 * nth) % 71 <> 0"  # sixteen fixed rows


def _fragments(d: Dialect) -> str:
    """Elements' words as three fragments of their box, the middle one moved away for some elements."""
    words = f"(SELECT doc_id, page_id, page_number, ord, l, t, r, b, {d.split('text', ' ')} AS w FROM {d.t('elements')} WHERE role IN ('P', 'H1'))"
    each = d.explode(f"{words} s", "w", "i", "word")
    part = d.idiv("3 * (i - 1)", "n")
    parts = f"(SELECT *, {part} AS part FROM (SELECT *, {d.size('w')} AS n FROM {each} x) y)"
    text = d.agg_join("word", " ", "i")
    return f"""SELECT doc_id, page_number, ord, part + 1 AS nth, {text} AS text, min(l) + 300 * part + CASE WHEN part = 1 AND min(page_id + ord) % 3 = 0 THEN 2000 ELSE 0 END AS l, min(t) AS t,
      min(l) + 300 * part + CASE WHEN part = 1 AND min(page_id + ord) % 3 = 0 THEN 2000 ELSE 0 END + CASE WHEN min(page_id + ord) % 5 = 0 THEN 200 ELSE 290 END AS r, min(b) AS b FROM {parts} p GROUP BY doc_id, page_number, ord, part"""


def _words(d: Dialect) -> str:
    """Words of a page with their boxes and their block, line and word numbers, from two readers."""
    each = d.explode(f"(SELECT doc_id, page_id, page_number, ord, t, b, {d.split('text', ' ')} AS w FROM {d.t('elements')}) s", "w", "i", "word")
    box = f"1000.0 * (i - 1) / {d.size('w')} AS l, t, 1000.0 * i / {d.size('w')} AS r, b" if d.name == "spark" else f"CAST(1000 AS DOUBLE) * (i - 1) / {d.size('w')} AS l, t, CAST(1000 AS DOUBLE) * i / {d.size('w')} AS r, b"
    box = box.replace("1000.0 *", "CAST(1000 AS DOUBLE) *")
    word = f"(SELECT doc_id, page_id, page_number, ord, i, word, {box} FROM {each} x WHERE word <> '')"
    cols = "doc_id, page_number, l, t, r, b, word AS text, ord - 1 AS block_no, CAST(0 AS BIGINT) AS line_no, i - 1 AS word_no"
    return f"SELECT 'native' AS source, {cols} FROM {word} n UNION ALL SELECT 'ocr' AS source, {cols} FROM {word} o WHERE (page_id + page_number) % 3 <> 0"


def _annotations(d: Dialect) -> str:
    """Events of a user as the annotations of a page, in order."""
    return f"SELECT user_id AS page, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS annotation_index, CASE WHEN event_type = 'click' THEN 'Widget' ELSE 'Link' END AS subtype, event_id AS obj FROM {d.t('events')}"


def _field_edges(d: Dialect) -> str:
    """Parts under types under brands as a form's field tree, with a kid that is its own ancestor."""
    return f"""SELECT DISTINCT 'root' AS parent, p_brand AS kid, CAST(NULL AS STRING) AS field_type FROM {d.t('part')} UNION ALL SELECT DISTINCT p_brand AS parent, concat(p_brand, '/', CAST(p_size AS STRING)) AS kid, CASE WHEN p_size % 2 = 0 THEN 'Tx' END AS field_type FROM {d.t('part')}
      UNION ALL SELECT concat(p_brand, '/', CAST(p_size AS STRING)) AS parent, concat('part', CAST(p_partkey AS STRING)) AS kid, CASE WHEN p_partkey % 3 = 0 THEN 'Btn' END AS field_type FROM {d.t('part')} UNION ALL SELECT DISTINCT p_brand AS parent, p_brand AS kid, CAST(NULL AS STRING) AS field_type FROM {d.t('part')}"""


def _planned(d: Dialect) -> str:
    """What a plan says of its elements: role, text, alternative text, findings."""
    return f"SELECT doc_id, page_number, ord, CASE WHEN (page_id + ord) % 12 = 0 THEN 'Figure' ELSE role END AS role, text AS visible_text, text AS accessible_text, CASE WHEN (page_id + ord) % 24 = 0 THEN NULL WHEN (page_id + ord) % 36 = 0 THEN ' ' ELSE concat('Picture of ', text) END AS alt_text, t, b FROM {d.t('elements')}"


def _records(d: Dialect) -> str:
    """What an output file's structure tree says of the same elements: some are split in two, differ or are absent."""
    cut = "CAST(length(text) / 2 AS INT)" if d.name == "spark" else "CAST(length(text) // 2 AS INT)"
    if d.name == "spark":
        cut = "CAST(length(text) div 2 AS INT)"
    k = "(page_id + ord)"
    return f"""SELECT doc_id, (page_number * 1000000 + ord) * 2 AS record_ord, CASE WHEN {k} % 17 = 0 THEN 'Span' ELSE role END AS role, CASE WHEN {k} % 3 = 0 THEN substring(text, 1, {cut}) WHEN {k} % 29 = 0 THEN concat(text, '?') ELSE text END AS text FROM {d.t('elements')} WHERE {k} % 41 <> 0
      UNION ALL SELECT doc_id, (page_number * 1000000 + ord) * 2 + 1 AS record_ord, role, substring(text, {cut} + 1) AS text FROM {d.t('elements')} WHERE {k} % 41 <> 0 AND {k} % 3 = 0"""


DERIVED: dict[str, tuple[tuple[str, ...], Callable[[Dialect], str]]] = {
    "ambiguities": (("elements",), _ambiguities),
    "page_findings": (("elements",), _page_findings),
    "element_findings": (("elements",), _element_findings),
    "changes": (("elements",), _changes),
    "text_changes": (("lines",), _text_changes),
    "findings": (("conversations",), _findings),
    "cells": (("lineitem",), _cells),
    "widgets": (("part",), _widgets),
    "sources": (("supplier",), _sources),
    "links": (("pages",), _links),
    "plans": (("pages",), _plans),
    "old_elements": (("events",), _old_elements),
    "extractions": (("orders",), _extractions),
    "file_metadata": (("customer",), _file_metadata),
    "checks": (("elements",), _checks),
    "fragments": (("elements",), _fragments),
    "words": (("elements",), _words),
    "annotations": (("events",), _annotations),
    "field_edges": (("part",), _field_edges),
    "planned": (("elements",), _planned),
    "records": (("elements",), _records),
}
