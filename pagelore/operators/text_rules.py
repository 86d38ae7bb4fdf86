"""Text rules: tokens, fingerprints, markers, dates, kinds, categories, descriptions.

Every function gives a SQL expression over a :class:`~pagelore.functions.dialect.Dialect`;
``QUERIES`` applies them to whole tables (and to literal cases where no stored table has
such text)."""

from __future__ import annotations

from pagelore.functions.dialect import WORD, WS, Dialect

# Months, markers, ligatures, formula characters, generic descriptions, categories,
# rationales; and, in transformation_kind and resolved, the order of the branches and their messages.
SPACE = "\\t-\\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MONTHS = r"Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
LIGATURES = "[ﬀﬁﬂﬃﬄﬅﬆ]"
FORMULA_CHARACTERS = r"=<>≤≥≠≈∞∑∫√∂∆∇^₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹ⁿ"
GENERIC = ("enter", "optional", "optional field", "required", "required field", "select")
GENERIC_KINDS = r"(?:(?:text|field|text field|check box|checkbox|radio button|radio|button|choice|combo box|list box|signature) ?)?[0-9]+"
CATEGORIES = (
    "transcription", "name", "date_number", "formula", "geometry", "reading_order", "semantic_role", "continuation", "decoration", "artifact",
    "alt_text", "evidence", "transformation", "content_coverage", "low_confidence", "model_disagreement", "legacy_ambiguity", "page", "other",
)
#: In this order: the first list with a part of the normalised category decides.
CATEGORY_TERMS = (
    ("reading_order", ("reading", "column")),
    ("geometry", ("geometry", "coordinate")),
    ("semantic_role", ("role", "caption", "page_type")),
    ("formula", ("formula", "currency", "math")),
    ("date_number", ("date", "number", "pagination", "address")),
    ("name", ("name", "place", "institution")),
    ("continuation", ("continu", "paragraph_structure")),
    ("decoration", ("decor", "ornament", "footer", "furniture", "running")),
    ("alt_text", ("alt_text", "figure", "graphic")),
    ("transformation", ("transform", "hyphen", "spacing", "ligature")),
    ("evidence", ("evidence", "ocr", "source_reliability")),
    ("content_coverage", ("omission", "coverage", "content_scope")),
    ("transcription", ("transcription", "spelling", "wording", "punctuation", "capitalization", "abbreviation", "typography", "glyph")),
)
_ANY, _NONE, _STOP, _SPACE = r"(?s).*", r"\A\z", rf"\A[{SPACE}]*[,;:][{SPACE}]*\z", rf"\A[{SPACE}]*\z"
#: Kinds of changes in the order in which they are tried: (kind, pattern of what was, pattern of what is).
CHANGE_PATTERNS = (
    ("soft_hyphen_removal", "\xad", _ANY),
    ("ligature_expansion", LIGATURES, _ANY),
    ("line_break_dehyphenation", r"(?s)-.*[\r\n]|[\r\n].*-", _NONE),
    ("decorative_marker_omission", rf"\A[{SPACE}←→⟵⟶]+\z", _NONE),
    ("structural_separator_normalization", rf"\A[{SPACE}.·…_]*\z|\A[{SPACE}]*[|][{SPACE}]*\z", _STOP),
    ("date_range_expansion", r"\A–\z", r"\A to \z"),
    ("decorative_leader_omission", rf"\A[{SPACE}]*[.·…_][{SPACE}.·…_]*\z", _SPACE),
    ("whitespace_normalization", _SPACE, _SPACE),
)
RATIONALES = {
    "line_break_dehyphenation": "Joins a word split only by a printed line break.",
    "ligature_expansion": "Expands a presentation ligature to Unicode letters.",
    "soft_hyphen_removal": "Removes a discretionary soft hyphen.",
    "formula_spoken_equivalent": "Supplies a spoken equivalent for mathematical notation.",
    "decorative_leader_omission": "Omits visual leader characters from speech.",
    "decorative_marker_omission": "Omits a reviewed visual marker that is not meaningful in linear speech.",
    "inline_list_separator_omission": "Omits punctuation or a conjunction used only to separate items in a compact visual list.",
    "structural_separator_normalization": "Supplies spoken punctuation between adjacent labeled entries.",
    "date_range_expansion": "Expands an en dash in a month-and-day range to the spoken word 'to'.",
    "whitespace_normalization": "Normalizes layout whitespace for continuous reading.",
    "unverified": "The textual change is not one of the approved mechanical transformations.",
}


# ------------------------------------------------------------------ expressions


def comparison_tokens(d: Dialect, x: str) -> str:
    return d.extract_all(f"lower({x})", rf"[{WORD}]+|[^{WORD}{WS}]")


def sensitive_tokens(d: Dialect, x: str) -> str:
    """URLs, capitalised words, numbers and runs of punctuation, sorted and distinct."""
    found = d.extract_all(d.bounded(x), rf"https?://[^{WS}]+|\b[A-Z][A-Za-z'’-]{{2,}}\b|\b[0-9][0-9,./:-]*\b|[^{WS}{WORD}]{{2,}}")
    return d.sorted(d.distinct(found))


def spoken_dates(d: Dialect, x: str) -> str:
    return d.replace(x, d.fold_i(rf"\b({MONTHS})[{WS}]+([0-9]{{1,2}})–([0-9]{{1,2}})\b"), r"\1 \2 to \3")


def has_static_markers(d: Dialect, x: str) -> str:
    return d.match(x, "_{3,}|[☐□◻]")


def without_markers(d: Dialect, x: str) -> str:
    x = d.replace(x, rf"_{{3,}}(?:[{WS}]*-[{WS}]*_{{3,}})+", "")
    x = d.replace(d.replace(x, "_{3,}", ""), "[☐□◻]", "")
    return f"trim({d.replace(d.ws_norm(x), rf'[{WS}]+([,;:.])', r'\1')})"


def static_markers(d: Dialect, visible: str, accessible: str) -> str:
    """Accessible text without blank rules and boxes; a reviewed rewrite that has none stays."""
    clean = without_markers(d, f"coalesce(nullif({accessible}, ''), {visible})")
    return f"CASE WHEN {has_static_markers(d, visible)} AND {clean} <> '' THEN {clean} ELSE {accessible} END"


def leaders(d: Dialect, x: str) -> str:
    clean = d.ws_norm(d.replace(x, rf"(?:[{WS}]*\.[{WS}]*){{3,}}", " "))
    return f"CASE WHEN {d.starts(f'lower({x})', 'inside this issue')} OR {d.starts(f'lower({x})', 'contents ')} THEN {clean} ELSE {x} END"


def looks_mathematical(d: Dialect, x: str) -> str:
    return d.match(x, rf"[{FORMULA_CHARACTERS}\p{{Sm}}\x{{370}}-\x{{3ff}}\x{{1d400}}-\x{{1d7ff}}]")


def transformation_kind(d: Dialect, s: str, r: str) -> str:
    """Which mechanical change turns ``s`` into ``r``."""
    branches = " ".join(f"WHEN {d.match(s, was)} AND {d.match(r, now)} THEN '{kind}'" for kind, was, now in CHANGE_PATTERNS)
    return f"CASE {branches} ELSE 'unverified' END"


def rationale(d: Dialect, kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN {d.lit(k)} THEN {d.lit(v)}" for k, v in RATIONALES.items()) + " END"


def category(d: Dialect, raw: str) -> str:
    low = d.replace(d.replace(f"lower({raw})", "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")
    return f"CASE WHEN {d.in_(low, CATEGORIES)} THEN {low} " + " ".join(f"WHEN {d.any_of(low, t)} THEN '{c}'" for c, t in CATEGORY_TERMS) + " ELSE 'other' END"


def generic_description(d: Dialect, x: str) -> str:
    low = d.replace(f"lower({d.strip(x)})", rf"[{WS}_.#-]+", " ")
    return f"({low} = '' OR {d.in_(low, GENERIC)} OR {d.full(low, GENERIC_KINDS)})"


def invalid_ratio(d: Dialect, x: str) -> str:
    """Share of replacement and control characters; 1 for an empty text."""
    bad = d.count(x, r"[\x{fffd}\x{01}-\x{08}\x{0e}-\x{1f}]")
    return f"CASE WHEN {x} = '' THEN CAST(1 AS DOUBLE) ELSE CAST({bad} AS DOUBLE) / length({x}) END"


def fingerprint(d: Dialect, text: str, top: str, bottom: str) -> str:
    """What repeats in page margins: lower-case letters, with # for numbers; null elsewhere."""
    s = f"lower({d.strip(text)})"
    clean = d.ws_norm(d.replace(d.replace(s, r"\p{Nd}+", "#"), "[^a-z#]+", " "))
    return f"CASE WHEN ({bottom} <= 100 OR {top} >= 900) AND length({s}) BETWEEN 1 AND 180 THEN nullif({clean}, '') END"


def resolved(d: Dialect) -> tuple[str, str, str]:
    """(severity, category, chosen) of a finding (severity, category, message, chosen) after
    what the canonical plan resolves; the order of the branches decides."""
    m, has = "lower(message)", lambda *t: d.any_of("lower(message)", t)
    first = has("first-model", "first model", "proposal")
    said = "coalesce(chosen, '') <> ''"
    geometry = f"category = 'geometry' AND {has('first-model', 'first model', 'first proposal', 'proposal', 'proposed element')} AND {has('coordinate', 'geometry', 'bbox', 'boxes', 'image-pixel')}"
    furniture = f"category = 'content_coverage' AND contains({m}, 'running header') AND contains({m}, 'page number')"
    coverage = f"category = 'content_coverage' AND {first} AND {has('omitted', 'missing')} AND {has('canonical', 'restores', 'include')} AND {said}"
    role = f"category = 'semantic_role' AND {has('first-model', 'first proposal', 'proposal')} AND ({has('canonical plan', 'canonical review')} OR (contains({m}, 'image') AND {has('align', 'places', 'supports')}) OR {has('segmentation', 'not separate printed')}) AND {said}"
    evidence = f"category IN ('name', 'transcription', 'date_number') AND {first} AND contains({m}, 'image') AND {has('authoritative', 'evidence', 'read', 'supports')} AND NOT {has('uncertain', 'ambiguous', 'obscured')} AND {said}"
    which = f"CASE WHEN severity <> 'critical' THEN 0 WHEN {geometry} THEN 1 WHEN {furniture} THEN 2 WHEN {coverage} THEN 3 WHEN {role} THEN 3 WHEN {evidence} THEN 4 ELSE 0 END"
    return (
        f"CASE WHEN {which} > 0 THEN 'info' ELSE severity END",
        f"CASE {which} WHEN 2 THEN 'artifact' WHEN 3 THEN 'model_disagreement' WHEN 4 THEN 'model_disagreement' ELSE category END",
        f"CASE {which} WHEN 1 THEN 'Resolved: canonical geometry is normalized and evidence-derived.' WHEN 2 THEN 'Resolved: running furniture remains visible and is explicitly artifacted.'"
        f" WHEN 3 THEN concat('Resolved in canonical plan: ', chosen) WHEN 4 THEN concat('Resolved from authoritative page evidence: ', chosen) ELSE chosen END",
    )


# ------------------------------------------------------------------ queries


def _embedded_blocks(d: Dialect) -> str:
    block = f"concat('block_', CAST(ord - 1 AS STRING), ' ', {d.ws_norm('text')})"
    return f"SELECT doc_id, substring({d.agg_join(block, chr(10), 'ord')}, 1, 24000) AS blocks, count(*) AS n_blocks FROM {d.t('lines')} WHERE {d.ws_norm('text')} <> '' GROUP BY doc_id"


def _exact_tokens(d: Dialect) -> str:
    """Tokens with the offsets of their slices; the starts are running sums over the array, without a shuffle."""
    lead = d.extract("coalesce(text, '')", rf"\A[{WS}]+", 0)
    pieces = d.extract_all("coalesce(text, '')", rf"[^{WS}]+[{WS}]*")
    token = d.replace("piece", rf"[{WS}]+\z", "")
    fold = f"""aggregate(p, named_struct('at', CAST(length({lead}) AS BIGINT), 'starts', CAST(0 AS BIGINT), 'ends', CAST(0 AS BIGINT), 'slices', CAST(0 AS BIGINT)), (a, piece) -> named_struct(
      'at', a.at + length(piece), 'starts', a.starts + a.at, 'ends', a.ends + a.at + length({token}), 'slices', a.slices + a.at + length(piece)))"""
    return f"""SELECT doc_id, CAST(size(p) AS BIGINT) AS n_tokens, f.starts AS sum_start, f.ends AS sum_end, f.slices AS sum_actual_end, f.at AS last_end
      FROM (SELECT doc_id, p, {fold} AS f FROM (SELECT doc_id, text, {pieces} AS p FROM {d.t('documents')}) s) x WHERE size(p) > 0"""


def _comparison(d: Dialect) -> str:
    return f"SELECT doc_id, {d.size('k')} AS n_tokens, {d.size(d.distinct('k'))} AS n_distinct, {d.sha(d.join('k', ' '))} AS tokens_sha FROM (SELECT doc_id, {comparison_tokens(d, 'coalesce(text, ' + chr(39) * 2 + ')')} AS k FROM {d.t('documents')}) x"


def _sensitive(d: Dialect) -> str:
    return f"SELECT doc_id, {d.size('k')} AS n_tokens, {d.join('k', ' ')} AS tokens FROM (SELECT doc_id, {sensitive_tokens(d, 'coalesce(text, ' + chr(39) * 2 + ')')} AS k FROM {d.t('documents')}) x"


def _native_text(d: Dialect) -> str:
    chars = f"CAST(length({d.replace('text', f'[{WS}]', '')}) AS BIGINT)"
    cases = d.rows("c", "doc_id BIGINT, text STRING", [(-1, ""), (-2, "bad�text \x02 here and some more characters"), (-3, "short"), (-4, "just long enough to be usable text")])
    return f"""SELECT doc_id, text_characters, invalid_character_ratio, text_characters >= 20 AND invalid_character_ratio <= 0.005 AS usable_native_text FROM (
      SELECT doc_id, {chars} AS text_characters, {invalid_ratio(d, 'text')} AS invalid_character_ratio FROM (
        SELECT doc_id, coalesce(text, '') AS text FROM {d.t('documents')} UNION ALL SELECT doc_id, text FROM {cases}) u) x"""


_DATE_CASES = [(1, "September 15–17, 2006."), (2, "sept 3–4 and May 1–2"), (3, "March 5-6"), (4, "Maybe 1–2"), (5, "JUNE  10–12")]


def _dates(d: Dialect) -> str:
    cases = d.rows("c", "doc_id BIGINT, ord BIGINT, text STRING", [(-1, i, t) for i, t in _DATE_CASES])
    return f"SELECT doc_id, ord, {spoken_dates(d, 'text')} AS accessible_text FROM (SELECT doc_id, ord, text FROM {d.t('lines')} WHERE contains(text, '–') UNION ALL SELECT doc_id, ord, text FROM {cases}) u"


_MARKER_CASES = [
    (1, "Student Name: __________ UFID______-______ Location: ☐ In-person ☐ Via Zoom ☐ Hybrid", ""),
    (2, "1. 0 to 1/3 full _____ 1/3 to 2/3 full _____", "one. zero to one third full"),
    (3, "_____", ""), (4, "plain", "plain"), (5, "Signed ____ , and dated ____ .", "Signed ____ , and dated ____ ."),
]


def _markers(d: Dialect) -> str:
    cases = d.rows("c", "doc_id BIGINT, ord BIGINT, visible STRING, accessible STRING", [(-1, *c) for c in _MARKER_CASES])
    return f"SELECT doc_id, ord, {static_markers(d, 'visible', 'accessible')} AS accessible_text FROM (SELECT doc_id, ord, text AS visible, text AS accessible FROM {d.t('lines')} WHERE {has_static_markers(d, 'text')} UNION ALL SELECT doc_id, ord, visible, accessible FROM {cases}) u"


_LEADER_CASES = [(1, "INSIDE THIS ISSUE Notes from the Chair . . . . . 1 Faculty Notes . . . . 2"), (2, "Contents one....2"), (3, "Other . . . . 3"), (4, "contents a. b. c")]


def _leaders(d: Dialect) -> str:
    cases = d.rows("c", "doc_id BIGINT, ord BIGINT, text STRING", [(-1, *c) for c in _LEADER_CASES])
    return f"SELECT doc_id, ord, text <> {leaders(d, 'text')} AS changed, {leaders(d, 'text')} AS accessible_text FROM (SELECT doc_id, ord, text FROM {d.t('lines')} WHERE contains(text, '. .') OR contains(text, '...') UNION ALL SELECT doc_id, ord, text FROM {cases}) u"


def _kinds(d: Dialect) -> str:
    """How often separators of lines change in which way, and why that is allowed."""
    return f"SELECT kind, {rationale(d, 'kind')} AS rationale, count(*) AS n FROM (SELECT {transformation_kind(d, 's', 'r')} AS kind FROM {d.t('text_changes')}) x GROUP BY kind"


_CATEGORY_CASES = ["Reading Order", "column-break", "Coordinate issue", "Caption", "Currency", "page number", "Institution", "continued", "running head", "graphic", "hyphenation", "OCR noise", "omission", "Spelling", "Whatever", "name", "alt text", "--date_number--", "LOW confidence", "decorative figure"]


def _categories(d: Dialect) -> str:
    cases = d.rows("c", "raw STRING", [(c,) for c in _CATEGORY_CASES])
    return f"SELECT raw, {category(d, 'raw')} AS category, sum(n) AS n FROM (SELECT event_type AS raw, count(*) AS n FROM {d.t('events')} GROUP BY event_type UNION ALL SELECT raw, 1 AS n FROM {cases}) x GROUP BY raw"


def _resolved(d: Dialect) -> str:
    s, c, k = resolved(d)
    return f"SELECT conv_id, turn, {s} AS severity_after, {c} AS category_after, {k} AS chosen_after FROM {d.t('findings')}"


def _generic(d: Dialect) -> str:
    cases = d.rows("c", "description STRING", [("",), ("Text Field 12",), ("check_box-3",), ("Required",), ("Name of applicant",), ("  7 ",), ("radio button4",), ("Signature",)])
    return f"SELECT description, {generic_description(d, 'description')} AS generic FROM (SELECT p_name AS description FROM {d.t('part')} UNION SELECT description FROM {cases}) x"


def _math(d: Dialect) -> str:
    cases = d.rows("c", "doc_id BIGINT, text STRING", [(-1, "x ≤ y"), (-2, "Greek α"), (-3, "plain text"), (-4, "p₁"), (-5, "a ± b")])
    return f"SELECT doc_id, {looks_mathematical(d, 'text')} AS mathematical FROM (SELECT doc_id, coalesce(text, '') AS text FROM {d.t('documents')} UNION ALL SELECT doc_id, text FROM {cases}) x"


def _codepoints(d: Dialect) -> str:
    return f"SELECT codepoint, count(*) AS n_documents FROM (SELECT DISTINCT doc_id, {d.code('ch')} AS codepoint FROM {d.explode('(SELECT doc_id, ' + d.distinct(d.chars('text')) + ' AS c FROM ' + d.t('documents') + ' WHERE text IS NOT NULL) s', 'c', 'p', 'ch')} WHERE ch <> '') x WHERE codepoint <= 65535 GROUP BY codepoint"


QUERIES = {
    "embedded_text_blocks": (("lines",), _embedded_blocks),
    "exact_tokens": (("documents",), _exact_tokens),
    "comparison_tokens": (("documents",), _comparison),
    "sensitive_tokens": (("documents",), _sensitive),
    "native_text_quality": (("documents",), _native_text),
    "date_range_speech": (("lines",), _dates),
    "static_form_markers": (("lines",), _markers),
    "contents_leaders": (("lines",), _leaders),
    "transformation_kinds": (("text_changes",), _kinds),
    "category_normalization": (("events",), _categories),
    "resolved_findings": (("findings",), _resolved),
    "generic_descriptions": (("part",), _generic),
    "mathematical_text": (("documents",), _math),
    "manifest_codepoints": (("documents",), _codepoints),
}
