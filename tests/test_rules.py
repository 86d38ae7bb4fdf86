"""Rules on literal cases with expected values written out, apart from any rule's text."""

import pytest

from pagelore.functions.dialect import SPARK
from pagelore.operators import audits, text_rules
from pagelore.registry import apply

ELEMENT = "doc_id string, page_id long, page_number long, ord long, n long, role string, text string, l double, t double, r double, b double, conf double, agree double"


def elements(spark, *rows):
    """Rows (page, ord, role, text, t, b) of one document."""
    return spark.createDataFrame([("d", p, p, o, 9, role, text, 0.0, float(t), 1000.0, float(b), 1.0, 1.0) for p, o, role, text, t, b in rows], ELEMENT)


def values(spark, expression, schema, *rows):
    """A rule's expression over literal rows, in order."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in spark.sql(f"SELECT i, {expression} AS v FROM {{f}}", f=frame).orderBy("i").collect()]


def test_exact_tokens(spark):
    text = "Dr. Smith—yes, indeed.\nNext"
    docs = spark.createDataFrame([(1, text), (2, "  two  words "), (3, ""), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in apply(spark, "exact_tokens", documents=docs).collect()}
    starts = [0, 4, 15, 23]
    assert set(got) == {1, 2} and (got[1].n_tokens, got[1].sum_start, got[1].sum_end, got[1].last_end) == (4, sum(starts), 3 + 14 + 22 + 27, len(text))
    assert (got[2].sum_start, got[2].sum_end, got[2].sum_actual_end, got[2].last_end) == (2 + 7, 5 + 12, 7 + 13, 13)


def test_changes_of_text(spark):
    cases = {
        ("co­operate", "cooperate"): "soft_hyphen_removal", ("ﬁ", "fi"): "ligature_expansion", ("-\n", ""): "line_break_dehyphenation", ("→ ", ""): "decorative_marker_omission", (" ", ", "): "structural_separator_normalization",
        ("....", ","): "structural_separator_normalization", ("|", ","): "structural_separator_normalization", ("–", " to "): "date_range_expansion", (" . . . ", ""): "decorative_leader_omission", ("…", " "): "decorative_leader_omission",
        ("  ", " "): "whitespace_normalization", ("", ""): "whitespace_normalization", ("sucess", "success"): "unverified", ("-", ""): "unverified", ("⟶", ""): "decorative_marker_omission",
    }
    assert values(spark, text_rules.transformation_kind(SPARK, "s", "r"), "s string, r string", *cases) == list(cases.values())


def test_spoken_text(spark):
    v = lambda e, *rows: values(spark, e, "x string", *((r,) for r in rows))
    assert v(text_rules.spoken_dates(SPARK, "x"), "September 15–17, 2006.", "sept 3–4 and May 1–2", "March 5-6", "Maybe 1–2") == ["September 15 to 17, 2006.", "sept 3 to 4 and May 1 to 2", "March 5-6", "Maybe 1–2"]
    issue = "INSIDE THIS ISSUE Notes from the Chair . . . . . 1 Faculty Notes . . . . 2"
    assert v(text_rules.leaders(SPARK, "x"), issue, "Other . . . . 3") == ["INSIDE THIS ISSUE Notes from the Chair 1 Faculty Notes 2", "Other . . . . 3"]
    form = "Student Name: __________ UFID______-______ Location: ☐ In-person ☐ Via Zoom ☐ Hybrid"
    assert values(spark, text_rules.static_markers(SPARK, "a", "b"), "a string, b string", (form, ""), ("1. 0 to 1/3 full _____ 1/3 to 2/3 full _____", "one third full"), ("_____", "")) == ["Student Name: UFID Location: In-person Via Zoom Hybrid", "one third full", ""]
    assert v(text_rules.looks_mathematical(SPARK, "x"), "x ≤ y", "Greek α", "plain text", "p₁", "a ± b") == [True, True, False, True, True]
    assert v(text_rules.generic_description(SPARK, "x"), "", "Text Field 12", "check_box-3", "Required", "Name of applicant", "  7 ", "Signature") == [True, True, True, True, False, True, False]
    assert v(text_rules.category(SPARK, "x"), "Reading Order", "Coordinate issue", "page number", "Whatever", "--date_number--", "OCR noise") == ["reading_order", "geometry", "date_number", "other", "date_number", "evidence"]


def test_resolved_findings(spark):
    rows = [
        (1, 0, "critical", "geometry", "The first-model bbox values were image-pixel coordinates.", None), (2, 0, "critical", "content_coverage", "Running header and page number are omitted.", None),
        (3, 0, "critical", "semantic_role", "The first proposal used H2; canonical plan uses P.", "P"), (4, 0, "critical", "name", "Proposal read Smyth; the page image supports Smith.", "Smith"),
        (5, 0, "critical", "name", "Proposal read Smyth; the image is ambiguous evidence.", "Smith"), (6, 0, "warning", "geometry", "The proposal bbox is off.", None),
    ]
    found = spark.createDataFrame(rows, "conv_id long, turn long, severity string, category string, message string, chosen string")
    got = {r.conv_id: (r.severity_after, r.category_after, (r.chosen_after or "").split(":")[0]) for r in apply(spark, "resolved_findings", findings=found).collect()}
    assert got == {1: ("info", "geometry", "Resolved"), 2: ("info", "artifact", "Resolved"), 3: ("info", "model_disagreement", "Resolved in canonical plan"), 4: ("info", "model_disagreement", "Resolved from authoritative page evidence"), 5: ("critical", "name", "Smith"), 6: ("warning", "geometry", "")}


CHANGE = "id string, role string, visible string, accessible string, nth long, s0 long, s1 long, t0 long, t1 long, source string, replacement string, kind string"


def test_transformation_audit(spark):
    plain, formula = "structural_separator_normalization", "formula_spoken_equivalent"
    rows = [
        ("good", "P", "a-\nb", "ab", 1, 1, 3, 1, 1, "-\n", "", "line_break_dehyphenation"),
        # spans [0,4), [1,3), [3,5): both later ones overlap the first, which alone moves the cursor
        ("three", "P", "abcdef", "xef", 1, 0, 4, 0, 1, "abcd", "x", plain), ("three", "P", "abcdef", "xef", 2, 1, 3, 0, 1, "bc", "x", plain), ("three", "P", "abcdef", "xef", 3, 3, 5, 0, 1, "de", "x", plain),
        # a change without spans leaves the cursor where it was
        ("lacks", "P", "abcd", "xyd", 1, 0, 2, 0, 1, "ab", "x", plain), ("lacks", "P", "abcd", "xyd", 2, None, 1, 0, 1, "a", "b", plain), ("lacks", "P", "abcd", "xyd", 3, 1, 3, 1, 2, "bc", "y", plain),
        ("source", "P", "abc", "abd", 1, 2, 3, 2, 3, "z", "d", plain), ("target", "P", "abc", "abd", 1, 2, 3, 2, 3, "c", "e", plain),
        ("empty", "P", "q", "q", 1, 0, 0, 0, 0, "", "", formula), ("figure", "Figure", "q", "r", 1, None, None, None, None, "", "", formula),
    ]
    got = {(r.id, r.error): r.n for r in apply(spark, "transformation_audit", changes=spark.createDataFrame(rows, CHANGE)).collect()}
    assert got == {("three", "overlap"): 2, ("lacks", "lacks_spans"): 1, ("lacks", "overlap"): 1, ("lacks", "not_rebuilt"): 1, ("source", "source_mismatch"): 1, ("target", "target_mismatch"): 1, ("target", "not_rebuilt"): 1, ("empty", "formula_incomplete"): 1}


def test_formula_spans(spark):
    rows = [("f", "P", "a - b = c", "", 1, 2, 3, 2, 4, "-", "to", "unverified"), ("f", "P", "a - b = c", "", 2, 6, 7, 8, 14, "=", "equals", "formula_spoken_equivalent"), ("open", "P", "x", "", 1, None, 1, 0, 1, "x", "y", "formula_spoken_equivalent")]
    assert [tuple(r) for r in apply(spark, "formula_spans", changes=spark.createDataFrame(rows, CHANGE)).collect()] == [("f", 2, 7, 8, "=", "equals")]  # "a to b = c"


def test_fidelity(spark):
    def gate(*rows):
        frame = spark.createDataFrame(rows, "dpi int, mean double, share double")
        return spark.sql(f"SELECT {audits.within_tolerance('dpi', 'mean', 'share')} AS ok FROM {{f}}", f=frame).first().ok

    assert gate((72, 0.0567, 0.2083), (150, 0.0371, 0.1308))
    assert not gate((72, 0.0567, 0.2083), (150, 0.0567, 0.1308))
    assert not gate((72, 0.0567, 0.2083)) and not gate((72, 0.01, 0.26), (150, 0.01, 0.1)) and not gate((72, None, 0.1), (150, 0.01, 0.1))
    # a page's mean decides, not its largest difference: one channel in ten differs wholly
    pixels = [[0.0] * 10, [0.5] + [0.0] * 9, [0.0] * 10]
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(pixels)], "vec_id long, embedding array<float>, label int")
    r = apply(spark, "fidelity_gate", embeddings=frame).first()
    assert (r.resolutions, round(r.worst_mean, 6), r.within_tolerance) == (2, 0.05, True)


def test_release_gate(spark):
    page = elements(spark, (1, 1, "P", "x", 0, 100))
    names = audits.CHECKS
    findings = "doc_id string, page_number long, ord long, nth long, severity string, category string, message string, chosen string"

    def run(checks, severity="info"):
        own = spark.createDataFrame([("d", n, ok) for n, ok in checks], "doc_id string, name string, ok boolean")
        found = spark.createDataFrame([("d", 1, 1, 1, severity, "other", "m", None)], findings)
        return apply(spark, "release_gate", elements=page, checks=own, page_findings=found.limit(0).drop("ord"), element_findings=found).first()

    every = [(n, True) for n in names]
    assert len(names) == 16 and run(every).released and run(every).failing == ""
    assert run([*every[:15], (names[15], None)]).failing == "verapdf_pdfua_ok;" and run(every[1:]).failing == "visual_match;"
    assert run(every, "critical").failing == "critical_findings;" and not run(every, "critical").released


def test_table_rules(spark):
    schema = "id string, page long, ord long, role string, visible string, accessible string, table_id string, row_no long, col_no long, scope string"
    rows = [
        ("a", 1, 1, "TH", "h", "h", "t", 0, 0, "Column"), ("b", 1, 2, "TD", "x", "x", "t", 0, 4000, None), ("c", 1, 3, "TD", "y", "y", "t", 1, 0, None), ("d", 1, 4, "TD", "z", "z", "t", 1, 0, None), ("e", 1, 5, "P", "p", "p", None, None, None, None), ("f", 1, 6, "TD", "q", "q", "t", 2, 0, None),
        ("g", 2, 1, "TH", "h", "h", None, None, None, None), ("h", 2, 2, "TD", " ", " ", "t", 0, 0, None), ("i", 2, 3, "P", "x", "x", None, None, None, None), ("j", 3, 1, "TD", "x", "x", "t", 0, 0, "Row"), ("k", 3, 2, "P", " ", " ", None, None, None, None),
    ]
    cells = spark.createDataFrame(rows, schema)
    assert sorted((r.id, r.error) for r in apply(spark, "row_major_violations", cells=cells).collect()) == [("1/t", "not_consecutive"), ("d", "row_major")]
    empty = elements(spark, (1, 1, "P", "x", 0, 100))
    assert sorted((r.id, r.error) for r in apply(spark, "schema_invariants", cells=cells, elements=empty).collect()) == [("g", "table_id_required"), ("j", "scope_forbidden"), ("k", "text_required")]
    assert sorted((r.ord, r.role, r.finding) for r in apply(spark, "table_demotion", cells=cells.where("page = 2")).collect()) == [(1, "P", "warning"), (3, "P", None)]


def test_forms(spark):
    w = [("d", 1, 0, "Full name", "Full name", "Tx", 1, "Full name"), ("d", 1, 1, "", "Phone", "Tx", 2, "Phone"), ("d", 1, 2, "Text field 3", "", "Tx", 3, "Text field 3"), ("d", 2, 0, "City", "Town", "Tx", 4, None)]
    widgets = spark.createDataFrame(w, "doc_id string, page long, idx long, tooltip string, label string, kind string, obj long, description string")
    assert sorted((r.page, r.idx, r.error) for r in apply(spark, "form_policy", widgets=widgets).collect()) == [(1, 1, "missing_name"), (1, 2, "generic_name"), (1, 2, "missing_label"), (2, 0, "label_differs")]
    assert sorted((r.page, r.idx, r.error) for r in apply(spark, "widget_descriptions", widgets=widgets).collect()) == [(1, 1, "name_differs"), (1, 2, "label_differs"), (2, -1, "incomplete")]
    r = apply(spark, "form_snapshot", widgets=widgets).first()
    assert (r.widget_count, r.missing_tooltips, r.generic_tooltips, r.missing_labels, r.mismatched_labels) == (4, 1, 1, 1, 1)
    two = spark.createDataFrame([("d", 1, 0, "a", "old", "Tx", 7, "a"), ("d", 1, 1, "b", "new", "Tx", 7, "b"), ("d", 1, 2, "c", "", "Tx", 8, "c")], widgets.schema)
    assert [r.structure_label for r in apply(spark, "widget_labels", widgets=two).orderBy("idx").collect()] == ["new", "new", ""]
    tree = spark.createDataFrame([("root", "g", None), ("g", "a", "Tx"), ("a", "b", None), ("g", "c", None), ("b", "a", None)], "parent string, kid string, field_type string")
    assert [tuple(r) for r in apply(spark, "field_count", field_edges=tree).collect()] == [("g", 4, 2)]


def test_files_and_metadata(spark):
    s = spark.createDataFrame([(1, "Writer ", "PDF lib", "Writer", " PDF lib", "D:20060915103000+00'00'", None), (2, None, "  ", "Tool", "Tool", None, None), (3, "A", "B", "C", "D", "yesterday", "2001-01-01")], "id long, c1 string, c2 string, c3 string, c4 string, created string, xmp_created string")
    got = {r.id: (r.encoders, r.creation_date) for r in apply(spark, "source_metadata", sources=s).collect()}
    assert got == {1: ("Writer; PDF lib", "2006-09-15T10:30:00"), 2: ("Tool", None), 3: ("A; B; C; D", "2001-01-01")}
    e = spark.createDataFrame([(1, 0, 0.995, 100, 101), (2, 0, 0.98, 100, 100), (3, 0, 0.999, 100, 97), (4, 1, 1.0, 10, 10), (5, 0, None, 0, 0), (6, 0, None, 0, 3)], "id long, rc int, ratio double, expected long, actual long")
    assert [r.id for r in apply(spark, "extraction_gate", extractions=e).where("compatible").orderBy("id").collect()] == [1, 5]
    old = spark.createDataFrame([(1, '{"text": "Old", "confidence": 0.75, "ambiguity": "unsure"}'), (2, '{"visible_text": "New", "accessible_text": "new"}')], "id long, e string")
    assert [tuple(r) for r in apply(spark, "legacy_elements", old_elements=old).orderBy("id").collect()] == [(1, "Old", "Old", 0.75, 0.75, 0.75, 0.75, "legacy_ambiguity", "unsure"), (2, "New", "new", 1.0, 1.0, 1.0, 1.0, None, None)]
    plans = spark.createDataFrame([(1, '{"schema_version":1,"plan_revision":2,"review_status":"model_reviewed"}'), (2, '{"schema_version":2,"plan_revision":9,"review_status":"model_reviewed"}'), (3, '{"schema_version":7,"plan_revision":11,"review_status":"manual_modified"}')], "id long, plan string")
    assert [tuple(r)[1:5] for r in apply(spark, "plan_migration", plans=plans).orderBy("id").collect()] == [(7, 5, "legacy_unreviewed", "normalized_0_1000"), (7, 9, "model_reviewed", "pdf_points"), (7, 11, "manual_modified", "normalized_0_1000")]
    links = spark.createDataFrame([(1, 1, "Contents", "http://x", False), (2, 1, None, "http://x", False), (3, 1, "", None, True), (4, 1, None, None, False)], "id long, nth long, contents string, uri string, internal boolean")
    assert [r.description for r in apply(spark, "link_descriptions", links=links).orderBy("id").collect()] == ["Contents", "Link to http://x", "Internal link", "Link"]
    pages = spark.createDataFrame([(1, "https://h/a/Report.v2.pdf", ""), (2, ".hidden", ""), (3, None, "")], "page_id long, url string, html string")
    got = apply(spark, "output_paths", pages=pages).orderBy("page_id").collect()
    assert got[0].plan_path == "/out/Report.v2/Report.v2.plan.json" and got[0].output_path == "/out/Report.v2/Report.v2.accessible.pdf" and got[1].workdir == "/out/.hidden"


def test_order_and_furniture(spark):
    roles = lambda name, *rows: [r.role for r in apply(spark, name, elements=elements(spark, *rows)).orderBy("page_number", "ord").collect()]
    page = [(1, i + 1, role, "text", 100 * i, 100 * i + 50) for i, role in enumerate(["H2", "LI", "H2", "LI", "LI"])]
    assert roles("isolated_list_items", *page) == ["H2", "P", "H2", "LI", "LI"]
    two = [(p, o, "P", text, t, b) for p in (1, 2) for o, text, t, b in ((1, "Department newsletter", 950, 980), (2, str(p), 985, 999), (3, ". . . . . . . . . .", 400, 420), (4, "Body", 500, 520))]
    got = {(r.element_id, r.reason) for r in apply(spark, "artifact_reasons", elements=elements(spark, *two)).where("doc_id = 'd'").collect()}
    assert got == {(f"p000{p}-e000{o}", reason) for p in (1, 2) for o, reason in ((1, "running_furniture"), (2, "page_number"), (3, "writing_line"))}
    lines = spark.createDataFrame([(1, "one two\nthree four\r\n five"), (2, None)], "doc_id long, text string")
    assert sorted((r.line_no, r.n_chunks) for r in apply(spark, "logical_lines", documents=lines).collect()) == [(0, 2), (1, 2), (2, 1)]
    big = elements(spark, (12345, 10001, "P", "x", 0, 1), (1234, 1000, "P", "x", 0, 1))
    assert {r.element_id for r in apply(spark, "page_elements_scan", elements=big).collect()} == {"p12345-e10001", "p1234-e1000"}


def test_regions(spark):
    schema = "doc_id string, page_number long, ord long, nth long, text string, l double, t double, r double, b double"
    drop_cap = [("d", 1, 1, 1, "T", 100.0, 100.0, 140.0, 160.0), ("d", 1, 1, 2, "he", 130.0, 100.0, 400.0, 120.0)]
    far = [("d", 1, 2, 1, "a", 0.0, 0.0, 100.0, 20.0), ("d", 1, 2, 2, "b", 600.0, 500.0, 700.0, 520.0)]
    vee = [("d", 1, 3, 1, "a", 0.0, 0.0, 100.0, 20.0), ("d", 1, 3, 2, "b", 300.0, 0.0, 400.0, 20.0), ("d", 1, 3, 3, "c", 105.0, 0.0, 295.0, 20.0)]
    got = {(r.ord, r.nth): r.region for r in apply(spark, "fragment_regions", fragments=spark.createDataFrame(drop_cap + far + vee, schema)).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (2, 1): 1, (2, 2): 2, (3, 1): 1, (3, 2): 1, (3, 3): 1}


def test_structure_records(spark):
    plan = "doc_id string, page_number long, ord long, role string, visible_text string, accessible_text string, alt_text string, t double, b double"
    rec = "doc_id string, record_ord long, role string, text string"

    def errors(*records):
        planned = spark.createDataFrame([("d", 1, 1, "P", "", "one two", None, 0.0, 1.0), ("d", 1, 2, "H1", "", "three", None, 0.0, 1.0)], plan)
        own = spark.createDataFrame([("d", 2_000_000 + i, role, text) for i, (role, text) in enumerate(records)], rec)
        return sorted((r.record_ord - 2_000_000, r.error) for r in apply(spark, "structure_records", records=own, planned=planned).collect())

    assert errors(("P", "one two"), ("H1", "three")) == [] and errors(("P", "one "), ("P", "two"), ("H1", "three")) == []
    assert errors(("P", "one two"), ("P", "three")) == [(1, "role_differs")] and errors(("P", "one twx"), ("H1", "three")) == [(0, "text_differs")]
    assert errors(("P", "one"), ("P", " twothree")) == [(1, "crosses"), ]


@pytest.mark.parametrize(("conf", "agree", "kinds"), [(0.79, 1.0, ["low_confidence"]), (0.8, 0.9, []), (1.0, 0.89, ["model_disagreement"])])
def test_anomaly_thresholds(spark, conf, agree, kinds):
    e = spark.createDataFrame([("d", 1, 1, 1, 1, "P", "x", 0.0, 0.0, 1.0, 1.0, conf, agree)], ELEMENT)
    none = spark.createDataFrame([], "doc_id string, page_number long, ord long, nth long, severity string, category string, message string, chosen string")
    got = apply(spark, "anomaly_report", elements=e, ambiguities=none.select("doc_id", "page_number", "nth", "message"), page_findings=none.drop("ord"), element_findings=none).collect()
    assert [r.category for r in got] == kinds


def test_anomalies_keep_the_first_of_equal_ones(spark):
    e = elements(spark, (1, 1, "P", "x", 0, 1))
    f = spark.createDataFrame([("d", 1, 1, n, s, c, m, k) for n, s, c, m, k in ((2, "warning", "name", "Read  twice.", "late"), (1, "warning", "name", "Read twice. ", "first"), (3, "critical", "name", "Read twice.", None))], "doc_id string, page_number long, ord long, nth long, severity string, category string, message string, chosen string")
    a = spark.createDataFrame([("d", 1, 1, "Unclear column."), ("d", 1, 2, "Unclear\ncolumn.")], "doc_id string, page_number long, nth long, message string")
    got = sorted((r.severity, r.category, r.message, r.chosen, r.element_id) for r in apply(spark, "anomaly_report", elements=e, ambiguities=a, page_findings=f.limit(0).drop("ord"), element_findings=f).collect())
    assert [x[:4] for x in got] == [("critical", "name", "Read twice.", ""), ("warning", "name", "Read twice.", "first"), ("warning", "page", "Unclear column.", "")]


def test_field_counts_at_any_size(spark):
    """A flat tree of over a million fields and a chain of 12, in which the type comes down; rows as the SQL has them on random graphs."""
    flat = spark.range(1_000_100).selectExpr("'g' AS parent", "concat('f', id) AS kid", "if(id % 2 = 0, 'Tx', null) AS field_type")
    chain = spark.range(12).selectExpr("if(id = 0, 'root', concat('c', id - 1)) AS parent", "concat('c', id) AS kid", "if(id = 10, 'Tx', null) AS field_type")
    top = spark.createDataFrame([("root", "g", None), ("g", "g", "Tx"), ("root", None, "Tx")], "parent string, kid string, field_type string")
    got = {r.root: (r.visited, r.field_count) for r in apply(spark, "field_count", field_edges=flat.union(chain).union(top)).collect()}
    assert got == {"g": (1_000_101, 500_050), "c0": (12, 2), None: (0, 0)}


def test_field_counts_of_cyclic_graphs(spark):
    import random

    from pagelore.operators.evidence import _field_count

    rng, rows = random.Random(5), []
    for g in range(12):  # graphs of their own in one table
        node = [f"{g}/{i}" for i in range(6)]
        rows += [("root", node[0], None), ("root", node[1], rng.choice(["Tx", None]))]
        rows += [(rng.choice(node), rng.choice(node), rng.choice(["Tx", None, None])) for _ in range(9)]
    edges = spark.createDataFrame(rows, "parent string, kid string, field_type string")
    want = spark.sql(_field_count(SPARK), field_edges=edges).collect()
    assert sorted(apply(spark, "field_count", field_edges=edges).collect()) == sorted(want)
