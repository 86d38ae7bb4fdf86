from pyspark.sql import functions as F

from pagelore import registry
from pagelore.sources import plan_files as P
from pagelore.sources.tables import load, page_elements
from pagelore.streaming.resume import shared


def test_plans_round_trip(spark, sf_dir):
    e = page_elements(load(spark, sf_dir, "pages"))
    path = shared(spark, "plans")
    P.write_plans(e, path)
    spark.createDataFrame([('{"schema_version": 3}',), ("nonsense",)], "value string").write.mode("append").text(path)
    back, rejects = P.read_plans(spark, path)
    cols = ["doc_id", "page_number", "ord", "role", "text", "l", "t", "r", "b"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, e.select(cols).collect())) and rejects.count() == 2
    assert P.file_hashes(spark, path + "/*.txt").count() >= 1
    assert P.archive(spark, path) == path + ".previous" and P.archive(spark, path) is None


def test_checkpoints(spark):
    path = shared(spark, "checkpoints")
    spark.createDataFrame([(1, "proposal", "abc", "{}"), (2, "proposal", None, "{}"), (3, "review", "other", "{}")], P.CHECKPOINT).write.json(path)
    own, foreign = P.read_checkpoints(spark, path, "abc")
    assert {r.page_id for r in own.collect()} == {1, 2} and [r.page_id for r in foreign.collect()] == [3]


def test_sections(spark, sf_dir):
    q = registry.queries()
    texts = q["page_transcripts"](spark, sf_dir)
    got = P.page_sections(q["anomaly_report"](spark, sf_dir), texts, texts.withColumn("transcript", F.concat(F.lit("<new>\n"), "transcript")))
    rows = got.collect()
    assert len(rows) == q["anomalies_by_page"](spark, sf_dir).count() and all("&lt;new&gt;" in r.html and "<new>" not in r.html for r in rows)


def test_reports_and_archives(spark, tmp_path):
    import json

    from pagelore.sources import plan_files

    path = f"{tmp_path}/report"
    assert plan_files.archive(spark, path) is None
    for i in range(3):
        plan_files.write_report(spark.createDataFrame([("a", None, i)], "source string, ok boolean, n int"), path)
        assert json.loads(spark.read.text(path).first().value) == {"source": "a", "ok": None, "n": i}
        assert plan_files.archive(spark, path) == path + ("", ".previous", ".previous-2", ".previous-3")[i + 1]
    found = spark.createDataFrame([("d", 2, None, "info", "page", "b"), ("d", 1, "p0001-e0001", "info", "page", "a")], "doc_id string, page_number long, element_id string, severity string, category string, message string")
    plan_files.write_anomalies(found, path)
    rows = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert {r["message"]: "element_id" in r for r in rows} == {"a": True, "b": False}
    spark.createDataFrame([('{"schema_version":1,"review_status":"model_reviewed"}',), ('{"schema_version":7,"plan_revision":11,"review_status":"manual_modified"}',)], "value string").write.text(f"{tmp_path}/plans")
    got = {r.plan_revision: (r.schema_version, r.review_status) for r in plan_files.upgrade_plans(spark, f"{tmp_path}/plans").collect()}
    assert got == {5: (7, "legacy_unreviewed"), 11: (7, "manual_modified")}


def test_proposals_and_matching(spark):
    from pagelore.streaming import resume

    pages = spark.range(1, 4).withColumnRenamed("id", "page_id")
    at = lambda *rows: spark.createDataFrame(rows, "page_id long, payload string")
    assert [tuple(r) for r in resume.proposals(pages, at((1, "c")), at((1, "o"), (2, "o"))).collect()] == [(1, "c", "checkpoint"), (2, "o", "older plan"), (3, None, None)]
    c = spark.createDataFrame([(1, 7, "h1"), (2, 7, "old"), (3, 6, "h3"), (4, 7, None)], "page_id long, version int, source_sha256 string")
    s = spark.createDataFrame([(i, f"h{i}") for i in range(1, 5)], "page_id long, sha256 string")
    assert sorted(r.page_id for r in resume.matching(c, s, 7).collect()) == [1, 4]
