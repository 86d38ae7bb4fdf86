from pagelore.sources.tables import load
from pagelore.streaming import resume as R


def test_resume_skips_what_is_done(spark, sf_dir):
    path = R.shared(spark, "t")
    done = load(spark, sf_dir, "pages").where("page_id % 2 = 0").select("page_id")
    for _ in range(2):  # a second run adds nothing
        R.resume(spark, R.page_stream(spark, sf_dir).select("page_id", "url"), done, path)
        got = [r.page_id for r in spark.read.parquet(path).collect()]
        assert len(got) == len(set(got)) == load(spark, sf_dir, "pages").where("page_id % 2 = 1").count()


def test_title_history_moves_repeats_to_the_end(spark):
    rows = [("d", 1, "First"), ("d", 2, "Second"), ("d", 3, " First "), ("d", 4, "Third"), ("d", 5, " ")]
    path = R.shared(spark, "titles")
    spark.createDataFrame(rows, "doc_id string, seq long, title string").write.parquet(path)
    stream = spark.readStream.schema("doc_id string, seq long, title string").parquet(path)
    q = R.title_history(stream, 2).writeStream.format("memory").queryName("titles").outputMode("update").option("checkpointLocation", R.shared(spark, "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.titles for r in spark.sql("SELECT * FROM titles").collect()] == [["First", "Third"]]


def test_event_windows(spark, sf_dir):
    stream = R.page_stream(spark, sf_dir, "events")
    q = R.event_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", R.shared(spark, "w")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM windows").first().n == load(spark, sf_dir, "events").count()
