"""Resumable work on a stream of pages.

Completed (page, stage) keys are skipped by an anti-join in ``foreachBatch`` and results
are written once per key, so a restarted stream repeats nothing; title history is keyed
state that moves a repeated title to its end. Output and checkpoints live in the shared
folder that ``spark.checkpoint.dir`` names (in a local session a temporary one where it is unset; on a cluster that is an error)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelore.sources.tables import load


def shared(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pagelore-")
    return f"{root.rstrip('/')}/pagelore/{name}-{uuid.uuid4().hex}"


def page_stream(spark: SparkSession, sf_dir: str, name: str = "pages") -> DataFrame:
    """A stored table as a stream of its files."""
    schema = load(spark, sf_dir, name).schema
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def write_once(batch: DataFrame, path: str, key: str) -> None:
    """Append the rows of ``batch`` whose key isn't in the table at ``path``."""
    spark = batch.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    new = batch.dropDuplicates([key])
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new.write.mode("append").parquet(path)


def matching(checkpoints: DataFrame, sources: DataFrame, version: int) -> DataFrame:
    """The ``checkpoints`` (page_id, version, source_sha256, ...) that may be resumed: of this
    version, and of the source's present hash (page_id, sha256), or of none."""
    own = checkpoints.where(F.col("version") == version).join(sources.select("page_id", F.col("sha256").alias("now")), "page_id")
    return own.where("source_sha256 is null or source_sha256 = now").drop("now")


def proposals(pages: DataFrame, checkpoints: DataFrame, older: DataFrame) -> DataFrame:
    """page_id, payload and origin of every page's proposal: its checkpoint, else the page of an
    older plan (both: page_id, payload), else null; in page order."""
    c, o = checkpoints.select("page_id", F.col("payload").alias("c")), older.select("page_id", F.col("payload").alias("o"))
    joined = pages.select("page_id").join(c, "page_id", "left").join(o, "page_id", "left")
    return joined.select("page_id", F.coalesce("c", "o").alias("payload"), F.when(F.col("c").isNotNull(), "checkpoint").when(F.col("o").isNotNull(), "older plan").alias("origin")).orderBy("page_id")


def resume(spark: SparkSession, stream: DataFrame, done: DataFrame | None, path: str, key: str = "page_id") -> None:
    """Run ``stream`` to its end: rows whose key is in ``done`` or was written before are skipped."""

    def each(batch: DataFrame, _: int) -> None:
        write_once(batch if done is None else batch.join(done, key, "left_anti"), path, key)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", shared(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()


def title_history(stream: DataFrame, shown: int = 5) -> DataFrame:
    """doc_id and the last ``shown`` titles, in order of last use, from a stream of (doc_id, seq, title)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        for b in batches:
            for seq, title in b[["seq", "title"]].sort_values("seq").itertuples(index=False, name=None):
                title = " ".join((title or "").split())
                if title:
                    last[title] = max(int(seq), last.get(title, 0))
        state.update((list(last), list(last.values())))
        kept = sorted(last, key=last.get)[-max(1, shown) :]
        yield pd.DataFrame({"doc_id": [key[0]], "titles": [kept]})

    return stream.groupBy("doc_id").applyInPandasWithState(run, "doc_id string, titles array<string>", "titles array<string>, seqs array<long>", "update", GroupStateTimeout.NoTimeout)


def event_windows(stream: DataFrame) -> DataFrame:
    """Counts and sums by hour and type, with late data up to a day."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def q_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without labels, worked off as a stream and written once each."""
    path = shared(spark, "resumed")
    done = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    resume(spark, page_stream(spark, sf_dir).select("page_id", "url"), done, path)
    return spark.read.parquet(path)


QUERIES = {"stream_resume": q_resume}
ORACLES = {"stream_resume": "SELECT page_id, any_value(url) AS url FROM pages p ANTI JOIN labels l ON p.page_id = l.doc_id GROUP BY page_id"}
