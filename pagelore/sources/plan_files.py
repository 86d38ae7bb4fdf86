"""Plans, checkpoints and reports as files: JSON lines of nested plans, write-once checkpoints, HTML pages."""

from __future__ import annotations

import difflib
import html
import itertools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators.audits import SCHEMA_VERSION

ELEMENT = "struct<ord: bigint, role: string, text: string, l: double, t: double, r: double, b: double>"
PLAN = f"doc_id string, schema_version bigint, pages array<struct<page_number: bigint, elements: array<{ELEMENT}>>>"
CHECKPOINT = "page_id bigint, stage string, source_sha256 string, payload string"


def nest(elements: DataFrame) -> DataFrame:
    """One row per document: schema version and pages of elements, both in order."""
    pages = elements.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("ord", "role", "text", "l", "t", "r", "b"))).alias("elements"))
    return pages.groupBy("doc_id").agg(F.lit(SCHEMA_VERSION).cast("long").alias("schema_version"), F.array_sort(F.collect_list(F.struct("page_number", "elements"))).alias("pages"))


def write_plans(elements: DataFrame, path: str) -> None:
    """Plans as JSON, one line a document; nulls are written."""
    plans = nest(elements)
    plans.select(F.to_json(F.struct(*plans.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_plans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(elements of plans of this schema version, lines that aren't such plans)."""
    lines = spark.read.text(path).select("value", F.from_json("value", PLAN).alias("p"))
    good = lines.where(f"p.schema_version = {SCHEMA_VERSION}")
    pages = good.select("p.doc_id", F.explode("p.pages").alias("g")).select("doc_id", "g.page_number", F.explode("g.elements").alias("e"))
    rejects = lines.where(f"coalesce(p.schema_version, -1) <> {SCHEMA_VERSION}").select("value")
    return pages.select("doc_id", "page_number", "e.*"), rejects


def read_checkpoints(spark: SparkSession, path: str, source_sha256: str) -> tuple[DataFrame, DataFrame]:
    """(checkpoints of this source, or of none; those of a foreign source)."""
    all_ = spark.read.schema(CHECKPOINT).json(path)
    own = F.coalesce(F.col("source_sha256"), F.lit(source_sha256)) == source_sha256
    return all_.where(own), all_.where(~own)


def archive(spark: SparkSession, path: str) -> str | None:
    """Move what is at ``path`` aside, to ``.previous`` or, where that is taken, ``.previous-2`` and so on; its new path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    names = itertools.chain([path + ".previous"], (f"{path}.previous-{i}" for i in itertools.count(2)))
    to = next(name for name in names if not fs.exists(jvm.org.apache.hadoop.fs.Path(name)))
    fs.rename(where, jvm.org.apache.hadoop.fs.Path(to))
    return to


def write_report(report: DataFrame, path: str) -> None:
    """Rows of a preflight, validation, criteria or manifest report as JSON lines, nulls written,
    in place of what was there."""
    report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_anomalies(records: DataFrame, path: str) -> None:
    """Anomaly records as JSON lines in the order of documents and pages; a record has the keys it has values for."""
    ordered = records.orderBy("doc_id", "page_number", "element_id", "severity", "category", "message")
    ordered.select(F.to_json(F.struct(*records.columns)).alias("value")).write.mode("overwrite").text(path)


def upgrade_plans(spark: SparkSession, path: str) -> DataFrame:
    """Plan lines of any schema version, as the migration rule leaves them: value, schema_version,
    plan_revision, review_status, coordinate_space. The file stays as it is."""
    from pagelore.registry import apply

    lines = spark.read.text(path).select(F.xxhash64("value").alias("id"), F.col("value").alias("plan")).dropDuplicates(["id"])
    return lines.join(apply(spark, "plan_migration", plans=lines), "id").select(F.col("plan").alias("value"), "schema_version", "plan_revision", "review_status", "coordinate_space")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of every file under ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def page_sections(records: DataFrame, transcripts: DataFrame, proposals: DataFrame) -> DataFrame:
    """doc_id, page_number and the HTML section of every page with records: findings by
    weight, transcript, and the difference to the proposal (both: doc_id, page_number, transcript)."""
    entries = records.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("severity", "category", "message"))).alias("records"))
    joined = entries.join(transcripts.select("doc_id", "page_number", F.col("transcript").alias("now")), ["doc_id", "page_number"], "left")
    joined = joined.join(proposals.select("doc_id", "page_number", F.col("transcript").alias("was")), ["doc_id", "page_number"], "left")

    @F.pandas_udf("string")
    def section(page: pd.Series, rows: pd.Series, now: pd.Series, was: pd.Series) -> pd.Series:
        out = []
        for n, found, a, b in zip(page, rows, now, was, strict=True):
            item = lambda x: f"<li>{html.escape(x['severity'])} / {html.escape(x['category'])}: {html.escape(x['message'])}</li>"
            first = "".join(item(x) for x in found if x["severity"] != "info")
            notes = "".join(item(x) for x in found if x["severity"] == "info")
            diff = "\n".join(difflib.unified_diff((b or "").split("\n"), (a or "").split("\n"), "proposal", "review", lineterm=""))
            out.append(f"<section id='page-{n}'><h2>Page {n}</h2><ul>{first}</ul><details><summary>Notes</summary><ul>{notes}</ul></details><pre>{html.escape(a or '')}</pre><pre>{html.escape(diff or 'no difference')}</pre></section>")
        return pd.Series(out)

    return joined.select("doc_id", "page_number", section("page_number", "records", "now", "was").alias("html"))
