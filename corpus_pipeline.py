"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame that is written as Parquet and reread as the next one's docs. All
but the last return the columns of documents. Stages begin with small heaps: all run in one
application, where the executors' memory would otherwise grow from stage to stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelore.llm import decontaminate, exact_dedup, ngram_join, sentencepiece_codec, toxicity
from pagelore.llm._common import materialize, shrink_heaps, table


def no_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that score 0.5 or more go."""
    shrink_heaps(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts one stays."""
    shrink_heaps(spark)
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of every component of linked documents the smallest doc_id stays."""
    shrink_heaps(spark)
    return ngram_join.keep_one_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that contain a benchmark item go."""
    shrink_heaps(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: SentencePiece ids of every text, in place of the text."""
    shrink_heaps(spark)
    return sentencepiece_codec.encode(docs).drop("text")


STAGES = [
    ("toxicity", no_toxic),
    ("exact_dedup", no_copies),
    ("ngram_join", no_near_copies),
    ("decontamination", no_benchmark),
    ("sentencepiece", tokens),
]

#: SQL can't express the fitted grammar nor the BPE merges; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
