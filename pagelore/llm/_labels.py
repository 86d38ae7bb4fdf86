"""The bounded sample of labelled rows that a classifier is fitted on.

Defined cases: of several labels of one doc_id the largest counts; null labels and null
doc_ids are left out; rows that share a doc_id are rows of the sample each; ties in the
order of hashes go by the text's hash; a single text longer than its share of
``max_chars`` is left out, and the next ones fill its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, fold: int, held: int, max_rows: int, max_chars: int) -> tuple[list[str], list[int]]:
    """Whole texts and 0/1 labels of at most ``max_rows`` rows and ``max_chars`` characters,
    none of the held-out fold, in the order of their doc_ids' hashes (the same at every run).

    No text may take more than a hundredth of ``max_chars``. If the sample lost a kind of
    label that the labelled documents have outside the fold, that is an error."""
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), F.col(column).cast("int").alias("__y"))
    rows = rows.where(F.expr(f"pmod(crc32(cast(__id as string)), {fold}) <> {held}")).groupBy("__id").agg(F.max("__y").alias("__y"))
    every = rows
    # twice the rows, for those whose text is too long or missing
    rows = rows.orderBy(F.xxhash64("__id"), "__id").limit(2 * max_rows)
    text = F.coalesce("text", F.lit(""))
    got = docs.where(F.char_length(text) <= max_chars // 100).select(F.col("doc_id").alias("__id"), text.alias("__t")).join(F.broadcast(rows), "__id")
    got = got.select("__t", "__y", F.xxhash64("__id").alias("__o"), F.xxhash64("__t").alias("__h"), F.char_length("__t").alias("__n")).orderBy("__o", "__h").limit(max_rows)
    so_far = F.sum("__n").over(Window.orderBy("__o", "__h").rowsBetween(Window.unboundedPreceding, 0))  # over max_rows rows
    sample = got.withColumn("__s", so_far).where(F.col("__s") <= max_chars).orderBy("__o", "__h").select("__t", "__y").collect()
    ys = [r["__y"] for r in sample]
    if len(set(ys)) < 2 and docs.select(F.col("doc_id").alias("__id")).join(every, "__id").select("__y").distinct().count() > 1:
        raise ValueError(f"the sample of {len(ys)} rows has not both labels; raise max_rows or max_chars")
    return [r["__t"] for r in sample], ys
