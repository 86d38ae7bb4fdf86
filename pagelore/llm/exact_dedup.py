"""Exact dedup by two passes over Bloom filters.

Pass 1 puts the 64-bit hash of every normalised text into sharded Bloom filters and
records, in a second filter, hashes that were there before. Pass 2 probes that
second filter: a text whose hash is absent is certainly unique and passes straight
through; only the others shuffle, and are compared by SHA-256.

A false positive costs a shuffled row, never a wrong result. The filter that is
broadcast has ``bits_per_row`` bits a row but never more than ``max_filter_bytes``.

Defined cases: null text counts as empty; all empty texts (and texts of white space
only) are one group; of rows equal in text length and doc_id exactly one stays (the
null doc_id ranks last); no row in, no row out; further columns are kept untouched,
whatever their names; very long texts are hashed whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm._common import materialize, named, table, unused

PROBES = 4
SHARD_BITS = 1 << 20

SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


def text_sha(text: Column) -> Column:
    """SHA-256 (hex) of the text without its white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)


def _positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit numbers within the shard; low 32 bits step, the next ones start."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(20)) & np.uint64(0xFFFFFFFF) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64) for i in range(PROBES)]


def _has(words: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(at[0]), bool)
    for p in at:
        out &= (words[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return out


def _put(words: np.ndarray, at: list[np.ndarray], rows: np.ndarray) -> None:
    for p in at:
        p = p[rows]
        np.bitwise_or.at(words, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))


def _shards(rows: int, bits_per_row: int, max_filter_bytes: int) -> int:
    wanted = -(-rows * bits_per_row // SHARD_BITS)
    return max(1, min(wanted, max_filter_bytes * 8 // SHARD_BITS))


def _partly(shards: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"shard": pa.array((h >> np.uint64(40)).astype(np.int64) % shards, pa.int32()), "h": h.view(np.int64), "again": n >= least})

        held, rows = [], 0
        for b in batches:
            held.append(np.asarray(b.column(0)).view(np.uint64).copy())
            rows += b.num_rows
            if rows >= 1 << 18:  # a hash that repeats in a task leaves it once in so many rows
                yield out(held)
                held, rows = [], 0
        if rows:
            yield out(held)

    return run


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for b in batches:
        shard, h, again = np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64), np.asarray(b.column(2))
        for s in np.unique(shard):
            mine = shard == s
            g, inverse = np.unique(h[mine], return_inverse=True)
            n = np.bincount(inverse, minlength=len(g)) + np.bincount(inverse, again[mine], minlength=len(g))
            at = _positions(g, SHARD_BITS)
            seen = once.setdefault(int(s), np.zeros(SHARD_BITS // 8, np.uint8))
            repeated = _has(seen, at) | (n > 1)
            _put(twice.setdefault(int(s), np.zeros(SHARD_BITS // 8, np.uint8)), at, repeated)
            _put(seen, at, np.ones(len(g), bool))
    if twice:
        yield pa.RecordBatch.from_pydict({"shard": pa.array(list(twice), pa.int32()), "bits": pa.array([zlib.compress(x.tobytes(), 1) for x in twice.values()], pa.binary())})


def member_filter(hashes: DataFrame, rows: int, bits_per_row: int = 16, max_filter_bytes: int = 64 << 20) -> Callable[[Column], Column]:
    """From one bigint column of hashes: a function from a hash column to "may be among them"."""
    return repeated_filter(hashes, rows, bits_per_row, max_filter_bytes, least=1)


def repeated_filter(hashes: DataFrame, rows: int, bits_per_row: int = 16, max_filter_bytes: int = 64 << 20, least: int = 2) -> Callable[[Column], Column]:
    """From one bigint column of hashes: a function from a hash column to "may be repeated"."""
    spark = hashes.sparkSession
    shards = _shards(rows, bits_per_row, max_filter_bytes)
    parts = hashes.mapInArrow(_partly(shards, least), "shard int, h long, again boolean")
    built = parts.repartition("shard").mapInArrow(_build, "shard int, bits binary").collect()  # at most max_filter_bytes
    shared = spark.sparkContext.broadcast({r.shard: bytes(r.bits) for r in built})
    unpacked: dict[int, np.ndarray] = {}

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        h = h.to_numpy(np.int64).view(np.uint64)
        shard, out = (h >> np.uint64(40)).astype(np.int64) % shards, np.zeros(len(h), bool)
        for s in np.unique(shard):
            if s in shared.value:
                if s not in unpacked:
                    unpacked[s] = np.frombuffer(zlib.decompress(shared.value[s]), np.uint8)
                mine = shard == s
                out[mine] = _has(unpacked[s], _positions(h[mine], SHARD_BITS))
        return pd.Series(out)

    return probe


#: Rows of one bigint column that are small enough to broadcast (8 MB).
BROADCAST_ROWS = 1 << 20


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``key`` (bigint) is in ``gone``, a stored table of one
    bigint column; rows with a null key stay.

    Up to BROADCAST_ROWS keys are broadcast. Beyond, a Bloom filter of them clears most
    rows, and only the others shuffle for the exact comparison."""
    n = gone.count()
    mine, theirs = unused(docs, "pl_key"), unused(docs, "pl_gone")
    keyed, gone = docs.withColumn(mine, key), gone.toDF(theirs)
    columns = named(docs.columns)
    if n <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(gone), F.col(mine) == F.col(theirs), "left_anti").select(*columns)
    mark, maybe = unused(docs, "pl_maybe"), member_filter(gone, n)
    marked = keyed.withColumn(mark, maybe(F.coalesce(mine, F.lit(0))))
    sure = marked.where(~F.col(mark)).select(*columns)
    asked = marked.where(mark).join(gone, F.col(mine) == F.col(theirs), "left_anti").select(*columns)
    return sure.unionByName(asked)


def among(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, bool]:
    """(``rows`` whose bigint ``key`` may be in ``wanted``, a stored table of one bigint column
    without repeats; is that exact?): up to BROADCAST_ROWS keys are broadcast and it is,
    beyond a Bloom filter clears most of the others."""
    n = wanted.count()
    if n <= BROADCAST_ROWS:
        only = wanted.toDF("pl_wanted")
        return rows.join(F.broadcast(only), F.col(key) == F.col("pl_wanted"), "left_semi"), True
    maybe = member_filter(wanted, n)
    return rows.where(maybe(key)), False


def groups(docs: DataFrame, bits_per_row: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce("text", F.lit(""))
    sig = materialize(
        docs.select("doc_id", F.unhex(text_sha(F.col("text"))).alias("sha"), F.char_length(text).alias("n"), F.monotonically_increasing_id().alias("row"))
        .withColumn("h", F.xxhash64("sha")), "sha",
    )
    maybe = repeated_filter(sig.select("h"), sig.count(), bits_per_row, max_filter_bytes)
    probed = materialize(sig.withColumn("maybe", maybe("h")), "probed")
    lone = probed.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    some = probed.where("maybe")
    best = some.groupBy("sha").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best"))
    best = materialize(best, "best")  # so that both sides of the join are plain exchanges, which adaptive execution can split
    rest = some.join(best, "sha").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return lone.union(rest)


def drop_copies(docs: DataFrame, bits_per_row: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` without the rows that :func:`groups` doesn't keep; all columns as they are.

    Rows that the filter clears never shuffle; of the others, map-side aggregation
    sends at most one row per text and task, so a huge group doesn't meet in one task."""
    sha, mark, row = (unused(docs, c) for c in ("pl_sha", "pl_maybe", "pl_row"))
    columns = named(docs.columns)
    d = docs.withColumn(sha, text_sha(F.col("text")))
    h = F.xxhash64(F.unhex(sha))
    hashes = materialize(d.select(h.alias("h")), "hashes")
    maybe = repeated_filter(hashes, hashes.count(), bits_per_row, max_filter_bytes)
    d = d.withColumn(mark, maybe(h))
    lone = d.where(~F.col(mark)).select(*columns)
    order = F.struct(-F.char_length(F.coalesce("text", F.lit(""))), F.col("doc_id").isNull(), "doc_id", "text")
    some = d.where(mark).groupBy(sha).agg(F.min_by(F.struct(*columns), order).alias(row)).select(f"{row}.*")
    return lone.unionByName(some)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
