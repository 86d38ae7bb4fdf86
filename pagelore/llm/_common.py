"""Shared helpers of the corpus operators: scratch tables, word hashing, components.

Words are maximal runs of bytes outside the six ASCII white-space bytes
(``\\x20 \\x09-\\x0D``); everything below works on the Arrow buffers directly,
so a batch of documents is tokenised and hashed without one Python object per word.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; bounds the temporaries of a Python worker.
SLICE_BYTES = 1 << 19
#: Bytes whose words are hashed at once.
HASH_BYTES = 1 << 17

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ------------------------------------------------------------------ storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is
    unset a local session gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagelore-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the application ends."""
    path = f"{shared_dir(spark)}/pagelore/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop_scratch(*tables: DataFrame) -> None:
    """Delete scratch tables that no returned plan reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        for f in t.inputFiles()[:1]:
            where = jvm.org.apache.hadoop.fs.Path(f).getParent()
            where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    Survives lost executors, and later plans read only the columns they need. Then the
    driver collects its garbage, so that executors drop shuffle files of earlier steps."""
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def shrink_heaps(spark: SparkSession) -> None:
    """Executors collect their garbage and give the freed heap back to the system.

    G1 lets a heap grow up to its limit while a step has much garbage and hardly ever shrinks it, so
    what one step freed stays out of reach of the Python workers of the next. One task a core,
    so that an idle executor gets one at least; collections asked for at once are one."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


#: Rows and bytes of an Arrow batch: documents are large, and a batch is held by Spark and by Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(4 << 20))}


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH where they are at Spark's defaults. This stays
    in the session: plans are run after they are made."""
    for key, (default, bound) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, bound)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by their literal names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``docs`` has it (names clash whatever their case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


# ------------------------------------------------------------------ a worker's memory


def give_back() -> None:
    """Return freed memory to the system: a worker process outlives its task, and what one
    task freed its executor may need for another."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to ask for


class WordMemory:
    """Results of words, as bytes, in at most about ``most`` bytes.

    Two generations: what is used moves to the younger one, and when that holds half of
    the bound it becomes the older one, whose unused words go."""

    def __init__(self, most: int = 64 << 20):
        self.half, self.size = most // 2, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, words: set[str]) -> list[str]:
        """Those of ``words`` that aren't known; the others are in ``young`` until the next call."""
        if self.size > self.half:
            self.young, self.old, self.size = {}, self.young, 0
        new = words.difference(self.young)
        known = [w for w in new if w in self.old]
        self.put(known, [self.old[w] for w in known])
        return list(new.difference(known))

    def put(self, words: list[str], results: list[bytes]) -> None:
        self.young.update(zip(words, results, strict=True))
        self.size += 200 * len(words) + 2 * sum(map(len, words)) + sum(map(len, results))


# ------------------------------------------------------------------ words


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0x5851F42D4C957F2D | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, HASH_BYTES + 1)
        tables = []
        for base in (_P, _PINV):
            t = np.full(m, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


class Words:
    """Word positions of a batch of texts.

    ``start``/``end`` are byte offsets into ``data``; ``first[i]:first[i+1]`` are the
    word numbers of text ``i``; ``hash`` has one 64-bit hash per word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~_SEP[data]
        start, end = solid.copy(), solid.copy()
        if n:
            gap = ~solid
            start[1:] &= gap[:-1]
            end[:-1] &= gap[1:]
            edge = offsets[:-1][offsets[:-1] < n]
            start[edge] |= solid[edge]
            edge = offsets[1:][offsets[1:] > 0] - 1
            end[edge] |= solid[edge]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hash() if hashes else None

    def _hash(self) -> np.ndarray:
        out = np.zeros(len(self.start), np.uint64)
        i = 0
        while i < len(out):  # whole words of about HASH_BYTES at a time (or one longer word)
            at = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, at + HASH_BYTES, "right")))
            part = self.data[at : self.end[j - 1]]
            pw, inv = power_tables(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[part] * pw[: len(part)], out=total[1:])
            start, end = self.start[i:j] - at, self.end[i:j] - at
            out[i:j] = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))
            i = j
        return out


def slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of a string column; nulls are empty.

    A slice has about ``most`` bytes, or one longer text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, off, raw = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, len(texts))
        yield i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_STEP = [np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64)) for k in range(64)]


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows of one word-hash array (of several texts too: the
    caller leaves out windows that cross an edge)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _STEP[j + 1]
    return mix(out + np.uint64(k))


def odd_sketch(s: np.ndarray, words: int = 4) -> np.ndarray:
    """A set of hashes as ``words`` (a power of two) 64-bit integers: bit i is the parity of the
    hashes that end in i. Two sketches never differ in more bits than their sets in elements."""
    bits = 64 * words
    parity = (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# ------------------------------------------------------------------ components


#: Edges that one task joins by union-find (16 MB); more are joined by all tasks together.
ONE_TASK_EDGES = 1 << 20


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id that each reaches) of a graph given by its edges."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if got:
        ids, low = union_find(np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low)], names=["id", "component"])
        del got, ids, low
        give_back()


def components(edges: DataFrame, name: str = "components", a: str = "a", b: str = "b", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, component): the smallest id that each vertex of ``edges`` reaches.

    Up to ``one_task`` distinct edges (a fixed bound) go to one task. Beyond, large-star
    and small-star steps alternate, each a shuffle with map-side aggregation, until the
    edge set is a set of stars; every step is written to the shared folder. Nothing is
    collected but two numbers per step. Both ways give the same; empty in, empty out."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    if e.count() <= one_task:
        out = materialize(e.coalesce(1).mapInArrow(_joined, "id long, component long"), f"{name}-joined")
        drop_scratch(e)
        return out
    state = None
    while True:
        # large star: link every larger neighbour to the smallest of the neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, f"{name}-large")
        # small star: link every smaller neighbour, and the vertex, to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = materialize(small.where("u <> v").distinct(), f"{name}-small")
        drop_scratch(e, large)
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = new
        if seen == state:
            break
        state = seen
    # every vertex now has one edge, to its root
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.union(roots)
