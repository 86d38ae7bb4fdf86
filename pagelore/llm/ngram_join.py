"""N-gram Jaccard join: a size-aware heavy-light self-join of documents on 3-word shingles.

Two documents link when ``100 * |A n B| >= 90 * |A u B|``. A partner of a set of n
shingles shares at least ``ceil(0.9 n)`` of them, and at most ``(n + m) / 19`` shingles
are in just one of two linked sets of n and m. Sets are
dealt into size classes, and the shingles' hash space into somewhat more parts than two
sets of a class can differ in shingles, so that two linked sets agree wholly in several
parts:

* a *light* set enumerates its subsets of a fixed size: for every two of its parts, all
  its shingles in them. Linked light sets have such a subset in common, and small sets
  that only share a common line hardly ever do;
* a *heavy* set has too many such subsets; it is found by scanning inverted lists, one
  for each part, named by all its shingles there (a few dozen lists hold it). A list per
  single shingle, the rarest ones, was measured first: passages that many documents
  share made its candidates grow with the square of the input.

A set that could link with the next larger class enters that class' lists as well. The
boundary between light and heavy is the size at which enumerating costs as much as
scanning, from the corpus' own histogram of small sizes (:func:`boundary`).

Links, not pairs: equal sets are one class, and :mod:`pagelore.llm._links` compares the
members of a list by representatives. Every pair of different sets that could link is
compared or known to be in one component, so components are exact.

Defined cases: null or empty text (or white space only) has the empty set, links with
nothing and is its own component; with fewer than three words the whole sequence is the
one shingle; of repeated rows and ties the smallest doc_id names the component; a null
doc_id takes part but never names a component unless it is alone (then null).
Other columns are ignored, whatever their names. Texts of any length are read whole. An
empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm._common import Words, components, drop_scratch, give_back, materialize, mix, odd_sketch, shingle_hashes, shrink_heaps, signed, slices, table
from pagelore.llm._links import link_lists
from pagelore.llm.exact_dedup import member_filter, without

SHINGLE = 3
#: Link when PER[0] * intersection >= PER[1] * union.
PER = (100, 90)
#: Cost of comparing one candidate, in units of moving one list entry.
COMPARE_COST = 4.0
#: Share of the sets of a class that a part of at most two shingles has in common with, in the cost model.
COMPANY = 0.01
#: Sizes that the histogram resolves; larger sets are never light.
HISTOGRAM = 128
#: 64-bit integers of a set's odd sketch.
SKETCH = 16
QS = [f"q{i}" for i in range(SKETCH)]

SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) END AS s FROM w),
classes AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s HAVING len(s) > 0),
grams AS (SELECT id, n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT a.id AS a, b.id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(id, low) AS (SELECT id, id FROM classes UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.id),
low AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(low.component_id, d.doc_id) AS component_id
FROM (SELECT doc_id, list_sort(s) AS s FROM s) d LEFT JOIN classes c ON c.s = d.s LEFT JOIN low ON low.id = c.id
"""


# ------------------------------------------------------------------ sets


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes."""
    for _, data, offsets in slices(texts):
        yield from _slice_sets(data, offsets, k)


def _slice_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    w = Words(data, offsets, lower=True)
    grams = shingle_hashes(w.hash, k)
    for a, b in itertools.pairwise(w.first.tolist()):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        else:
            yield shingle_hashes(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64)


# ------------------------------------------------------------------ heavy and light


def size_histogram(docs: DataFrame) -> np.ndarray:
    """About how many sets there are of each small size, by counting the words of short texts."""
    text = F.coalesce("text", F.lit(""))
    n = F.greatest(F.lit(0), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) - (SHINGLE - 1))
    short = docs.where(F.char_length(text) < 16 * HISTOGRAM).groupBy(F.least(n, F.lit(HISTOGRAM)).alias("n")).count()
    sizes = np.zeros(HISTOGRAM + 1, np.int64)
    for r in short.collect():  # HISTOGRAM + 1 rows at most
        sizes[r.n] = r["count"]
    return sizes


def size_class(n: int) -> tuple[int, int]:
    """(number, largest size) of the size class of a set."""
    number, top = 0, 8
    while n > top:
        number, top = number + 1, top * 13 // 10 + 1
    return number, top


def differ(top: int) -> int:
    """In how many shingles two linked sets of at most ``top`` can differ."""
    return 2 * top * (PER[0] - PER[1]) // (PER[0] + PER[1])


def parts(top: int, light: bool) -> int:
    """Parts of a class: linked sets agree in four of a light one, in three of a heavy one,
    of which two may be empty ones that name no list."""
    return differ(top) + (4 if light else 3)


def boundary(sizes: np.ndarray) -> int:
    """The largest size of the light classes: up to where enumerating a set's subsets costs
    less than scanning its lists, in which it meets the more company the more sets there are."""
    light, n = 8, 9
    while n < HISTOGRAM:
        _, top = size_class(n)
        p, q = parts(top, True), parts(top, False)
        mean = top / q
        small = math.exp(-mean) * (1 + mean + mean * mean / 2)
        scan = q * (1 + COMPARE_COST * COMPANY * small * sizes[n : top + 1].sum())
        if math.comb(p, 2) > scan:
            break
        light, n = top, top + 1
    return light


# ------------------------------------------------------------------ signatures


def part_lists(s: np.ndarray, a: np.ndarray, number: int, top: int, light: bool) -> np.ndarray:
    """List names of a set (sorted hashes ``s``, mixed ``a``) in one size class.

    Empty parts name no list, unless so many are empty that the others don't suffice."""
    if not differ(top):
        return np.zeros(0, np.uint64)  # such sets link only if they are equal
    p = parts(top, light)
    edge = np.searchsorted(s >> np.uint64(32), ((np.arange(p + 1, dtype=np.uint64) << np.uint64(32)) + np.uint64(p - 1)) // np.uint64(p))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(a)])
    full = np.diff(edge) > 0
    names = mix((total[edge[1:]] - total[edge[:-1]]) * np.uint64(5) + (np.arange(p, dtype=np.uint64) << np.uint64(20)) + np.uint64(number + 1))
    if p - full.sum() <= 2:
        names = names[full]
    if not light:
        return names
    i, j = np.triu_indices(len(names), 1)
    return mix(names[i] * np.uint64(3) + names[j])


def _signatures(light: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    salt = np.uint64(0xA0761D6478BD642F)
    classes: dict[int, tuple[int, int, bool, int]] = {}

    def of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(s)
        a = mix(s + salt)
        total = a.sum(dtype=np.uint64)
        out = [np.zeros(0, np.uint64)]
        if n:
            if n not in classes:
                number, top = size_class(n)
                classes[n] = number, top, n * PER[0] // PER[1] > top, size_class(top + 1)[1]
            number, top, larger, next_top = classes[n]
            out.append(part_lists(s, a, number, top, top <= light))
            if larger:
                out.append(part_lists(s, a, number + 1, next_top, next_top <= light))
        return signed(np.array([total, mix(a).sum(dtype=np.uint64)], np.uint64)), np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in slices(b.column(1)):  # small batches out, for bounded memory
                sizes, keys, sigs, sketches = [], [], [], []
                for s in _slice_sets(data, offsets, SHINGLE):
                    key, sig = of(s)
                    sizes.append(len(s))
                    keys.append(key)
                    sigs.append(sig)
                    sketches.append(odd_sketch(s, SKETCH))
                keys = np.array(keys, np.int64).reshape(-1, 2)
                q = np.array(sketches, np.int64).reshape(-1, SKETCH)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate(sigs)), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(sizes)), b.column(2).slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists, *(pa.array(q[:, i]) for i in range(SKETCH))],
                    names=["doc_id", "text_hash", "n", "s1", "s2", "sig", *QS],
                )
        give_back()

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact comparison of rows (a, b, text of a, text of b); rows of one a follow each other."""
    last, mine = None, None
    for b in batches:
        ok, apart = np.zeros(b.num_rows, bool), np.zeros(b.num_rows, np.int32)
        a_texts = b.column(2)
        for i, (a, other) in enumerate(zip(b.column(0).to_pylist(), shingle_sets(b.column(3)), strict=True)):
            if a != last:
                last, mine = a, next(shingle_sets(a_texts.slice(i, 1)))
            both = len(np.intersect1d(mine, other, assume_unique=True))
            ok[i] = PER[0] * both >= PER[1] * (len(mine) + len(other) - both)
            apart[i] = len(mine) + len(other) - 2 * both
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(apart), pa.array(ok)], names=["a", "b", "distance", "linked"])
    give_back()


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, s1, s2, text) whose text has the set of the class."""
    salt = np.uint64(0xA0761D6478BD642F)
    for b in batches:
        keys = np.array([[(x := mix(s + salt)).sum(dtype=np.uint64), mix(x).sum(dtype=np.uint64)] for s in shingle_sets(b.column(3))], np.uint64).reshape(-1, 2).view(np.int64)
        keep = pa.array((keys[:, 0] == np.asarray(b.column(1))) & (keys[:, 1] == np.asarray(b.column(2))))
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(3).filter(keep)], names=["class", "text"])
    give_back()


# ------------------------------------------------------------------ join


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """``pairs`` (a, b: class numbers) with their distances and whether they link.

    The texts of the classes concerned meet by pair and their sets are made anew: text
    compresses in a shuffle, hashes don't."""
    pairs = materialize(pairs, f"{name}-pairs")
    shrink_heaps(docs.sparkSession)
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted = materialize(classes.join(wanted, "class").select("class", "doc", "text_hash", "s1", "s2"), f"{name}-wanted")
    maybe = member_filter(wanted.select("text_hash"), wanted.count())
    keyed = docs.withColumn("h", F.xxhash64("text"))
    texts = keyed.where(maybe("h")).join(wanted, (F.col("h") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("doc"))).select("class", "s1", "s2", "text")
    texts = materialize(texts.mapInArrow(_checked, "class long, text string"), f"{name}-texts")
    one = texts.groupBy("class").agg(F.min("text").alias("text")) if _repeats(texts) else texts
    right = one.select(F.col("class").alias("b"), F.col("text").alias("tb"))
    left = one.select(F.col("class").alias("a"), F.col("text").alias("ta"))
    met = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    compared = materialize(met.mapInArrow(_linked, "a long, b long, distance int, linked boolean"), f"{name}-compared")
    drop_scratch(pairs, wanted, texts)
    return compared


def _repeats(texts: DataFrame) -> bool:
    """Does a class have several rows (a doc_id that repeats with the same words)?"""
    n = texts.agg(F.count("*").alias("n"), F.count_distinct("class").alias("m")).first()
    return n.n != n.m


def _fits(n: str, m: str) -> Column:
    """Sizes n and m can link."""
    return (PER[0] * F.col(n) >= PER[1] * F.col(m)) & (PER[0] * F.col(m) >= PER[1] * F.col(n))


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    light = boundary(size_histogram(docs))
    sig = docs.withColumn("h", F.xxhash64("text")).mapInArrow(_signatures(light), "doc_id long, text_hash long, n long, s1 long, s2 long, sig array<long>, " + ", ".join(f"{q} long" for q in QS))
    sig = materialize(sig.withColumn("row", F.monotonically_increasing_id()), "join-signatures")

    key = ["n", "s1", "s2"]
    classes = materialize(sig.where("n > 0").groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_hash")).alias("m")).select(*key, F.col("m.row").alias("class"), F.col("m.doc_id").alias("doc"), F.col("m.text_hash").alias("text_hash")), "join-classes")
    heads = sig.join(classes.select("class"), F.col("row") == F.col("class"), "left_semi").withColumn("class", F.col("row"))
    entries = heads.select("class", F.col("n").cast("int"), F.explode("sig").alias("sig"))
    sketches = heads.select("class", *QS)
    links = link_lists(entries, lambda pairs, name: _verified(pairs, classes, docs, name), _fits, "join", sketches, (PER[0] + PER[1]) // (PER[0] - PER[1]))

    comp = components(links, "join-components")
    named = classes.join(comp, F.col("class") == F.col("id"), "left").select(*key, "doc", F.coalesce("component", "class").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = materialize(named.join(lowest, "comp").select(*key, "component_id"), "join-named")
    full = sig.where("n > 0").select("doc_id", *key).join(named, key).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(sig.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; rows with a null
    doc_id, or with no text, stay. Rows that share the smallest doc_id all stay."""
    gone = materialize(link_components(docs).where("doc_id <> component_id").select("doc_id").distinct(), "join-gone")
    shrink_heaps(docs.sparkSession)
    return without(docs, F.col("doc_id").cast("long"), gone)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))
