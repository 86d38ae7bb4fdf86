"""Substring dedup: paragraph MinHash banding, with passages inside paragraphs.

Paragraphs are lines of at least ``SHINGLE`` words in the query; :func:`repeats` takes the
least number as ``paragraph_words``. Their 5-word shingles get MinHash
signatures in bands of ``ROWS`` rows (of ``SHORT_ROWS`` for sets of up to ``SHORT``
shingles, of which unlike ones hardly share any), as many as find a pair of Jaccard
similarity 0.8 with probability ``RECALL`` (:func:`tuned_bands`); sets that could link
across ``SHORT`` have both kinds. Paragraphs that collide in a band are
joined, verified by exact Jaccard similarity (>= 0.8), and clustered by components. Sets
of up to ``ALIKE`` shingles are as similar only to equal sets, and need no bands.

A passage may also repeat inside paragraphs that are otherwise different. Words at
content-defined places (local minima of a word-pair hash, and the minimum of the places
in every ``MIN_WORDS + 1`` words) start windows of ``WINDOW``
words; a stretch whose windows all stand in another document too is a passage. Short
stretches are verified: some ``MIN_WORDS + 1`` consecutive words must stand in another
document exactly. One window is enough for a stretch, and every ``MIN_WORDS + 1`` words
have one that depends on them alone, so every exact repetition of more than ``MIN_WORDS``
words is found, wherever its borders lie. Passages that share a window are one component.

Of every component the occurrence with the smallest doc_id (then place) is kept, the
others are removals.

Defined cases: null and empty texts have no paragraphs, and lines of fewer words than a
shingle have none either; repetition within one document
isn't one across documents, and rows equal in doc_id and text are one document; a null
doc_id ranks last when one is kept; other columns are ignored, whatever their names;
whole texts of any length are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.llm._common import Words, components, drop_scratch, give_back, materialize, mix, shingle_hashes, signed, slices, table
from pagelore.llm._links import link_lists
from pagelore.llm.exact_dedup import among, member_filter

SHINGLE, SIMILARITY = 5, 0.8
#: Words that a passage has more of, and a paragraph at least unless told otherwise.
MIN_WORDS = 50
#: A set of so many shingles has Jaccard similarity 0.8 to no other set.
ALIKE = 3
ROWS, RECALL = 4, 0.9995
SHORT, SHORT_ROWS = 45, 2
#: Words of a window; words to either side over which its start is a local minimum.
WINDOW, RADIUS = 12, 4
#: Words that a stretch of windows must cover to be looked at.
LEAST_COVER = WINDOW
#: A window that stands in so many places is dealt over SALTS tasks.
HOT, SALTS = 10_000, 64
#: Rows of long windows that a task hands on together.
GRAM_ROWS = 1 << 15


def tuned_bands(rows: int = ROWS, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS, SHORT_BANDS = tuned_bands(), tuned_bands(SHORT_ROWS)
_SEEDS = mix(np.arange(1, max(ROWS * BANDS, SHORT_ROWS * SHORT_BANDS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SALT = np.uint64(0xA0761D6478BD642F)


def anchors(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Word numbers where windows start, for all texts of a slice."""
    pair = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    n = len(pair)
    if n <= 2 * RADIUS:
        return np.zeros(0, np.int64)
    low = pair.copy()
    for s in range(1, RADIUS + 1):
        low[:-s] = np.minimum(low[:-s], pair[s:])
        low[s:] = np.minimum(low[s:], pair[:-s])
    at = np.flatnonzero(low == pair)
    # the whole window and the radius lie in one text
    text = np.searchsorted(first, at, "right") - 1
    ok = (at - RADIUS >= first[text]) & (at + max(WINDOW, RADIUS + 2) <= first[text + 1])
    return np.union1d(at[ok], _least(pair, first))


def _least(pair: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least places (all of equal ones) of every MIN_WORDS + 1 words of a text, among those whose window these words hold."""
    places, words = MIN_WORDS + 2 - WINDOW, MIN_WORDS + 1
    n = len(pair) - places + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = _sliding(np.minimum, pair, places)
    text = np.searchsorted(first, np.arange(n), "right") - 1
    low[np.arange(n) + words > first[text + 1]] = 0  # no such words in one text
    edge = np.zeros(places - 1, np.uint64)
    return np.flatnonzero((_sliding(np.maximum, np.concatenate([edge, low, edge]), places) == pair) & (pair > 0))


def _sliding(best: np.ufunc, x: np.ndarray, k: int) -> np.ndarray:
    """``best`` of every k consecutive values, by doubling."""
    have, out = 1, x
    while have < k:
        step = min(have, k - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def _paragraphs(w: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of every line of at least ``least`` words."""
    if not len(w.start):
        z = np.zeros(0, np.int64)
        return z, z, z
    line = np.cumsum(w.data == 10)[w.start]
    text = np.searchsorted(w.first, np.arange(len(w.start)), "right") - 1
    edge = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    stop = np.append(edge[1:], len(line))
    keep = stop - edge >= least
    return text[edge[keep]], edge[keep], stop[keep]


def _shingle_sets(g: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of all paragraphs lo .. hi, where each paragraph's begin)."""
    n = hi - lo - SHINGLE + 1
    par = np.repeat(np.arange(len(lo)), n)
    v = g[np.arange(len(par)) + np.repeat(lo - np.cumsum(n) + n, n)]
    v = v[np.lexsort((v, par))]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (par[1:] != par[:-1])
    return v[new], np.flatnonzero(np.diff(par[new], prepend=-1))


def _odd_sketches(v: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The odd sketch of each paragraph, as four integers: bit i is the parity of the
    shingles that end in i."""
    bit, word = np.uint64(1) << (v & np.uint64(63)), v >> np.uint64(6) & np.uint64(3)
    return signed(np.stack([np.bitwise_xor.reduceat(np.where(word == np.uint64(j), bit, np.uint64(0)), edge) for j in range(4)], 1))


def _bands(v: np.ndarray, edge: np.ndarray, pick: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Band names of the sets numbered ``pick``, one row each; the two kinds of bands have different names."""
    out = np.zeros((len(pick), bands), np.uint64)
    if not len(pick):
        return out
    size = np.diff(np.append(edge, len(v)))[pick]
    first = np.cumsum(size) - size
    mine = v[np.arange(size.sum()) + np.repeat(edge[pick] - first, size)]
    for band in range(bands):
        name = np.full(len(pick), np.uint64(rows << 8 | band))
        for r in range(rows):
            name = mix(name * np.uint64(31) + np.minimum.reduceat(mine * _SEEDS[band * rows + r], first))
        out[:, band] = name
    return out


def _all_bands(v: np.ndarray, edge: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """The band names of every set."""
    short, long = np.flatnonzero((sizes > ALIKE) & (sizes <= SHORT)), np.flatnonzero(sizes > SHORT)
    both = long[sizes[long] * 4 <= SHORT * 5]
    pick = np.concatenate([short, both])
    names = [_bands(v, edge, pick, SHORT_ROWS, SHORT_BANDS), _bands(v, edge, long, ROWS, BANDS)]
    owner = np.concatenate([np.repeat(pick, SHORT_BANDS), np.repeat(long, BANDS)])
    flat = np.concatenate([x.ravel() for x in names])[np.argsort(owner, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(flat)))


PARAGRAPH = "struct<lo: int, hi: int, set: bigint, n: int, bands: array<bigint>, q0: bigint, q1: bigint, q2: bigint, q3: bigint>"
SCAN = f"k long, at array<int>, gram array<long>, par array<{PARAGRAPH}>"


def _scan(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, text) to k with its windows (places, hashes) and paragraphs."""
    for b in batches:
        for row, data, offsets in slices(b.column(1)):  # small batches out, for bounded memory
            w = Words(data, offsets, lower=True)
            h, first = w.hash, w.first
            at = anchors(h, first)
            grams = signed(shingle_hashes(h, WINDOW))[at] if len(at) else np.zeros(0, np.int64)
            text, lo, hi = _paragraphs(w, least)
            if len(lo):
                v, edge = _shingle_sets(shingle_hashes(h, SHINGLE), lo, hi)
                sets, sizes = np.add.reduceat(mix(v + _SALT), edge), np.diff(np.append(edge, len(v)))
                sketches, bands = _odd_sketches(v, edge), _all_bands(v, edge, sizes)
            else:
                sets, sizes, sketches, bands = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 4), np.int64), pa.array([], pa.list_(pa.int64()))
            ends, ends_p = (pa.array(x.astype(np.int32)) for x in (np.searchsorted(at, first), np.searchsorted(text, np.arange(len(first)))))
            owner = np.searchsorted(first, at, "right") - 1
            windows = [pa.ListArray.from_arrays(ends, pa.array((at - first[owner]).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(grams))]
            columns = [pa.array((lo - first[text]).astype(np.int32)), pa.array((hi - first[text]).astype(np.int32)), pa.array(signed(sets)), pa.array(sizes.astype(np.int32)), bands, *(pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(4))]
            par = pa.ListArray.from_arrays(ends_p, pa.StructArray.from_arrays(columns, ["lo", "hi", "set", "n", "bands", "q0", "q1", "q2", "q3"]))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(offsets) - 1), *windows, par], names=["k", "at", "gram", "par"])
    give_back()


def _paragraph_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted: list of (class, lo, hi)) to class and paragraph text."""
    for b in batches:
        ids, texts = [], []
        for (_, data, offsets), row in zip(slices(b.column(0), 1), b.column(1).to_pylist(), strict=True):
            w = Words(data, offsets, hashes=False)
            for x in row:
                ids.append(x["class"])
                texts.append(data[w.start[x["lo"]] : w.end[x["hi"] - 1]].tobytes().decode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["class", "text"])
    give_back()


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, paragraph of a, of b) with the distance of the two and whether their Jaccard
    similarity is at least 0.8; rows of one a follow each other."""

    def shingles(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, data, offsets in slices(texts):
            w = Words(data, offsets, lower=True)
            for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                yield np.unique(shingle_hashes(w.hash[a:z], SHINGLE))

    last, mine = None, None
    for b in batches:
        ok, apart = np.zeros(b.num_rows, bool), np.zeros(b.num_rows, np.int32)
        for i, (a, other) in enumerate(zip(b.column(0).to_pylist(), shingles(b.column(3)), strict=True)):
            if a != last:
                last, mine = a, next(shingles(b.column(2).slice(i, 1)))
            both = len(np.intersect1d(mine, other, assume_unique=True))
            ok[i] = 5 * both >= 4 * (len(mine) + len(other) - both)
            apart[i] = len(mine) + len(other) - 2 * both
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(apart), pa.array(ok)], names=["a", "b", "distance", "linked"])
    give_back()


def _long_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, k, runs: list of (node, lo, hi)) to the hashes of all MIN_WORDS + 1 words around each run."""
    size, margin = MIN_WORDS + 1, MIN_WORDS + 1 - LEAST_COVER

    def made(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=["gram", "k", "node", "at"])

    for b in batches:
        out: list[list] = [[], [], [], []]
        held = 0
        for (_, data, offsets), k, runs in zip(slices(b.column(0), 1), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            h = Words(data, offsets, lower=True).hash
            for r in runs:
                a, z = max(0, r["lo"] - margin), min(len(h), r["hi"] + margin)
                g = signed(shingle_hashes(h[a:z], size))
                out[0].append(g)
                out[1].append(np.full(len(g), k, np.int64))
                out[2].append(np.full(len(g), r["node"], np.int64))
                out[3].append(np.arange(a, a + len(g), dtype=np.int64))
                held += len(g)
                if held >= GRAM_ROWS:  # small batches out, for bounded memory
                    yield made(out)
                    out, held = [[], [], [], []], 0
        yield made(out)
    give_back()


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the documents k in ``wanted`` (k, ...): only rows that a filter lets through shuffle."""
    maybe = member_filter(wanted.select("k"), wanted.count())
    return docs.where(maybe(F.col("k"))).dropDuplicates(["k"]).join(wanted, "k")


def paragraph_links(scan: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paragraphs: k, lo, hi, class; links between classes). A class is a set's hash: equal
    paragraphs are one. Deletes ``scan``."""
    every = scan.select("k", F.explode("par").alias("p"))
    p = every.select("k", "p.lo", "p.hi", F.col("p.set").alias("class"))
    classes = materialize(p.groupBy("class").agg(F.min(F.struct("k", "lo", "hi")).alias("m")).select("class", "m.*"), "paragraph-classes")
    entries = every.select(F.col("p.set").alias("class"), F.col("p.n").alias("n"), F.explode("p.bands").alias("sig"))
    # bands that no other class has never shuffle again: a filter of the shared ones clears them
    shared = entries.groupBy("sig").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z").select("sig")
    shared = materialize(shared, "paragraph-bands")
    live = materialize(among(entries, "sig", shared)[0].distinct(), "paragraph-entries")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        pairs = materialize(pairs, f"{name}-pairs")
        ids = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        wanted = classes.join(ids, "class").groupBy("k").agg(F.collect_list(F.struct("class", "lo", "hi")).alias("wanted"))
        texts = _texts_of(docs, materialize(wanted, f"{name}-wanted"))
        texts = materialize(texts.select("text", "wanted").mapInArrow(_paragraph_texts, "class long, text string"), f"{name}-texts")
        met = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a")
        compared = materialize(met.select("a", "b", "ta", "tb").mapInArrow(_similar, "a long, b long, distance int, linked boolean"), f"{name}-compared")
        drop_scratch(pairs, texts)
        return compared

    mine = materialize(live.select("class").distinct(), "paragraph-listed")
    sketches = every.select(F.col("p.set").alias("class"), *(F.col(f"p.q{i}").alias(f"q{i}") for i in range(4)))
    sketches = among(sketches, "class", mine)[0].dropDuplicates(["class"])
    sketches = materialize(sketches, "paragraph-sketches")
    p = materialize(p, "paragraphs")
    drop_scratch(scan)
    links = link_lists(live, verify, lambda n, m: (5 * F.col(n) >= 4 * F.col(m)) & (5 * F.col(m) >= 4 * F.col(n)), "paragraph", sketches, 9)
    return p, links


def passages(scan: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages: node, k, lo, hi; links between nodes)."""
    windows = scan.select("k", F.posexplode(F.arrays_zip("at", "gram")).alias("i", "w")).select("k", "i", "w.at", "w.gram")
    twice = windows.groupBy("gram").agg(F.min("k").alias("a"), F.max("k").alias("z"), F.count("*").alias("c")).where("a < z")
    twice = materialize(twice.select("gram", (F.col("c") >= HOT).alias("hot")), "repeated")
    windows, exact = among(windows, "gram", twice.select("gram"))
    if exact:
        met = windows
    else:
        # a window that many documents share is dealt over SALTS tasks; false positives of the filter are as well, on both sides
        hot = twice.where("hot").select("gram")
        many = member_filter(hot, hot.count())
        spread = F.when(many("gram"), F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")).otherwise(0)
        salts = F.when(many("gram"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        met = windows.withColumn("salt", spread).join(twice.select("gram", F.explode(salts).alias("salt")), ["gram", "salt"]).select("k", "i", "at", "gram")
    found = materialize(met, "windows")
    order = Window.partitionBy("k").orderBy("i")
    found = found.withColumn("run", F.col("i") - F.row_number().over(order))
    runs = found.groupBy("k", "run").agg(F.min("at").alias("lo"), (F.max("at") + WINDOW).alias("hi")).where(f"hi - lo >= {LEAST_COVER}")
    runs = materialize(runs.withColumn("node", F.xxhash64("k", "lo", F.lit("s"))), "runs")

    short = runs.where(f"hi - lo <= {MIN_WORDS}").groupBy("k").agg(F.collect_list(F.struct("node", "lo", "hi")).alias("runs"))
    grams = _texts_of(docs, materialize(short, "short-runs")).select("text", "k", "runs").mapInArrow(_long_grams, "gram long, k long, node long, at long")
    grams = materialize(grams, "long-grams")
    real = grams.groupBy("gram").agg(F.min("k").alias("a"), F.max("k").alias("z")).where("a < z").select("gram")
    proven = grams.join(real, "gram").groupBy("node", "k").agg(F.min("at").alias("plo"), (F.max("at") + MIN_WORDS + 1).alias("phi"))
    kept = runs.join(proven.select(F.col("node").alias("pn"), "plo", "phi"), F.col("node") == F.col("pn"), "left").where(f"hi - lo > {MIN_WORDS} or plo is not null")
    kept = materialize(kept.select("node", "k", "run", F.coalesce("plo", "lo").cast("int").alias("lo"), F.coalesce("phi", "hi").cast("int").alias("hi")), "passages")

    mine = found.join(kept.select("k", "run", "node"), ["k", "run"]).select("gram", "node")
    heads = mine.groupBy("gram").agg(F.min("node").alias("head"))
    links = mine.join(heads, "gram").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    return kept.select("node", "k", "lo", "hi"), materialize(links, "passage-links")


def repeats(docs: DataFrame, paragraph_words: int = MIN_WORDS) -> DataFrame:
    """One row per occurrence of a repeated paragraph (of at least ``paragraph_words`` words)
    or passage: doc_id, kind, begin and end (word numbers), component, keep_doc_id, removed."""
    if paragraph_words < SHINGLE:
        raise ValueError(f"a paragraph has at least {SHINGLE} words")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))
    named = docs.select("k", "doc_id")
    texts = docs.select("k", "text")
    scan = materialize(texts.mapInArrow(partial(_scan, least=paragraph_words), SCAN), "scan")

    seg, seg_links = passages(scan, texts)
    seg_comp = components(seg_links, "passage-components")
    seg = seg.join(seg_comp, F.col("node") == F.col("id"), "left").select(F.lit("passage").alias("kind"), "k", "lo", "hi", F.coalesce("component", "node").alias("component"))
    par, par_links = paragraph_links(scan, texts)
    par_comp = components(par_links, "paragraph-components")
    par = par.join(par_comp, F.col("class") == F.col("id"), "left").select(F.lit("paragraph").alias("kind"), "k", "lo", "hi", F.coalesce("component", "class").alias("component"))

    members = materialize(par.union(seg).join(named.distinct(), "k"), "members")
    low = members.groupBy("kind", "component").agg(F.min("k").alias("a"), F.max("k").alias("z"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k", "lo")).alias("best")).where("a < z")
    low = materialize(low.select("kind", "component", F.col("best.doc_id").alias("keep_doc_id"), F.col("best.k").alias("bk"), F.col("best.lo").alias("bl")), "kept")
    return members.join(low, ["kind", "component"]).select("doc_id", "kind", F.col("lo").alias("begin"), F.col("hi").alias("end"), "component", "keep_doc_id", (~((F.col("k") == F.col("bk")) & (F.col("lo") == F.col("bl")))).alias("removed"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"), SHINGLE)
