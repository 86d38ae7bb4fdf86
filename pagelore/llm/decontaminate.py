"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document long, so the Jaccard similarity of the two says
little. Items are therefore partitioned by their number of shingles, each partition
with its own block length B (the largest item in it); documents are cut into blocks
of B shingles, and every two neighbouring blocks form a window. An item that stands in
a document lies in one window of its partition's length, where the containment
threshold becomes a Jaccard threshold far from zero; one-row MinHash bands, as many as
reach ``recall``, then find the window. Every candidate (document, item) is verified by
exact shingle containment: the share of the item's distinct 5-word shingles that the
whole document has must reach 0.8.

Items go to the workers in blocks of at most ``block_items`` items and ``block_chars``
characters (or one longer item), one pass over the documents a block: what is broadcast
has a fixed bound however many items there are, and however long.

Defined cases: words are lower-cased (A-Z) and stripped of ASCII punctuation at either
end; an item of fewer than five words is one shingle of all its words and must occur
whole; null or empty texts and items match nothing; equal items and repeated rows are
each reported, as are all items that tie; a null item_id or doc_id is reported as null;
empty tables give no rows; very long texts are read whole; other columns are ignored.
:func:`drop_contaminated` keeps all columns, whatever their names.

Bands are never more than ``MOST_BANDS``, which the shipped threshold and recall don't
reach; where other values would, it is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm._common import _STEP, give_back, materialize, mix, slices, table
from pagelore.llm._common import Words as _Words
from pagelore.llm.exact_dedup import without

SHINGLE, THRESHOLD = 5, 0.8
MOST_BANDS = 4096

SQL = r"""
WITH di AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'),
             lambda x: regexp_replace(regexp_replace(x, '^[!-/:-@\[-`{-~]+', ''), '[!-/:-@\[-`{-~]+$', '')), lambda x: x <> '') AS w FROM documents),
bi AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'),
             lambda x: regexp_replace(regexp_replace(x, '^[!-/:-@\[-`{-~]+', ''), '[!-/:-@\[-`{-~]+$', '')), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT item_id, least(len(w), 5) AS k, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM bi WHERE len(w) > 0),
g AS (SELECT item_id, k, len(s) AS n, unnest(s) AS g FROM items),
ks AS (SELECT DISTINCT k FROM items),
dg AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM di, ks WHERE len(w) >= k))
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found FROM dg JOIN g USING (k, g) GROUP BY doc_id, item_id, n HAVING 5 * count(*) >= 4 * n
"""

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Words(_Words):
    """Words without the ASCII punctuation at their ends; those that are nothing else go."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets, lower=True, hashes=False)
        if len(self.start):
            # positions of the first byte at or after, and the last before, that is no punctuation
            at = np.arange(len(self.data))
            solid = ~_PUNCT[self.data]
            ahead = np.minimum.accumulate(np.where(solid, at, len(at))[::-1])[::-1]
            behind = np.maximum.accumulate(np.where(solid, at, -1))
            start, end = ahead[self.start], behind[self.end - 1] + 1
            keep = start < self.end
            self.start, self.end = start[keep], end[keep]
            self.first = np.concatenate([[0], np.cumsum(keep)])[self.first]
        self.hash = self._hash()


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _STEP[j + 1]
    return mix(out + np.uint64(k))


def bands(similarity: float, recall: float) -> int:
    """One-row bands that find a pair of this Jaccard similarity with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity)))


class Index:
    """Signatures and shingle sets of one block of items."""

    def __init__(self, items: list[tuple[int, str]], recall: float):
        self.ids, self.k, self.sets = [], [], []
        texts = pa.array([t for _, t in items], pa.string())
        for row, data, offsets in slices(texts):
            w = Words(data, offsets)
            for i in range(len(offsets) - 1):
                h = w.hash[w.first[i] : w.first[i + 1]]
                if len(h):
                    k = min(len(h), SHINGLE)
                    self.ids.append(items[row + i][0])
                    self.k.append(k)
                    self.sets.append(np.unique(_grams(h, k)))
        self.partitions: dict[int, list] = {}
        self.seeds = mix(np.arange(1, MOST_BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        sizes = np.array([len(s) for s in self.sets], int)
        for k in sorted(set(self.k)):
            mine = np.flatnonzero(np.array(self.k) == k)
            order = mine[np.argsort(sizes[mine], kind="stable")]
            while len(order):
                # sizes s .. 1.5 s share a block length
                top = int(sizes[order[0]] * 3 // 2)
                part = order[sizes[order] <= top]
                order = order[len(part) :]
                block = int(sizes[part].max()) + (0 if k < SHINGLE else SHINGLE)
                low = int(sizes[part].min())
                # the item's shingles that are there, against a window of two blocks and the rest of the item
                similarity = max(1e-3, THRESHOLD * low / (2 * block + (1 - THRESHOLD) * low))
                if (n := bands(similarity, recall)) > MOST_BANDS:
                    raise ValueError("this recall needs more bands than there are")
                mins = np.array([(self.sets[i][None, :] * self.seeds[:n, None]).min(1) for i in part], np.uint64)
                keys = []
                for j in range(n):
                    o = np.argsort(mins[:, j], kind="stable")
                    keys.append((mins[o, j], part[o]))
                self.partitions.setdefault(k, []).append((block, keys))

    def search(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item number, size, found) of every verified pair in one slice of documents."""
        grams = {k: _grams(h, k) for k in set(self.k)}
        found: set[tuple[int, int]] = set()
        for k, partitions in self.partitions.items():
            g = grams[k]
            n = np.maximum(np.diff(first) - k + 1, 0)
            if not n.sum():
                continue
            cut = [_cut(first, n, block) for block, _ in partitions]
            for j in range(max(len(keys) for _, keys in partitions)):
                x = g * self.seeds[j]  # the shingle hashes are mixed already; an odd factor orders them anew
                for (doc, edges, same), (_, keys) in zip(cut, partitions, strict=True):
                    if j >= len(keys):
                        continue
                    minimum, owner = keys[j]
                    low = np.minimum.reduceat(x, edges[:-1] if edges[-1] >= len(g) else edges)[::2]
                    window = low.copy()
                    window[:-1][same] = np.minimum(low[:-1], low[1:])[same]
                    at = np.searchsorted(minimum, window)
                    for b in np.flatnonzero(minimum[np.minimum(at, len(minimum) - 1)] == window).tolist():
                        i = int(at[b])
                        while i < len(minimum) and minimum[i] == window[b]:
                            found.add((int(doc[b]), int(owner[i])))
                            i += 1
        for d, i in sorted(found):
            k, s = self.k[i], self.sets[i]
            mine = grams[k][first[d] : max(first[d], first[d + 1] - k + 1)]
            n = int(np.isin(s, mine).sum())
            if n >= THRESHOLD * len(s) - 1e-9:
                yield d, i, len(s), n


def _cut(first: np.ndarray, n: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of every document: its number, begin and end (in one array), and whether the next block is of the same."""
    count = -(-n // block)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[doc] + nth * block
    return doc, np.stack([begin, np.minimum(begin + block, first[doc] + n[doc])], 1).ravel(), doc[1:] == doc[:-1]


def search(docs: DataFrame, items: DataFrame, recall: float = 0.9999, block_items: int = 20_000, block_chars: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_found: every document and item of ``items``
    (item_id, text) of which the document contains at least 0.8."""
    spark = docs.sparkSession
    out = None
    for block in _blocks(items, block_items, block_chars):
        shared = spark.sparkContext.broadcast(Index(block, recall))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                rows: list[tuple[int, int, int, int]] = []
                for row, data, offsets in slices(b.column(1), 1 << 19):
                    w = Words(data, offsets)
                    rows += [(row + d, index.ids[i], n, m) for d, i, n, m in index.search(w.hash, w.first)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2, 3))], names=["doc_id", "item_id", "n_shingles", "n_found"])
            give_back()

        hits = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, n_shingles long, n_found long")
        out = hits if out is None else out.union(hits)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, n_shingles long, n_found long")


def _blocks(items: DataFrame, block_items: int, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one block on the driver at a time."""
    block, chars = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        if block and (len(block) == block_items or chars + len(r.t) > block_chars):
            yield block
            block, chars = [], 0
        block.append((r.i, r.t))
        chars += len(r.t)
    if block:
        yield block


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain an item; rows with a null doc_id are judged by their own text."""
    key = F.xxhash64("doc_id", "text")  # the text names the row, so repeated and null ids are safe
    hits = search(docs.select(key.alias("doc_id"), "text"), items).select("doc_id").distinct()
    return without(docs, key, materialize(hits, "contaminated"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
