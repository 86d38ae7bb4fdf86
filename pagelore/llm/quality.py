"""Quality classifier: a byte-level convolutional network in numpy.

Architecture. A text's UTF-8 bytes are cut into overlapping chunks of ``CHUNK`` bytes,
``STRIDE`` apart, that cover the whole of it. Bytes are embedded (a learnt table), a
convolution of ``FILTERS`` learnt filters of width ``WIDTH`` runs over each chunk, and
each filter's response is max-pooled and averaged over the chunk; a hidden layer turns
the pooled responses into chunk features, these are max-pooled and averaged over the
chunks of the text, and a logistic layer gives one probability.

Convolution by tables: embedding times filter is one table of responses for each
(offset, byte), so a convolution is WIDTH table rows added up; there is no im2col.

Training is mini-batch Adam with hand-written gradients on the driver, from the whole
texts of labelled rows outside the held-out fold: at most ``max_rows`` rows and
``max_chars`` characters (:mod:`pagelore.llm._labels`). An epoch shows each text a window
at a random place of the whole of it, of one to ``WINDOWS[-1]`` times ``train_bytes``, so
that maxima over few and over many chunks are both learnt. Scoring always reads the
whole text.

Defined cases: null or empty text is one chunk of padding, so it has a score as well;
a table without labels of both kinds yields 0.5 for every text; a null doc_id is scored
(held_out null); equal texts tie, repeated rows are scored each; an empty table gives no
rows; very long texts are scored whole; of several labels of a doc_id the largest counts;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm._common import give_back, slices, table
from pagelore.llm._labels import labelled_sample

CHUNK, STRIDE, WIDTH = 256, 192, 6
EMBED, FILTERS, HIDDEN = 8, 16, 16
#: Byte number of padding in the embedding table.
PAD = 256
#: Lengths of training windows, in units of ``train_bytes``, and how often each is drawn.
WINDOWS, WINDOW_SHARES = (1, 2, 4, 16), (0.42, 0.36, 0.2, 0.02)


@dataclass
class Network:
    embed: np.ndarray  # 257 x EMBED
    conv: np.ndarray  # WIDTH x EMBED x FILTERS
    conv_b: np.ndarray  # FILTERS
    hidden: np.ndarray  # 2 FILTERS x HIDDEN
    hidden_b: np.ndarray
    out: np.ndarray  # 2 HIDDEN
    out_b: np.ndarray  # 1
    trained: bool = True

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        g = lambda *s: r.standard_normal(s).astype(np.float32)
        return Network(g(257, EMBED) * 0.5, g(WIDTH, EMBED, FILTERS) / np.sqrt(WIDTH * EMBED, dtype=np.float32), np.zeros(FILTERS, np.float32), g(2 * FILTERS, HIDDEN) / np.sqrt(2 * FILTERS, dtype=np.float32), np.zeros(HIDDEN, np.float32), g(2 * HIDDEN) / np.sqrt(2 * HIDDEN, dtype=np.float32), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_b, self.hidden, self.hidden_b, self.out, self.out_b]

    def responses(self) -> np.ndarray:
        """WIDTH x 257 x FILTERS: what each byte adds at each offset."""
        return np.ascontiguousarray(np.einsum("be,wef->wbf", self.embed, self.conv))


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks of bytes, number of the text of each): every text has at least one chunk, and
    its last chunk reaches its end."""
    size = np.diff(offsets)
    count = np.maximum(1, 1 + -(-(size - CHUNK) // STRIDE))
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[:-1][text] + nth * STRIDE
    at = begin[:, None] + np.arange(CHUNK)
    out = np.full(at.shape, PAD, np.int16)
    inside = at < offsets[1:][text][:, None]
    out[inside] = data[at[inside]]
    return out, text


def _conv(x: np.ndarray, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    n = CHUNK - WIDTH + 1
    z = tables[0][x[:, :n]]
    for w in range(1, WIDTH):
        z += tables[w][x[:, w : w + n]]
    z += bias
    return np.maximum(z, 0, out=z)


def forward(net: Network, tables: np.ndarray, x: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, tuple]:
    """Logits of n texts, and what the gradients need."""
    z = _conv(x, tables, net.conv_b)
    top = z.argmax(1)
    pooled = np.concatenate([np.take_along_axis(z, top[:, None, :], 1)[:, 0], z.mean(1)], 1)
    h = np.maximum(pooled @ net.hidden + net.hidden_b, 0)
    first = np.searchsorted(text, np.arange(n))
    best = np.maximum.reduceat(h, first, axis=0)
    count = np.bincount(text, minlength=n)[:, None].astype(np.float32)
    mean = np.add.reduceat(h, first, axis=0) / count
    both = np.concatenate([best, mean], 1)
    return both @ net.out + net.out_b[0], (z, top, pooled, h, best, count, both)


def _gradients(net: Network, x: np.ndarray, text: np.ndarray, d: np.ndarray, held: tuple) -> list[np.ndarray]:
    """Gradients of all parameters for logit gradients ``d``."""
    z, top, pooled, h, best, count, both = held
    g_out, g_out_b = both.T @ d, np.array([d.sum()], np.float32)
    d_both = d[:, None] * net.out[None]
    d_h = (h == best[text]) * d_both[text, :HIDDEN] + (d_both[:, HIDDEN:] / count)[text]
    d_h = d_h * (h > 0)
    g_hidden, g_hidden_b = pooled.T @ d_h, d_h.sum(0)
    d_pool = d_h @ net.hidden.T
    rows, length = x.shape[0], z.shape[1]
    d_z = np.broadcast_to(d_pool[:, None, FILTERS:] / length, z.shape).copy()
    r, f = np.arange(rows)[:, None], np.arange(FILTERS)[None]
    d_z[r, top, f] += d_pool[:, :FILTERS]
    d_z *= z > 0
    g_conv_b = d_z.sum((0, 1))
    g_tables = np.empty((WIDTH, 257, FILTERS), np.float32)
    flat = d_z.reshape(-1, FILTERS)
    for w in range(WIDTH):
        b = x[:, w : w + length].ravel()
        one_hot_sum = np.zeros((257, FILTERS), np.float32)
        order = np.argsort(b, kind="stable")
        at = np.searchsorted(b[order], np.arange(257))
        there = np.flatnonzero(np.diff(np.append(at, len(b))) > 0)
        one_hot_sum[there] = np.add.reduceat(flat[order], at[there], axis=0)
        g_tables[w] = one_hot_sum
    return [np.einsum("wbf,wef->be", g_tables, net.conv), np.einsum("wbf,be->wef", g_tables, net.embed), g_conv_b, g_hidden, g_hidden_b, g_out, g_out_b]


def fit(texts: list[bytes], labels: list[int], epochs: int | None = None, batch: int = 32, train_bytes: int = 896, rate: float = 4e-3, seed: int = 7) -> Network:
    """Train on bytes and 0/1 labels; an epoch shows each text a random window of a random
    length, long ones more rarely."""
    net, y = Network.fresh(seed), np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.trained = False
        return net
    epochs = epochs or min(60, max(8, 700 * batch // len(y)))  # few rows are seen more often
    r = np.random.default_rng(seed)
    weight = np.where(y == 1, 1.0, max(1.0, min(3.0, y.mean() / max(1e-6, 1 - y.mean()))) ** 0.5).astype(np.float32)
    params = net.parameters()
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    total = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        for part in np.array_split(r.permutation(len(y)), -(-len(y) // batch)):
            cut = []
            for i in part:
                t = texts[i]
                size = train_bytes * int(r.choice(WINDOWS, p=WINDOW_SHARES))
                at = int(r.integers(0, len(t) - size + 1)) if len(t) > size else 0
                cut.append(t[at : at + size])
            data = np.frombuffer(b"".join(cut), np.uint8)
            x, text = chunks(data, np.concatenate([[0], np.cumsum([len(c) for c in cut])]))
            logits, held = forward(net, net.responses(), x, text, len(part))
            p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            grads = _gradients(net, x, text, (weight[part] * (p - y[part]) / len(part)).astype(np.float32), held)
            step += 1
            now = rate * min(1, step / 20) * (0.05 + 0.95 * (1 - step / total))
            for q, g, a, b in zip(params, grads, m, v, strict=True):
                g = np.clip(g, -1, 1) + 1e-5 * q
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                q -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def predict(net: Network, data: np.ndarray, offsets: np.ndarray, rows: int = 512) -> np.ndarray:
    """Probabilities of a slice of texts, ``rows`` chunks in memory at a time."""
    n = len(offsets) - 1
    if not net.trained:
        return np.full(n, 0.5)
    tables = net.responses()
    x, text = chunks(data, offsets)
    best, total = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for i in range(0, len(x), rows):
        z = _conv(x[i : i + rows], tables, net.conv_b)
        h = np.maximum(np.concatenate([z.max(1), z.mean(1)], 1) @ net.hidden + net.hidden_b, 0)
        t = text[i : i + rows]
        first = np.flatnonzero(np.diff(t, prepend=-1))
        best[t[first]] = np.maximum(best[t[first]], np.maximum.reduceat(h, first, axis=0))
        total[t[first]] += np.add.reduceat(h, first, axis=0)
    count = np.bincount(text, minlength=n)[:, None]
    logits = np.concatenate([best, total / count], 1) @ net.out + net.out_b[0]
    return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_chars: int = 30_000_000, fold: int = 4, held: int = 2) -> Network:
    """Fit on a bounded sample of the labelled rows outside the held-out fold."""
    texts, ys = labelled_sample(docs, labels, "quality", fold, held, max_rows, max_chars)
    return fit([t.encode() for t in texts], ys)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score for every row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [predict(shared.value, data, offsets) for _, data, offsets in slices(b.column(1), 1 << 19)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.expr("pmod(crc32(cast(doc_id as string)), 4) = 2").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
