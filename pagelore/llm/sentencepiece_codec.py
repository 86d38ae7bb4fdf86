"""SentencePiece encoding and decoding, batched in numpy.

The model file gives the pieces (a protobuf, read with the installed library). A text
is cut where no piece can cross - before a space mark that follows something else - and
the distinct words of a batch are grouped by length in characters, so that equal-length
words advance together: at every end position all substrings of one width are hashed at
once, the hashes probe the sorted keys of the pieces, and vectorised maxima store scores
and backpointers.

For a unigram model this Viterbi search is the encoding. For a BPE model the best sum of
scores isn't what the merges give (README has the measured difference), so there the
same batches run the merges instead: substring hashes of all adjacent pairs probe the
same sorted keys, and a vectorised maximum picks each word's best pair until none is
left. :func:`encode_words` chooses by the model's own kind.

Characters outside the vocabulary become byte pieces (or the unknown piece in a model
without them). Decoding joins pieces and bytes back.

Defined cases: null and empty texts have no ids and decode to the empty text; texts
that contain the space mark U+2581 itself decode with spaces in its place, as the
library does; any text of any length is encoded whole; further columns are kept by
:func:`encode` under their names, dots and all (its own are ``ids`` and ``n_tokens``,
which replace columns of these names in any case); a repeated row is encoded again; an
empty table gives no rows.
"""

from __future__ import annotations

import array
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from pagelore.llm._common import WordMemory, give_back, mix, named, table

SPACE = "▁"
#: Words of one length that advance together.
ROWS = 4096
#: Bytes of words and ids that a task remembers, about.
MEMORY_BYTES = 32 << 20

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def public_model() -> str:
    """The 32k model among the public vocabulary files; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_MUL = np.uint64(0x9E3779B97F4A7C15)
_pw = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(4095, _MUL, np.uint64)]))


def _codes(words: list[str]) -> np.ndarray:
    """Code points of equal-length words, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


class Model:
    """Pieces with sorted substring hashes, scores, and the byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.bpe = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        n = proto.normalizer_spec
        self.prefix, self.squeeze, self.escape = n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces
        if n.precompiled_charsmap:
            raise ValueError("a model with a normalisation table isn't supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = np.array([p.type for p in proto.pieces], np.int8)
        self.scores = np.array([p.score for p in proto.pieces], np.float64)
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.bytes = np.full(256, -1, np.int64)
        for i in np.flatnonzero(self.kinds == BYTE).tolist():
            self.bytes[int(self.pieces[i][3:-1], 16)] = i
        self.by_byte = bool((self.bytes >= 0).all())
        known = [i for i in range(len(self.pieces)) if self.kinds[i] in (NORMAL, USER)]
        self.longest = max(len(self.pieces[i]) for i in known)
        by_length: dict[int, list[int]] = {}
        for i in known:
            by_length.setdefault(len(self.pieces[i]), []).append(i)
        keys, ids = [], []
        for group in by_length.values():
            c = _codes([self.pieces[i] for i in group])
            keys.append(self._key((c * _pw[: c.shape[1]]).sum(1, dtype=np.uint64), c.shape[1]))
            ids += group
        keys, ids = np.concatenate(keys), np.array(ids, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], ids[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        #: Text of each piece as bytes, for decoding.
        self.out = [bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        # a cut before a space mark is safe if no piece has one after something else
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if not any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in known) else re.compile(r"(?s).+")
        self.lowest = self.scores[known].min() - 10
        self.forget()

    def forget(self) -> None:
        """Words are remembered in bounded memory until their task ends: the worker lives on."""
        self.memory = WordMemory(MEMORY_BYTES)

    @staticmethod
    def _key(poly: np.ndarray, length: int) -> np.ndarray:
        return mix(poly * np.uint64(2) + np.uint64(2 * length + 1))

    def find(self, poly: np.ndarray, length) -> np.ndarray:
        """Piece ids of substrings, given by their polynomials and lengths; -1 for none."""
        key = mix(poly * np.uint64(2) + np.asarray(2 * np.asarray(length, np.int64) + 1).astype(np.uint64))
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ids[at], -1)

    # ---------------------------------------------------------- equal-length words

    def _prefixes(self, c: np.ndarray) -> np.ndarray:
        """h[:, i]: polynomial of the first i characters, first character highest power last."""
        h = np.zeros((c.shape[0], c.shape[1] + 1), np.uint64)
        np.cumsum(c * self._powers(c.shape[1]), axis=1, out=h[:, 1:])
        return h

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        global _pw
        if n >= len(_pw):
            _pw = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, _MUL, np.uint64)]))
        return _pw[:n]

    _INV = pow(int(_MUL), -1, 1 << 64)

    def _inverse(self, n: int) -> np.ndarray:
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), self._INV, np.uint64)]))[:n]

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Best segmentations of equal-length words by the sum of scores."""
        c = _codes(words)
        rows, n = c.shape
        h, inv = self._prefixes(c), self._inverse(n + 1)
        best = np.full((rows, n + 1), -np.inf)
        back = np.zeros((rows, n + 1), np.int64)
        piece = np.full((rows, n + 1), -1, np.int64)
        best[:, 0] = 0
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                ids = self.find((h[:, end] - h[:, start]) * inv[start], end - start)
                score = np.where(ids >= 0, self.scores[ids], self.lowest if end - start == 1 else -np.inf) + best[:, start]
                better = score > best[:, end]
                best[better, end], back[better, end], piece[better, end] = score[better], start, ids[better]
        out = []
        for r, w in enumerate(words):
            ids, end = [], n
            while end:
                start, p = int(back[r, end]), int(piece[r, end])
                ids[:0] = [p] if p >= 0 else self.fallback(w[start:end])
                end = start
            out.append(ids)
        return out

    def merges(self, words: list[str]) -> list[list[int]]:
        """What the merges of a BPE model make of equal-length words, all advancing together.

        Each round probes the hashes of adjacent symbols that changed, takes every
        word's best pair (highest score, then leftmost), and joins it."""
        c = _codes(words)
        rows, n = c.shape
        h, inv = self._prefixes(c), self._inverse(n + 1)
        edge = np.tile(np.arange(n + 1), (rows, 1))  # symbol i of a row is [edge[i], edge[i + 1])
        count = np.full(rows, n)
        live = np.arange(rows)
        if n > 1:
            score = self._pair_scores(h, inv, edge[:, :-2], edge[:, 2:])
        while n > 1 and len(live):
            at = score[live].argmax(1)
            top = score[live, at]
            live, at = live[top > -np.inf], at[top > -np.inf]
            if not len(live):
                break
            # drop the edge between the two symbols and shift what is behind it
            cols = np.arange(n + 1)
            source = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), n)
            edge[live] = np.take_along_axis(edge[live], source, 1)
            count[live] -= 1
            cols = np.arange(n - 1)
            source = np.minimum(cols[None, :] + (cols[None, :] >= at[:, None]), n - 2)
            moved = np.take_along_axis(score[live], source, 1)
            moved[:, n - 2] = -np.inf
            for near in (-1, 0):  # the pairs that contain the new symbol
                i = at + near
                ok = (i >= 0) & (i + 1 < count[live])
                r, j = live[ok], i[ok]
                s = self._pair_scores(h[r], inv, edge[r, j][:, None], edge[r, j + 2][:, None])[:, 0]
                moved[np.flatnonzero(ok), j] = s
                gone = (i >= 0) & (i <= n - 2) & ~ok
                moved[np.flatnonzero(gone), i[gone]] = -np.inf
            score[live] = moved
        # ids of all symbols of all rows at once
        there = np.arange(n)[None, :] < count[:, None]
        r, start, end = np.repeat(np.arange(rows), count), edge[:, :-1][there], edge[:, 1:][there]
        ids = self.find((h[r, end] - h[r, start]) * inv[start], end - start)
        stop = np.cumsum(count).tolist()
        flat, odd = ids.tolist(), set(r[ids < 0].tolist())
        out = []
        for i, (a, b) in enumerate(zip([0, *stop[:-1]], stop, strict=True)):
            row = flat[a:b]
            if i in odd:
                row = [x for j, p in enumerate(row, a) for x in ([p] if p >= 0 else self.fallback(words[i][start[j] : end[j]]))]
            out.append(row)
        return out

    def _pair_scores(self, h: np.ndarray, inv: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        ids = self.find((np.take_along_axis(h, end, 1) - np.take_along_axis(h, start, 1)) * inv[start], end - start)
        return np.where(ids >= 0, self.scores[ids], -np.inf)

    def fallback(self, text: str) -> list[int]:
        return [int(self.bytes[b]) for b in text.encode()] if self.by_byte else [self.unknown]

    # ---------------------------------------------------------- texts

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words, in batches of equal length."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        out: dict[str, list[int]] = {}
        for n, group in by_length.items():
            if self.bpe and n > 512:
                for w in group:
                    out[w] = self._long_word(w)
                continue
            step = max(1, ROWS * 16 // max(n, 16))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                out.update(zip(part, (self.merges if self.bpe else self.viterbi)(part), strict=True))
        return out

    def _long_word(self, w: str) -> list[int]:
        """The merges of one very long word with a heap: n log n instead of n rounds over n pairs."""
        import heapq

        n = len(w)
        left, right, end = list(range(-1, n - 1)), [*range(1, n), -1], list(range(1, n + 1))
        known = self.table()
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (p := known.get(w[i : end[j]])) is not None:
                heapq.heappush(heap, (-self.scores[p], i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        gone = bytearray(n)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if gone[i] or end[i] != mid or right[i] < 0 or end[right[i]] != stop:
                continue
            j = right[i]
            gone[j], end[i], right[i] = 1, stop, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        out, i = [], 0
        while 0 <= i < n:
            p = known.get(w[i : end[i]])
            out += [p] if p is not None else self.fallback(w[i : end[i]])
            i = right[i]
        return out

    def table(self) -> dict[str, int]:
        if not hasattr(self, "_table"):
            self._table = {self.pieces[i]: int(i) for i in self.ids.tolist()}
        return self._table

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; the words of earlier batches are remembered, their ids as bytes."""
        cut = [self.cut.findall(self.normal(t)) for t in texts]
        new = self.encode_words(self.memory.missing(set(itertools.chain.from_iterable(cut))))
        self.memory.put(list(new), [array.array("i", ids).tobytes() for ids in new.values()])
        known = self.memory.young
        for words in cut:
            yield np.frombuffer(b"".join([known[w] for w in words]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        out = self.out
        text = b"".join([out[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _batches(texts: pa.Array, chars: int = 1 << 20) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        t = t.as_py() or ""
        held.append(t)
        n += len(t)
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with the ids of every text (``ids``: array of int) and ``n_tokens``."""
    where = path or public_model()
    text = next((c for c in docs.columns if c == "text"), None) or next(c for c in docs.columns if c.lower() == "text")
    kept = [c for c in docs.columns if c.lower() not in ("ids", "n_tokens")]
    at, plain = kept.index(text), [f"c{i}" for i in range(len(kept))]
    schema = StructType([*docs.select(*named(kept)).toDF(*plain).schema, StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(where)
        for b in batches:
            start = 0
            for texts in _batches(b.column(at)):
                ids = list(m.encode(texts))
                n = [len(x) for x in ids]
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                part = b.slice(start, len(texts))
                start += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32())), pa.array(n, pa.int64())], names=[*plain, "ids", "n_tokens"])
        m.forget()
        give_back()

    return docs.select(*named(kept)).toDF(*plain).mapInArrow(run, schema).toDF(*kept, "ids", "n_tokens")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    n_fallback (byte or unknown pieces), decoded_sha256 and round_trip (decoded = text)."""
    where = path or public_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(where)
        odd = np.isin(m.kinds, (BYTE, UNKNOWN))
        for b in batches:
            rows = []
            for texts in _batches(b.column(1)):
                for t, ids in zip(texts, m.encode(texts), strict=True):
                    back = m.decode(ids)
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), int(odd[ids].sum()), hashlib.sha256(back.encode()).hexdigest(), back == t))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_tokens", "ids_crc32", "n_fallback", "decoded_sha256", "round_trip"])
        m.forget()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, n_fallback long, decoded_sha256 string, round_trip boolean")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` (with ``ids``) with ``text`` in place of the ids."""
    where = path or public_model()
    shared = F.pandas_udf(lambda s: s.map(lambda ids: model(where).decode(np.asarray(ids, np.int32)) if ids is not None else ""), "string")
    return rows.select(*named(c for c in rows.columns if c.lower() not in ("ids", "text")), shared("ids").alias("text"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
