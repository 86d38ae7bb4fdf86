"""Token ids in a binary format of compressed bit or byte planes.

A shard file holds the ids of consecutive documents as one stream. The stream is cut
into blocks of a fixed number of ids; a block is transposed - bit plane i is bit i of
all its ids packed together, or byte plane i their i-th bytes - and each plane is
compressed with zstandard on its own, so the nearly constant high planes vanish. A
chunk index at the end gives every block's position, so a block is read alone.

File layout (all numbers little-endian)::

    magic "PLNS2\\0" | u8 layout (1 bits, 2 bytes) | u8 planes | u32 ids a block
    blocks of ids: the compressed planes, one after the other; between them
    blocks of the document table, zstandard: i64 doc_id (0 where null), u64 n_tokens, u8 null mark, column by column
    index, zstandard: per id block u64 offset, u32 ids, then u32 length of each plane;
        per table block u64 offset, u32 length, u32 documents
    footer: u64 index offset, u64 documents, u64 ids, u32 id blocks, u32 table blocks, magic

Documents are dealt to shards by ranges of doc_id (rows that share one by their text's
hash) and sorted in each, so shard after shard the ids stand in ascending doc_id order.
Shards are as many as the input's bytes call for. Every task streams: it holds one batch
of texts, one block of ids and one of the document table. A shard is written under a name
of its own attempt and ``manifest.json`` lists the names that count, so a retried or
speculative task leaves no harm and another job can read the files.

Defined cases: null or empty text is the end id alone; a null doc_id sorts first;
repeated doc_ids each get their rows' ids, equal rows too, in the order of their texts'
hashes; an empty table gives no shard and no rows; very long texts fill as many blocks as
they need; a special token's string in a text is that token, as the library has it; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm._common import HASH_BYTES, give_back, mix, power_tables, scratch, table

MAGIC = b"PLNS2\0"
BITS, BYTES = 1, 2
BLOCK_IDS = 1 << 16
END_ID = 0
LEVEL = 3
#: Documents of one block of the document table.
TABLE_DOCS = 1 << 16
#: Bytes of stored input that one shard is made of, about.
SHARD_BYTES = 128 << 20
_FOOTER = struct.Struct("<QQQII6s")
_TABLE = struct.Struct("<QII")


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------ planes


def to_planes(ids: np.ndarray, layout: int, planes: int) -> list[bytes]:
    """The transposed planes of one block."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if layout == BYTES:
        return [raw[:, i].tobytes() for i in range(planes)]
    word = np.ascontiguousarray(ids, "<u4")
    return [np.packbits((word >> np.uint32(i)).astype(np.uint8) & 1, bitorder="little").tobytes() for i in range(planes)]


def from_planes(parts: list[bytes], n: int, layout: int) -> np.ndarray:
    if layout == BYTES:
        raw = np.zeros((n, 4), np.uint8)
        for i, p in enumerate(parts):
            raw[:, i] = np.frombuffer(p, np.uint8)
        return raw.view("<u4").ravel()
    ids = np.zeros(n, "<u4")
    for i, p in enumerate(parts):
        ids |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(i)
    return ids


class Writer:
    """One shard file; ``add`` takes whole documents, memory holds one block of ids and one of documents."""

    def __init__(self, sink: Any, layout: int = BITS, planes: int = 16, block: int = BLOCK_IDS, table_docs: int = TABLE_DOCS):
        self.sink, self.layout, self.planes, self.block, self.table_docs = sink, layout, planes, block, table_docs
        self.at = self.n = self.n_docs = self.n_held = 0
        self.held: list[np.ndarray] = []
        self.docs: list[tuple[int, int, bool]] = []
        self.index: list[tuple[int, int, list[int]]] = []
        self.tables: list[tuple[int, int, int]] = []
        self._put(MAGIC + struct.pack("<BBI", layout, planes, block))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >= 1 << (self.planes * (1 if self.layout == BITS else 8)):
            raise ValueError("an id needs more planes than the file has")
        self.docs.append((doc_id or 0, len(ids), doc_id is None))
        if len(self.docs) == self.table_docs:
            self._documents()
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            stream = np.concatenate(self.held)
            whole = len(stream) // self.block * self.block
            for i in range(0, whole, self.block):
                self._block(stream[i : i + self.block])
            self.held, self.n_held = [stream[whole:]], len(stream) - whole

    def _block(self, ids: np.ndarray) -> None:
        press = zstandard.ZstdCompressor(level=LEVEL)
        parts = [press.compress(p) for p in to_planes(ids, self.layout, self.planes)]
        self.index.append((self.at, len(ids), [len(p) for p in parts]))
        self._put(b"".join(parts))
        self.n += len(ids)

    def _documents(self) -> None:
        doc_ids, sizes, null = zip(*self.docs, strict=True)
        data = zstandard.ZstdCompressor(level=LEVEL).compress(np.array(doc_ids, "<i8").tobytes() + np.array(sizes, "<u8").tobytes() + np.array(null, "u1").tobytes())
        self.tables.append((self.at, len(data), len(self.docs)))
        self._put(data)
        self.n_docs += len(self.docs)
        self.docs = []

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        if self.docs:
            self._documents()
        index_at = self.at
        blocks = [struct.pack(f"<QI{self.planes}I", o, n, *lengths) for o, n, lengths in self.index]
        self._put(zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(blocks + [_TABLE.pack(*t) for t in self.tables])))
        self._put(_FOOTER.pack(index_at, self.n_docs, self.n, len(self.index), len(self.tables), MAGIC))


class Reader:
    """Random access to one shard file."""

    def __init__(self, source: Any):
        self.source = source
        if self._get(0, 6) != MAGIC:
            raise ValueError("not a token plane file")
        self.layout, self.planes, self.block = struct.unpack("<BBI", self._get(6, 6))
        at = source.size() - _FOOTER.size
        index_at, self.n_docs, self.n, n_blocks, n_tables, magic = _FOOTER.unpack(self._get(at, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("the file is cut off")
        one = struct.Struct(f"<QI{self.planes}I")
        first_table = one.size * n_blocks
        raw = zstandard.ZstdDecompressor().decompress(self._get(index_at, at - index_at), max_output_size=first_table + _TABLE.size * n_tables + 1)
        self.index = [one.unpack_from(raw, i * one.size) for i in range(n_blocks)]
        self.tables = [_TABLE.unpack_from(raw, first_table + i * _TABLE.size) for i in range(n_tables)]

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block_ids(self, i: int) -> np.ndarray:
        """The ids of block i alone."""
        at, n, *lengths = self.index[i]
        raw, open_, parts, o = self._get(at, sum(lengths)), zstandard.ZstdDecompressor(), [], 0
        for x in lengths:
            parts.append(open_.decompress(raw[o : o + x], max_output_size=n + 8))
            o += x
        return from_planes(parts, n, self.layout)

    def table_rows(self) -> Iterator[tuple[int | None, int]]:
        """(doc_id, number of ids) of every document, one block of the table in memory."""
        for at, length, n in self.tables:
            t = zstandard.ZstdDecompressor().decompress(self._get(at, length), max_output_size=17 * n + 1)
            columns = (np.frombuffer(t, "<i8", n), np.frombuffer(t, "<u8", n, 8 * n), np.frombuffer(t, "u1", n, 16 * n))
            for doc_id, size, null in zip(*(c.tolist() for c in columns), strict=True):
                yield (None if null else doc_id), size

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order, one block in memory (and one document)."""
        block, held = 0, np.zeros(0, np.uint32)
        for doc_id, n in self.table_rows():
            parts, have = [held], len(held)
            while have < n:
                x = self.block_ids(block)
                block += 1
                parts.append(x)
                have += len(x)
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, held[:n]
            held = held[n:]


# ------------------------------------------------------------------ encoding

#: Bytes of pieces and ids that a worker process remembers, about.
MEMORY_BYTES = 160 << 20
#: Pieces that are encoded as one text.
TOGETHER = 512
#: Characters that are cut at once, about; and of a piece, beyond which its text is encoded whole.
CUT_UNITS, LONGEST = 1 << 20, 1 << 16
#: Characters beyond those whose class all Unicode versions share.
_ODD = re.compile("[^\t\n\r -~\xa1-\u024f\u2010-\u2027\u2030-\u205e]")
# How a byte-level model's own expression cuts a text, over the plain characters.
_LETTERS, _DIGITS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\\s{_LETTERS}{_DIGITS}]+|\\s+(?!\\S)|\\s+")
_SPACE, _LETTER, _DIGIT, _OTHER, _END = range(5)
#: What separates texts; no plain character.
_SEPARATOR = "\0"


def _kinds() -> np.ndarray:
    kind = np.full(1 << 16, _OTHER, np.uint8)
    for which, chars in ((_LETTER, f"[{_LETTERS}]"), (_DIGIT, f"[{_DIGITS}]"), (_SPACE, "[\t\n\r ]"), (_END, _SEPARATOR)):
        kind[[ord(c) for c in re.findall(chars, "".join(map(chr, range(0x2100))))]] = which
    return kind


_KIND = _kinds()
_VALUE = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pieces(units: np.ndarray) -> np.ndarray:
    """Where the pieces of plain texts begin, as ``_PIECES`` cuts them: ``units`` are their
    characters, every text followed by a separator, which is a piece too."""
    kind = _KIND[units]
    start = np.ones(len(units), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _END
    # of white space before something else the last character stands alone, or opens that if it is a space
    solid = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END)) + 1
    start[solid - 1] = True
    start[solid] = units[solid - 1] != 32
    quote = np.flatnonzero((units[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER))
    for ending in ("s", "t", "m", "d", "re", "ve", "ll"):
        at = quote
        for i, c in enumerate(ending, 1):
            at = at[units[at + i] == ord(c)]  # a separator ends the units: there is a next one
        start[at + 1] = False
        start[at + 1 + len(ending)] = True
    return np.flatnonzero(start)


def _piece_hashes(units: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    out, i = np.zeros(len(at), np.uint64), 0
    while i < len(at):
        a = at[i]
        j = max(i + 1, int(np.searchsorted(at, a + HASH_BYTES)))
        part = units[a : at[j - 1] + size[j - 1]]
        power, inverse = power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * power[: len(part)], out=total[1:])
        first = at[i:j] - a
        out[i:j] = mix((total[first + size[i:j]] - total[first]) * inverse[first] + size[i:j].astype(np.uint64))
        i = j
    return out


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of size[0] numbers, then those of first[1] and so on."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class _Lists:
    """Lists of numbers, one after the other in one array that grows."""

    def __init__(self, kind: np.dtype):
        self.data, self.n = np.zeros(1 << 10, kind), 0
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        if self.n + len(flat) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(len(flat) + self.n // 2 + 1024, self.data.dtype)])
        self.data[self.n : self.n + len(flat)] = flat
        self.first = np.concatenate([self.first, self.n + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.n += len(flat)


class PieceMemory:
    """Pieces and their ids in arrays, at most about ``most`` bytes.

    A table of slots finds a piece by its 64-bit hash; what has the hash is then compared
    character by character, so equal hashes of unlike pieces never give wrong ids. When
    the bound is reached, pieces stay that were asked for again since the last time (none
    if they hold over half of it)."""

    def __init__(self, most: int, kind: np.dtype):
        self.most, self.kind = most, kind
        self.clear()

    def clear(self) -> None:
        self.key, self.again = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.text, self.ids = _Lists(np.dtype("<u2")), _Lists(self.kind)
        self.slots = np.full(1 << 12, -1, np.int32)

    def __len__(self) -> int:
        return len(self.key)

    @property
    def size(self) -> int:
        return 41 * len(self.key) + self.slots.nbytes + self.text.data.nbytes + self.ids.data.nbytes

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of what is known under each hash, or -1."""
        mask = np.uint64(len(self.slots) - 1)
        out, todo, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), (h & mask).astype(np.int64)
        while len(todo):
            there = self.slots[slot]
            taken = there >= 0
            hit = taken.copy()
            hit[taken] = self.key[there[taken]] == h[todo[taken]]
            out[todo[hit]] = there[hit]
            on = taken & ~hit
            todo, slot = todo[on], (slot[on] + 1) & int(mask)
        return out

    def _seat(self, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (self.key[numbers] & np.uint64(mask)).astype(np.int64)
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]  # of several for one slot one stays
            on = self.slots[slot] != numbers
            numbers, slot = numbers[on], (slot[on] + 1) & mask

    def add(self, key: np.ndarray, text: np.ndarray, text_size: np.ndarray, ids: np.ndarray, ids_size: np.ndarray) -> None:
        """Pieces with hashes that aren't known, all different."""
        n = len(self.key)
        self.key, self.again = np.concatenate([self.key, key]), np.concatenate([self.again, np.zeros(len(key), bool)])
        self.text.add(text, text_size)
        self.ids.add(ids, ids_size)
        grown = len(self.slots)
        while grown < 2 * len(self.key):
            grown *= 2
        if grown > len(self.slots):
            self.slots = np.full(grown, -1, np.int32)
            n = 0
        self._seat(np.arange(n, len(self.key), dtype=np.int32))

    def bound(self) -> None:
        """Forget, if the bound is reached."""
        if self.size <= self.most:
            return
        key, text, ids, keep = self.key, self.text, self.ids, np.flatnonzero(self.again)
        self.clear()
        if 41 * len(keep) + 16 * len(keep) + 2 * int(text.size[keep].sum()) + self.kind.itemsize * int(ids.size[keep].sum()) <= self.most // 2:
            self.add(key[keep], *(x for y in (text, ids) for x in (y.data[_ranges(y.first[keep], y.size[keep])], y.size[keep])))


class Encoder:
    """Ids by the tokenizers library, a distinct piece at a time.

    A byte-level model cuts a text by a fixed expression and encodes each piece by itself,
    so the ids of a text are those of its pieces, which the library encodes once and this
    class remembers (in bounded memory). Many texts are cut and looked up at once, in
    arrays. Texts with characters beyond the plain ones or with a special token's string
    go to the library whole, and so does everything for models of another kind."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        before = json.loads(self.library.to_str())["pre_tokenizer"] or {}
        self.by_piece = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and self.library.normalizer is None
        #: Does a token begin with a space?
        self.opens = np.zeros(self.library.get_vocab_size() + 1, bool)
        for token, i in self.library.get_vocab().items():
            self.opens[i] = token.startswith("\u0120")
        #: Ids of pieces, of the smallest type.
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.memory = PieceMemory(MEMORY_BYTES, self.type)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        some: list[int] = []
        units = 0
        for i, t in enumerate(texts):
            if self.by_piece and not any(x in t for x in self.special) and not _ODD.search(t):
                some.append(i)
                units += len(t)
            if some and (units >= CUT_UNITS or i + 1 == len(texts)):
                for j, ids in zip(some, self._plain([texts[j] for j in some]), strict=True):
                    out[j] = ids
                some, units = [], 0
        return [self.whole([t])[0] if ids is None else ids for t, ids in zip(texts, out, strict=True)]

    def _plain(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of plain texts; None for one that the library has to encode whole."""
        joined = _SEPARATOR.join(texts) + _SEPARATOR
        units = np.frombuffer(joined.encode("utf-16-le"), "<u2")
        at = pieces(units)
        size = np.diff(np.append(at, len(units)))
        if size.max() > LONGEST:
            return [None] * len(texts) if len(texts) == 1 else [self._plain([t])[0] for t in texts]
        h, memory = _piece_hashes(units, at, size), self.memory
        memory.bound()
        which = memory.find(h)
        memory.again[which[which >= 0]] = True
        new = np.flatnonzero(which < 0)
        if len(new):
            key, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            first = new[first]
            # words that open with a space come first: they are encoded together
            word = (units[at[first]] == 32) & (_KIND[units[at[first] + size[first] - 1]] == _LETTER)
            order = np.argsort(~word, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            which[new] = len(memory) + rank[inverse]
            a, n = at[first[order]], size[first[order]]
            ids, ids_size = self._pieces([joined[i : i + k] for i, k in zip(a.tolist(), n.tolist(), strict=True)], int(word.sum()))
            memory.add(key[order], units[_ranges(a, n)], n, ids, ids_size)
        ends = np.flatnonzero(units[at] == 0)
        # are they what has these hashes?
        alike = memory.text.size[which] == size
        same = memory.text.data.take(_ranges(memory.text.first[which], size), mode="clip") == units
        if not same.all():
            alike &= np.logical_and.reduceat(same, at)
        n = memory.ids.size[which]
        flat = memory.ids.data[_ranges(memory.ids.first[which], n)].astype(np.uint32)
        cut = np.cumsum(n)[ends].tolist()
        found: list[np.ndarray | None] = [flat[a:b] for a, b in itertools.pairwise([0, *cut])]
        for i in np.searchsorted(ends, np.flatnonzero(~alike)).tolist():
            found[i] = None
        return found

    def _pieces(self, new: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each has) of pieces, each encoded by the library by itself; the first
        ``words`` open with a space, a separator has none."""
        ids, sizes = [], []
        for i in range(0, words, TOGETHER):
            part = new[i : min(i + TOGETHER, words)]
            # they are one text, cut where a token opens with a space
            flat = self.whole(["".join(part)])[0]
            at = np.flatnonzero(self.opens[flat])
            if len(at) == len(part) and at[0] == 0:
                ids.append(flat)
                sizes.append(np.diff(np.append(at, len(flat))))
            else:
                each = self.whole(part)
                ids += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        each = self.whole([w if w != _SEPARATOR else "" for w in new[words:]])
        ids += each
        sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate([np.zeros(0, np.uint32), *ids]).astype(self.type), np.concatenate(sizes)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder that all tasks of a worker process share, with what it remembers."""
    if path not in _encoders:
        _encoders.clear()  # one memory a worker
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ------------------------------------------------------------------ Spark


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (or plain path) of the shared folder."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _shards(docs: DataFrame) -> int:
    """One shard for SHARD_BYTES of input, and at least as many as shuffles have partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // SHARD_BYTES), 1_000_000))


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, layout: int = BITS, planes: int = 16, block: int = BLOCK_IDS, shards: int | None = None) -> list[dict]:
    """Write the ids of ``docs`` (doc_id, text) to shard files in ``folder``.

    Returns the manifest, in order: file, n_docs, n_ids of every shard (as many rows as
    shards); it is saved as ``manifest.json`` beside them too, for :func:`manifest`."""
    where = vocabulary or public_vocabulary()
    shards = shards or _shards(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(where).encode
        part = TaskContext.get().partitionId()
        fs, base = _place(folder)
        fs.create_dir(base, recursive=True)
        name, out, writer = f"shard-{part:06d}-{uuid.uuid4().hex[:12]}.pln", None, None
        for b in batches:
            for i in range(0, b.num_rows, 256):  # rows a call
                doc_ids = b.column(0).slice(i, 256).to_pylist()
                texts = [t or "" for t in b.column(1).slice(i, 256).to_pylist()]
                for doc_id, ids in zip(doc_ids, encode(texts), strict=True):
                    if writer is None:
                        out = fs.open_output_stream(f"{base}/{name}")
                        writer = Writer(out, layout, planes, block)
                    writer.add(doc_id, np.append(ids, np.uint32(END_ID)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([writer.n_docs], pa.int64()), "n_ids": pa.array([writer.n], pa.int64())})
        del writer
        give_back()

    order = [F.col("doc_id").asc_nulls_first(), F.col("__h").asc()]
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__h", F.xxhash64("text")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    written = sorted(dealt.select("doc_id", "text").mapInArrow(run, "part int, file string, n_docs long, n_ids long").collect())  # one row a shard
    rows = [{"file": r.file, "n_docs": r.n_docs, "n_ids": r.n_ids} for r in written]
    fs, base = _place(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps(rows).encode())
    return rows


def manifest(folder: str) -> list[dict]:
    """The saved manifest of a folder that :func:`write` filled."""
    fs, base = _place(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as source:
        return json.loads(source.read())


#: Rows of a batch that a reader hands on.
READ_ROWS = 1024


def _read(spark: SparkSession, folder: str, rows: list[dict] | None, row: Callable[[int | None, np.ndarray, int], tuple], types: list[pa.DataType], names: list[str], schema: str) -> DataFrame:
    """``row(doc_id, ids, number of ids before)`` of every document of the files of a manifest (the saved one by default)."""
    files, start = [], 0
    for m in manifest(folder) if rows is None else rows:
        files.append((m["file"], start))
        start += m["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _place(folder)
        for b in batches:
            for file, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{file}") as source:
                    out, size = [], 0
                    for doc_id, ids in Reader(source).documents():
                        out.append(row(doc_id, ids, at))
                        at, size = at + len(ids), size + len(ids)
                        if len(out) == READ_ROWS or size >= 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return spark.createDataFrame(files, "file string, start long").repartition(max(1, len(files))).mapInArrow(run, schema)


def read(spark: SparkSession, folder: str, rows: list[dict] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    digest = lambda doc_id, ids, at: (doc_id, at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()))
    return _read(spark, folder, rows, digest, [pa.int64()] * 4, ["doc_id", "start", "n_tokens", "ids_crc32"], "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str, rows: list[dict] | None = None) -> DataFrame:
    """doc_id and ids of every document, from the files."""
    return _read(spark, folder, rows, lambda doc_id, ids, at: (doc_id, ids.astype(np.int32)), [pa.int64(), pa.list_(pa.int32())], ["doc_id", "ids"], "doc_id long, ids array<int>")


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-planes")
    return read(spark, folder, write(table(spark, sf_dir, "documents"), folder))
