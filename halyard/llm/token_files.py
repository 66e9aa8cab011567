"""Token ids as binary files of patched frame-of-reference blocks.

A file holds, in this order: the magic, a block for every BLOCK ids, a table of documents (id, null flag, first id), the
block starts, and a footer (ids, documents, blocks, offsets of both tables). A block holds its minimum, the width that
WIDE percent of its differences from the minimum fit in, the differences packed at that width, and for all others, the
exceptions, their places and whole differences. Lengths are little-endian.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from halyard.llm.bpe import byte_alphabet
from halyard.llm.common import keep, shared_dir, small_batches, written
from halyard.llm.files import create, reopen, rows_of, spread

MAGIC = b"PFORIDS1"
BLOCK, LANES = 1024, 64
COLS = BLOCK // LANES
WIDE = 95
HEAD = struct.Struct("<IBH")
FOOT = struct.Struct("<QQQQQ")
#: Blocks that a writer packs, or a reader unpacks, at a time.
RUN = 512
#: Words that are known before those not met lately are forgotten; twice as many are kept at most.
CACHE_CHUNKS = 800_000


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ids; the last is filled up with its minimum."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return []
    full = np.full(n * BLOCK, ids[(n - 1) * BLOCK :].min(), np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(n, BLOCK)
    low = full.min(1)
    diff = (full - low[:, None]).astype(np.uint64)
    top = np.partition(diff, BLOCK * WIDE // 100, axis=1)[:, BLOCK * WIDE // 100]
    width = np.where(top > 0, np.frexp(top.astype(np.float64))[1], 0)
    out: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        over = diff[rows] >> np.uint64(w) > 0
        lanes = np.where(over, 0, diff[rows]).reshape(len(rows), LANES, COLS)
        packed = np.zeros((len(rows), w + 1, COLS), np.uint64)
        for j in range(LANES if w else 0):
            word, shift = divmod(j * w, 64)
            packed[:, word] |= lanes[:, j] << np.uint64(shift)
            if shift + w > 64:
                packed[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
        for k, r in enumerate(rows.tolist()):
            at = np.flatnonzero(over[k])
            out[r] = HEAD.pack(int(low[r]), w, len(at)) + packed[k, :w].astype("<u8").tobytes() + at.astype("<u2").tobytes() + diff[r, at].astype("<u4").tobytes()
    return out


def unpack_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at these offsets of raw, each BLOCK long."""
    heads = [HEAD.unpack_from(raw, s) for s in starts.tolist()]
    out = np.zeros((len(heads), BLOCK), np.uint64)
    width = np.array([h[1] for h in heads])
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            packed = np.stack([np.frombuffer(raw, "<u8", w * COLS, int(starts[r]) + HEAD.size).reshape(w, COLS) for r in rows])
            mask, lanes = np.uint64((1 << w) - 1), np.zeros((len(rows), LANES, COLS), np.uint64)
            for j in range(LANES):
                word, shift = divmod(j * w, 64)
                x = packed[:, word] >> np.uint64(shift)
                if shift + w > 64:
                    x = x | (packed[:, word + 1] << np.uint64(64 - shift))
                lanes[:, j] = x & mask
            out[rows] = lanes.reshape(len(rows), BLOCK)
    for r, (low, w, k) in enumerate(heads):
        if k:
            at = int(starts[r]) + HEAD.size + 8 * w * COLS
            out[r, np.frombuffer(raw, "<u2", k, at)] = np.frombuffer(raw, "<u4", k, at + 2 * k)
        out[r] += np.uint64(low)
    return out.astype(np.uint32).ravel()


class Writer:
    def __init__(self, folder: str):
        self.path, self.out = create(folder, ".pfor")
        self.out.write(MAGIC)
        self.at, self.starts, self.rest, self.n = len(MAGIC), [], [], 0
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, self.n))
        self.rest.append(ids)
        self.n += len(ids) // 4
        if self.n - len(self.starts) * BLOCK >= RUN * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.rest), "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for b in pack_blocks(ids[:whole]):
            self.starts.append(self.at)
            self.at += len(b)
            self.out.write(b)
        self.rest = [ids[whole:].tobytes()]

    def close(self) -> tuple[str, int]:
        self._flush(True)
        table = self.at
        self.out.write(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + np.array([d is None for d, _ in self.docs], "u1").tobytes() + np.array([s for _, s in self.docs], "<i8").tobytes())
        index = table + 17 * len(self.docs)
        self.out.write(np.array(self.starts, "<i8").tobytes() + FOOT.pack(self.n, len(self.docs), len(self.starts), table, index))
        self.out.close()
        return self.path, self.n


def read_file(path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, first id's place in the file, ids) of each document; a run of blocks is in memory at a time."""
    with reopen(path) as f:
        size = f.size()
        f.seek(size - FOOT.size)
        n, docs, blocks, table, index = FOOT.unpack(f.read(FOOT.size))
        f.seek(0)
        if f.read(len(MAGIC)) != MAGIC or index + 8 * blocks + FOOT.size != size or blocks != -(-n // BLOCK):
            raise ValueError(f"{path} is not a whole file of token ids")
        f.seek(table)
        raw = f.read(17 * docs)
        names, null, first = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "u1", docs, 8 * docs), np.frombuffer(raw, "<i8", docs, 9 * docs)
        f.seek(index)
        starts = np.append(np.frombuffer(f.read(8 * blocks), "<i8"), table)
        ends = np.append(first[1:], n)
        have, base, b = np.zeros(0, np.uint32), 0, 0
        for d in range(docs):
            if ends[d] > base + len(have):
                parts = [have[first[d] - base :]]
                base = int(first[d])
                while b < blocks and ends[d] > base + sum(map(len, parts)):
                    e = min(blocks, b + RUN)
                    f.seek(int(starts[b]))
                    parts.append(unpack_blocks(f.read(int(starts[e] - starts[b])), starts[b:e] - starts[b]))
                    b = e
                have = np.concatenate(parts)
            yield (None if null[d] else int(names[d])), int(first[d]), have[first[d] - base : ends[d] - base]


class Words(dict):
    """The ids of chunks by their word; a word that is met for the first time is learned."""

    def __init__(self, learn: Callable[[str], bytes | None]):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes | None:
        ids = self[word] = self.learn(word)
        return ids


class ByteBPE:
    """The library's encoding of whole texts, each distinct chunk encoded once.

    A chunk is the text between two single spaces that have other characters than white space on both sides, with the
    space before it; no token of the byte-level pattern crosses such a place. Texts with other white space beside a
    space, or with a special token, are encoded whole.
    """

    #: A word after a space whose text is encoded whole, and one whose text is, unless it ends there.
    WHOLE, ENDS = re.compile(r"^$|^\s|<\|"), re.compile(r"\s$")
    #: Marks that are a piece of their own after letters, and how many of them are looked up.
    MARKS, MOST = ".,;:!?#$%&*()|-", 4

    def __init__(self, path: str):
        # a task has a core; the library's own threads would only wait for each other there
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        #: ids of the chunk of a word after a space; None where a text is encoded whole, unless the word is its last
        self.known, self.before = Words(self._after_space), {}
        #: ids of a word that starts a text or a line, of marks, and of words that only a text's end may have
        self.bare, self.tails, self.last = Words(self._first), Words(self._whole), {}
        self.model, self.line = self.tok.model, pack_whole(self.tok, "\n")
        self.letters = dict(enumerate(byte_alphabet()))

    @property
    def heads(self) -> dict[str, bytes | None]:
        """Letters after a space are words like others."""
        return self.known

    def _whole(self, text: str) -> bytes:
        return pack_whole(self.tok, text)

    def _letters(self, space: str, head: str) -> bytes:
        piece = head if head.isascii() else head.encode().decode("latin-1").translate(self.letters)
        got = [t.id for t in self.model.tokenize(space + piece)]
        return struct.pack(f"<{len(got)}I", *got)

    def _parts(self, word: str, known: Words) -> bytes | None:
        """The ids of letters and the marks after them, once or, around a line's end, twice; None for other words.

        Letters and marks are pieces of their own, so each is looked up once for many words.
        """
        head = word.rstrip(self.MARKS)
        if head.isalpha():
            return known[head] + self.tails[word[len(head) :]] if len(word) - len(head) <= self.MOST else None
        above, line, below = word.partition("\n")
        if line:
            a, b = above.rstrip(self.MARKS), below.rstrip(self.MARKS)
            if a.isalpha() and b.isalpha() and len(above) - len(a) <= self.MOST and len(below) - len(b) <= self.MOST:
                return known[above] + self.line + self.bare[below]
        return None

    def _first(self, word: str) -> bytes:
        if word.isalpha():
            return self._letters("", word)
        ids = self._parts(word, self.bare)
        return self._whole(word) if ids is None else ids

    def _after_space(self, word: str) -> bytes | None:
        ids = self.before.get(word)
        if ids is not None:
            return ids
        if word.isalpha():
            return self._letters("\u0120", word)
        ids = self._parts(word, self.known)
        if ids is not None:
            return ids
        if self.WHOLE.search(word):
            return None
        ids = self._whole(" " + word)
        if self.ENDS.search(word):
            self.last[word] = ids
            return None
        return ids

    def _forget(self) -> None:
        """Of what is known, only the words met lately are kept."""
        if len(self.known) > CACHE_CHUNKS:
            self.known, self.before = Words(self._after_space), self.known
            self.tails.clear()
            self.last = {}
        if len(self.bare) > CACHE_CHUNKS:
            self.bare.clear()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for i, t in enumerate(texts):
            if i % 64 == 0:
                self._forget()
            first, *ws = t.split(" ")
            if not ws or not first or self.WHOLE.search(first) or self.ENDS.search(first):
                yield pack_whole(self.tok, t) if t else b""
                continue
            known = self.known.__getitem__
            try:
                if known(ws[-1]) is None and ws[-1] in self.last:
                    yield self.bare[first] + b"".join(map(known, ws[:-1])) + self.last[ws[-1]]
                else:
                    yield self.bare[first] + b"".join(map(known, ws))
            except TypeError:  # a word that joins with what stands beside it
                yield pack_whole(self.tok, t)


def pack_whole(tok: Tokenizer, text: str) -> bytes:
    return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def write(df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all texts, end_id after each, in ascending doc_id order; returns the manifest of the files.

    The range partitions of doc_id become files, in order. Null ids come first; rows of one doc_id stand beside each
    other, ordered by a hash of the text. Null texts count as empty and hold only end_id. An empty table writes no file.
    Returns part, path, n_ids, start (ids in all files before).
    """
    small_batches(df.sparkSession)
    folder = shared_dir(df.sparkSession, "token-files")
    end = int(end_id).to_bytes(4, "little")
    ordered = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, out = tokenizer(path), None
        keep("token-files", tokenizer.cache_clear)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                out = out or Writer(folder)
                for d, ids in zip(b.column(0).to_pylist(), tok.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                    out.add(d, ids + end)
        if out:
            name, n = out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [name], "n_ids": [n]})

    manifest = written(ordered.mapInArrow(run, "part int, path string, n_ids bigint"), "token-manifest")
    # one row for each file, so one task is enough
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids array<bigint>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * ids
        for path, base in rows_of(batches, "path", "start"):
            rows: list[tuple] = []
            for d, first, x in read_file(path):
                rows.append((d, base + first, len(x), zlib.crc32(x.astype("<u4").tobytes()), *[x.astype(np.int64)] * ids))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spread(written(manifest, "token-starts")).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids)
