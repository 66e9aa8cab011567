"""Helpers that several operators share: shared storage, Bloom bitmaps, word hashes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these bytes.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base and not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or 'file:///tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hash_below(share: float) -> Column:
    """The bound below which so large a share, less than 1, of all 64-bit hashes lies; it never rounds to nothing."""
    return F.lit(-(1 << 63) + max(1, int((1 << 64) * share)))


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; this cuts its lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of few bytes, unless the session sets another bound.

    Spark's own bound is a number of rows, which a whole partition of texts stays below: its executor and its worker would
    each hold all of its texts twice while a batch grows.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: What a worker keeps between tasks of one operator: name, and how to drop it.
_kept: dict[str, Callable[[], None]] = {}


def keep(name: str, drop: Callable[[], None]) -> None:
    """A worker keeps something of this operator; it is dropped when a task of another one starts there."""
    _kept[name] = drop


def drop_others(name: str) -> None:
    """Drops what operators other than this one keep in the worker."""
    others = [k for k in _kept if k != name]
    for k in others:
        _kept.pop(k)()
    if others:
        release()


def release() -> None:
    """Gives memory that is free back to the system. A Python worker lives on between tasks, and executors count what it holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over a task's batches, after which the task's memory is given back. name: whose things may stay in the worker."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(name)
        yield from run(batches)
        release()

    return whole


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    return off, np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)


def _pieces(off: np.ndarray, data: np.ndarray, size: int = 1 << 18):
    """Byte ranges of about `size` that end where a text or, in a longer text, a word ends."""
    a, n = int(off[0]), len(off) - 1
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        a, b = int(off[i]), int(off[j])
        while b - a > 2 * size:  # one very long text
            gap = np.flatnonzero(_SPACE[data[a + size : b]])
            if not len(gap):
                break
            yield a, a + size + int(gap[0]) + 1, off[i:j]
            a += size + int(gap[0]) + 1
        yield a, b, off[i:j]
        i = j


def word_hashes(col: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and how many each text has."""
    off, data = text_buffer(col)
    table, hashes, at = _BYTE_LOWER if lower else _BYTE, [], []
    for a, b, firsts in _pieces(off, data):
        if a == b:
            continue
        buf = data[a:b]
        word = ~_SPACE[buf]
        before = np.empty(len(buf) + 1, bool)
        before[0], before[1:] = False, word
        cut = firsts[(firsts > a) & (firsts < b)] - a
        before[cut] = False
        start = np.flatnonzero(word & ~before[:-1])
        if not len(start):
            continue
        inside = np.flatnonzero(word)
        first = np.searchsorted(inside, start)
        size = np.diff(np.append(first, len(inside)))
        place = np.arange(len(inside)) - np.repeat(first, size)
        power = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
        h = np.add.reduceat(table[buf[inside]] * power[place], first)
        hashes.append(mix64(h + size.astype(np.uint64)))
        at.append(start + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    at = np.concatenate(at)
    return np.concatenate(hashes), np.diff(np.searchsorted(at, off)).astype(np.int64)


def word_count(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{WORD_GAP}|{WORD_GAP}$", "")
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_GAP))).cast("long")


#: 2^27 bits: 16 MB at most go to the driver and to each executor, whatever the input's size.
BITMAP_BITS = 27


def bitmap(df: DataFrame, col: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A one-hash Bloom filter of a long column of hashes, as a bit array of fixed size.

    A fuller bitmap lets more rows through; it never loses one.
    """
    pos = F.expr(f"shiftrightunsigned({col}, {64 - bits})")
    rows = df.select(pos.alias("pos")).groupBy(F.bitmap_bucket_number("pos").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("m"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for b, m in rows.where("b > 0").toLocalIterator():  # bucket 0 holds position 0 only, which in_bitmap lets through
        out[(b - 1) * 4096 : (b - 1) * 4096 + len(m)] |= np.frombuffer(m, np.uint8)
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter; position p > 0 is bit p - 1."""
    width = int(len(bits) * 8).bit_length() - 1
    pos = (h.view(np.uint64) >> np.uint64(64 - width)).astype(np.int64)
    flat = np.maximum(pos - 1, 0)
    return (pos == 0) | ((bits[flat >> 3] >> (flat & 7).astype(np.uint8)) & 1 == 1)
