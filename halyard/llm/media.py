"""Media columns as content-defined chunks: cut by a rolling gear hash, stored once, put together again.

A payload is cut where the gear hash of its last 32 bytes has AVERAGE_BITS zero bits, between SMALL and LARGE bytes. Its
stored form is the ordered list of chunks: magic, payload length, then digest (SHA-256) and length of each. Chunks that
one place only holds stay, compressed, beside their list; those that several places hold go to a store keyed by digest,
each once, and lists join with it when payloads are read back. Every payload is verified against its chunks' digests.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import bitmap, in_bitmap, written

MAGIC = b"CDCLIST1"
ENTRY, ENTRY_BYTES = "<32sI", 36
SMALL, LARGE, AVERAGE_BITS = 256, 8192, 10
#: The format's unit: payloads are a multiple of it.
UNIT = 64
_GEAR = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Chunks whose digests are counted in a bitmap of 2^24 bits.
BITS = 24


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    """raw and bytes 0 up to a positive multiple of unit."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks."""
    flat = np.frombuffer(raw, np.uint8)
    h = _GEAR[flat]
    for step in (1, 2, 4, 8, 16):  # the sum of gear[b_i-j] << j for j < 32, doubled five times
        h[step:] += h[:-step] << np.uint32(step)
    spots = (np.flatnonzero(h >> np.uint32(32 - AVERAGE_BITS) == 0) + 1).tolist()
    out, last = [], 0
    for s in [*spots, len(raw)]:
        while s - last > LARGE:
            last += LARGE
            out.append(last)
        if s - last >= SMALL or s == len(raw) and s > last:
            out.append(s)
            last = s
    return out


def chunks(raw: bytes) -> list[bytes]:
    ends = cuts(raw)
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def stored_form(size: int, digests: list[bytes], sizes: list[int]) -> bytes:
    return MAGIC + struct.pack("<QI", size, len(digests)) + b"".join(struct.pack(ENTRY, d, n) for d, n in zip(digests, sizes, strict=True))


def _each(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            yield b, [(t or "").encode() for t in b.column(text).to_pylist()]


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def store(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lists, chunk store), both written.

    lists: uid, doc_id, n_bytes, form (the stored form), inline (compressed chunks; null for those in the store).
    Chunk store: digest, data (compressed), one row for each digest that more than one place holds.
    Null and empty texts give one unit of bytes 0. Repeated rows share all their chunks. Empty tables give empty ones.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raws in _each(batches, text):
            found = [_short(hashlib.sha256(c).digest()) for r in raws for c in chunks(pad(r))]
            yield pa.RecordBatch.from_pydict({"digest": pa.array(found, pa.int64())})

    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = source.mapInArrow(names, "digest bigint").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    often = df.sparkSession.sparkContext.broadcast(bitmap(shared, "digest", BITS))

    def fresh(digests: list[bytes]) -> list[bool]:
        return (~in_bitmap(often.value, np.array([_short(d) for d in digests], np.int64))).tolist()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, k, part = zstd.ZstdCompressor(level=3), 0, TaskContext.get().partitionId()
        for b, raws in _each(batches, "text"):
            forms, inline = [], []
            for r in raws:
                payload = pad(r)
                cs = chunks(payload)
                ds = [hashlib.sha256(c).digest() for c in cs]
                forms.append(stored_form(len(payload), ds, list(map(len, cs))))
                inline.append([press.compress(c) if own else None for c, own in zip(cs, fresh(ds), strict=True)])
            uid = [(part << 40) + k + i for i in range(len(raws))]
            k += len(raws)
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), b.column("doc_id"), pa.array(list(map(len, raws)), pa.int64()), pa.array(forms, pa.binary()), pa.array(inline, pa.list_(pa.binary()))], names=["uid", "doc_id", "n_bytes", "form", "inline"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, met = zstd.ZstdCompressor(level=3), set()
        for _, raws in _each(batches, "text"):
            digests, data = [], []
            for r in raws:
                cs = chunks(pad(r))
                ds = [hashlib.sha256(c).digest() for c in cs]
                for c, d, own in zip(cs, ds, fresh(ds), strict=True):
                    if not own and d not in met:
                        digests.append(d)
                        data.append(press.compress(c))
                        met.add(d)
            if len(met) > 200_000:  # only spares the shuffle some rows
                met.clear()
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], names=["digest", "data"])

    kind = df.schema[doc_id].dataType.simpleString()
    recipe = written(source.mapInArrow(lists, f"uid bigint, doc_id {kind}, n_bytes bigint, form binary, inline array<binary>"), "media-lists")
    kept = written(source.mapInArrow(repeated, "digest binary, data binary").groupBy("digest").agg(F.max("data").alias("data")), "media-chunks")
    return recipe, kept


def read(lists: DataFrame, kept: DataFrame, make: Callable[[bytes], dict[str, object]], schema: str) -> DataFrame:
    """doc_id, n_bytes, form and make(payload)'s columns for every list; each chunk is verified, or the task fails."""
    fields = [f.name for f in lists.sparkSession.createDataFrame([], schema).schema]

    def payload(form: bytes, data: list[bytes | None]) -> bytes:
        size, n = struct.unpack_from("<QI", form, len(MAGIC))
        parts = [zstd.ZstdDecompressor().decompress(d) for d in data]
        for i, p in enumerate(parts):
            digest, length = struct.unpack_from(ENTRY, form, len(MAGIC) + 12 + i * ENTRY_BYTES)
            if len(p) != length or hashlib.sha256(p).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
        if len(parts) != n or sum(map(len, parts)) != size:
            raise ValueError("the list of chunks is not whole")
        return b"".join(parts)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                made = []
                more = b.column("more").to_pylist()
                for form, inline, extra in zip(b.column("form").to_pylist(), b.column("inline").to_pylist(), more, strict=True):
                    far = {x["seq"]: x["data"] for x in extra or []}
                    made.append(make(payload(form, [d if d is not None else far[i] for i, d in enumerate(inline)])))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), b.column("form"), *[pa.array([m[f] for m in made]) for f in fields]], names=["doc_id", "n_bytes", "form", *fields])

    out = f"doc_id {lists.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, form binary, {schema}"
    missing = F.exists("inline", lambda c: c.isNull())
    near = lists.where(~missing).select("doc_id", "n_bytes", "form", "inline", F.lit(None).cast("array<struct<seq:int,data:binary>>").alias("more"))
    refs = lists.where(missing).select("uid", "form", F.posexplode("inline").alias("seq", "data")).where("data is null")
    at = F.lit(len(MAGIC) + 13) + F.col("seq") * ENTRY_BYTES
    refs = refs.select("uid", "seq", F.substring("form", at, F.lit(32)).alias("digest"))
    far = refs.join(kept, "digest").groupBy("uid").agg(F.collect_list(F.struct("seq", "data")).alias("more"))
    apart = lists.where(missing).join(far, "uid", "left").select("doc_id", "n_bytes", "form", "inline", "more")
    return near.unionByName(apart).mapInArrow(build, out)


FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string"


def features(payload: bytes) -> dict[str, object]:
    """Length, digest, CRC of the last 64 bytes, and a text of simple statistics of the bytes."""
    flat = np.frombuffer(payload, np.uint8)
    count = np.bincount(flat, minlength=256)
    share = count[count > 0] / len(flat)
    entropy = float(-(share * np.log2(share)).sum())
    return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "feature": f"mean={int(flat.sum(dtype=np.int64)) / len(flat):.4f};entropy={entropy:.4f};distinct={len(share)};peak={int(count.argmax())}"}
