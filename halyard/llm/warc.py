"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record.

Reader and writer follow the public WARC 1.1 format and its Zstandard profile. A record that fails a check comes back
with its `error`, so one bad frame neither stops a job nor hides.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import shared_dir, written
from halyard.llm.files import create, reopen, rows_of, spread

SKIPPABLE = 0x184D2A5D
DICTIONARY = b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: An archive is closed at so many bytes of payload; a dictionary is trained on its first records.
ARCHIVE_BYTES = 64 << 20
TRAIN_BYTES, DICT_BYTES = 1 << 20, 16 << 10
DATE = "2024-01-01T00:00:00Z"
READ = 1 << 18


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; with refers_to it is a revisit, whose block has the HTTP header only."""
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """Writes records to one archive; the first are held back until the dictionary is trained on them."""

    def __init__(self, folder: str):
        self.path, self.out = create(folder, ".warc.zst")
        self.held: list[bytes] = []
        self.packer: zstd.ZstdCompressor | None = None
        self.size = self.records = 0

    def _start(self) -> None:
        words = None
        try:
            words = zstd.train_dictionary(DICT_BYTES, self.held)
        except zstd.ZstdError:  # too few records, or too short ones: the profile lets an archive have no dictionary
            pass
        if words is not None and words.as_bytes()[:4] == DICTIONARY:
            raw = words.as_bytes()
            self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        else:
            words = None
        self.packer = zstd.ZstdCompressor(level=3, dict_data=words, write_checksum=True, write_content_size=True)
        for r in self.held:
            self.out.write(self.packer.compress(r))
        self.held = []

    def add(self, raw: bytes) -> None:
        self.size += len(raw)
        self.records += 1
        if self.packer:
            self.out.write(self.packer.compress(raw))
        else:
            self.held.append(raw)
            if self.size >= TRAIN_BYTES:
                self._start()

    def close(self) -> tuple[str, int]:
        if not self.packer:
            self._start()
        self.out.close()
        return self.path, self.records


def frames(f: pa.NativeFile) -> Iterator[tuple[int, bytes | Exception]]:
    """(offset, decoded frame) for each frame; a frame that can't be decoded ends the archive with its error."""
    words, at, rest = None, 0, f.read(8)
    if len(rest) == 8 and struct.unpack("<I", rest[:4])[0] == SKIPPABLE:
        n = struct.unpack("<I", rest[4:])[0]
        raw = f.read(n)
        if len(raw) < n:
            yield 0, ValueError("the dictionary is cut short")
            return
        raw = raw if raw[:4] == DICTIONARY else zstd.ZstdDecompressor().decompressobj().decompress(raw)
        words, at, rest = zstd.ZstdCompressionDict(raw), 8 + n, b""
    unpack = zstd.ZstdDecompressor(dict_data=words)
    while True:
        rest = rest or f.read(READ)
        if not rest:
            return
        one, out, used = unpack.decompressobj(), [], 0
        try:
            while not one.eof:
                if not rest:
                    raise ValueError("the last frame is cut short")
                out.append(one.decompress(rest))
                used += len(rest)
                rest = b"" if one.eof else f.read(READ)
        except (zstd.ZstdError, ValueError) as e:
            yield at, e
            return
        rest = one.unused_data
        yield at, b"".join(out)
        at += used - len(rest)


def parse(raw: bytes) -> dict:
    """The fields of one record after checks of version, headers, lengths and digest; ValueError says what is wrong."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise ValueError("no WARC header")
    head: dict[str, str] = {}
    for line in raw[:end].decode().split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError(f"header line without colon: {line[:80]}")
        head[k.strip().lower()] = v.strip()
    if lost := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in head]:
        raise ValueError(f"header lacks {', '.join(lost)}")
    if not head["content-length"].isdigit() or len(raw) != end + 4 + int(head["content-length"]) + 4 or raw[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length is not the block's length")
    http, _, payload = raw[end + 4 : -4].partition(b"\r\n\r\n")
    length = next((int(v) for k, v in (x.split(b":", 1) for x in http.split(b"\r\n")[1:]) if k.lower() == b"content-length"), len(payload))
    algo, _, digest = head.get("warc-payload-digest", "").partition(":")
    sha1 = base64.b32decode(digest).hex() if algo == "sha1" else None
    if head["warc-type"] == "response" and (length != len(payload) or sha1 not in (None, hashlib.sha1(payload).hexdigest())):
        raise ValueError("the payload has another length or digest than its headers say")
    if head["warc-type"] == "revisit" and (payload or "warc-refers-to" not in head):
        raise ValueError("a revisit has a payload or refers to nothing")
    return {"record_type": head["warc-type"], "record_id": head["warc-record-id"], "uri": head.get("warc-target-uri"), "refers_to_id": head.get("warc-refers-to"), "payload_bytes": length, "payload_digest": sha1, "payload": payload if head["warc-type"] == "response" else None}


def write(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each row and returns the manifest: path, records.

    Of rows whose payloads (UTF-8; null counts as empty) have REVISIT_BYTES or more and are equal, those with the largest
    page_id are responses and the rest revisits of it; null ids count as smallest. All other rows are responses. Rows go
    to archives by digest; a payload that many rows share is split by Spark's skew join. An empty table writes no archive.
    """
    folder = shared_dir(df.sparkSession, "warc")
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn("long", F.octet_length("payload") >= REVISIT_BYTES).withColumn("digest", F.when(F.col("long"), F.sha1("payload")))
    first = rows.where("long").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = rows.join(first, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for row in rows_of(batches, "page_id", "url", "payload", "refers_to"):
            out = out or Archive(folder)
            out.add(record(*row))
            if out.size >= ARCHIVE_BYTES:
                done.append(out.close())
                out = None
        done += [out.close()] if out else []
        yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "records": [n for _, n in done]}, pa.schema({"path": pa.string(), "records": pa.int64()}))

    return written(joined.mapInArrow(run, "path string, records bigint"), "warc-manifest")


def read(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the archives that the manifest's `path` lists.

    Returns path, offset, record_type, record_id, uri, refers_to_id, payload_bytes, payload_digest, payload (if asked
    for) and error; of a record that fails a check only path, offset and error are set. An archive that holds another number
    of records than the manifest's `records` says gives one more row with an error. An archive is read as a stream.
    """
    names = ["path", "offset", "record_type", "record_id", "uri", "refers_to_id", "payload_bytes", "payload_digest", *["payload"] * payload, "error"]
    kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema({n: kinds.get(n, pa.string()) for n in names})

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, records in rows_of(batches, "path", "records"):
            rows: list[dict] = []
            size = n = 0
            with reopen(path) as f:
                for at, raw in frames(f):
                    try:
                        if isinstance(raw, Exception):
                            raise ValueError(str(raw))
                        row = parse(raw)
                    except ValueError as e:
                        row = {"error": str(e)}
                    rows.append({**row, "path": path, "offset": at})
                    n += 1
                    size += len(row.get("payload") or b"") * payload
                    if len(rows) == 1000 or size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
            if n != records:
                rows.append({"path": path, "error": f"{n} records where the manifest has {records}"})
            if rows:
                yield batch(rows)

    return spread(manifest.select("path", "records")).mapInArrow(run, ", ".join(f"`{n}` {'bigint' if n in ('offset', 'payload_bytes') else 'binary' if n == 'payload' else 'string'}" for n in names))


def page_id(record_id: str) -> Column:
    """The page_id in a record id, null where it has none."""
    return F.expr(f"try_cast(nullif(regexp_extract({record_id}, '^<urn:page:(.*)>$', 1), '') as bigint)")
