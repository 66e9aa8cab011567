"""Substring dedup by recompression.

Words get 64-bit names. A round names maximal runs of one symbol, then splits the symbols by a bit of their names and
names each pair (left, right) anew. A name depends on content alone, so all tasks give equal substrings equal symbols
without asking each other, except for a few symbols at either end, which depend on what stands beside. With each symbol
goes the span of words that decides it. A window's interior symbols are those whose span lies inside it; the smallest
name, hashed with the words of its span, among those of the highest level that has any is its anchor, so equal windows have equal anchors everywhere.

Anchors that only one document holds need no more work. Windows beside each other with one anchor form a stretch; a digest
of its words verifies that stretches of one anchor are equal, and the first document of each digest decides. Where an
anchor has unequal stretches, the windows of each distinct one are looked up one by one, by digests of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import bitmap, in_bitmap, mix64, small_batches, tidy, word_hashes, written

WINDOW = 13
ROUNDS = 1
#: Words that a task parses at a time; a longer text is cut, with an overlap of a window less a word.
STEP = 1 << 15
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class Symbols:
    """One level: names, the words [s, e) they stand for, the words [lo, hi) that decide them, and whether a text starts."""

    name: np.ndarray
    s: np.ndarray
    e: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    new: np.ndarray


def name_runs(x: Symbols) -> Symbols:
    """Maximal runs become symbols; every symbol now depends on both neighbours, which end its run."""
    head = np.ones(len(x.name), bool)
    head[1:] = (x.name[1:] != x.name[:-1]) | x.new[1:]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(head)))
    last = at + size - 1
    name = np.where(size > 1, mix64(x.name[at] ^ mix64(size.astype(np.uint64))), x.name[at])
    s, e, new = x.s[at], x.e[last], x.new[at]
    end = np.append(new[1:], True)
    lo = np.where(new, np.minimum(x.lo[at], s - 1), x.lo[at - 1])
    hi = np.where(end, np.maximum(x.hi[last], e + 1), x.hi[np.minimum(last + 1, len(head) - 1)])
    return Symbols(name, s, e, lo, hi, new)


def name_pairs(x: Symbols) -> Symbols:
    """A left symbol and the right symbol after it become one; lone symbols depend on the neighbour they could join."""
    n = len(x.name)
    right = mix64(x.name ^ _B) & np.uint64(1) == 1
    end = np.append(x.new[1:], True)
    joins = ~right & ~end & np.append(right[1:], False)
    kept = np.ones(n, bool)
    kept[1:] = ~joins[:-1]
    after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    name = np.where(joins, mix64(x.name * _B + mix64(x.name[after])), x.name)
    e = np.where(joins, x.e[after], x.e)
    lo = np.where(right, np.where(x.new, np.minimum(x.lo, x.s - 1), x.lo[before]), x.lo)
    hi = np.where(joins, x.hi[after], np.where(right, x.hi, np.where(end, np.maximum(x.hi, x.e + 1), x.hi[after])))
    return Symbols(name[kept], x.s[kept], e[kept], lo[kept], hi[kept], x.new[kept])


def levels(words: np.ndarray, new: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    at = np.arange(len(words))
    out = [Symbols(words, at, at + 1, at, at + 1, new)]
    for _ in range(rounds):
        out.append(name_pairs(name_runs(out[-1])))
    return out


@dataclass
class Stretches:
    """Runs of windows with one anchor: its name, first and last window start."""

    name: np.ndarray
    first: np.ndarray
    last: np.ndarray


def stretches(words: np.ndarray, sizes: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> Stretches:
    """words: names of the words of texts of these sizes, one after another."""
    n = len(words)
    ends = np.cumsum(sizes)
    new = np.zeros(n, bool)
    new[(ends - sizes)[sizes > 0]] = True
    start = np.flatnonzero(np.repeat(ends, sizes) - np.arange(n) >= window)
    none = np.zeros(0, np.int64)
    if not len(start):
        return Stretches(none.astype(np.uint64), none, none)
    power = np.cumprod(np.full(n + 1, _B, np.uint64)) * _B_INVERSE
    back = np.cumprod(np.full(n + 1, _B_INVERSE, np.uint64)) * _B
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(words * power[:n], out=prefix[1:])

    def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((prefix[b] - prefix[a]) * back[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    best, who = np.zeros(len(start), np.uint64), np.full(len(start), -1)
    open_ = np.arange(len(start))
    all_levels = levels(words, new, rounds)
    for level in range(rounds, -1, -1):
        x = all_levels[level]
        key = mix64(x.name ^ hashed(np.maximum(x.lo, 0), np.minimum(x.hi, n)))
        below_lo = np.cumsum(np.bincount(np.maximum(x.lo, -1) + 1, minlength=n + 2))  # symbols with lo < i, at i
        up_to_hi = np.cumsum(np.bincount(np.minimum(x.hi, n + 1), minlength=n + 2))  # symbols with hi <= i, at i
        i = start[open_]
        a, b = below_lo[i], up_to_hi[i + window]
        have = b > a
        open_have, a, b = open_[have], a[have], b[have]
        if len(a):
            low, at = key[a].copy(), a.copy()
            for k in range(1, int((b - a).max())):
                more = np.flatnonzero(a + k < b)
                less = more[key[a[more] + k] < low[more]]
                low[less], at[less] = key[a[less] + k], a[less] + k
            best[open_have], who[open_have] = low, at * (rounds + 1) + level
        open_ = open_[~have]
        if not len(open_):
            break
    head = np.ones(len(start), bool)
    head[1:] = (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(head)
    first, last = start[at], start[np.append(at[1:], len(start)) - 1]
    return Stretches(best[at], first, last)


def _parts(batch: pa.RecordBatch, text: str, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words before the part in its row, sizes, words) of a batch, STEP words or so at a time."""
    for at in range(0, batch.num_rows, 256):
        words, sizes = word_hashes(batch.slice(at, 256).column(text))
        ends = np.cumsum(sizes)
        row = 0
        while row < len(sizes):
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] - sizes[row] + STEP, "right")))
            a, b = int(ends[row] - sizes[row]), int(ends[stop - 1])
            if stop == row + 1 and b - a > STEP:
                for c in range(0, b - a, STEP):
                    d = min(b - a, c + STEP + window - 1)
                    yield np.array([at + row]), np.array([c]), np.array([d - c]), words[a + c : a + d]
                    if d == b - a:
                        break
            else:
                yield np.arange(at + row, at + stop), np.zeros(stop - row, np.int64), sizes[row:stop], words[a:b]
            row = stop


def _digest(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Windows whose word sequence also starts in a document of smaller id: doc, key, spans.

    doc: doc_id, or the largest long for null, so that null ids come last and are no source for each other; key: a hash of
    the text, which with doc names the row; spans: first << 32 | last window start, in words, of repeated stretches.
    Null and empty texts and texts shorter than a window have none. Rows that repeat an id are no source for each other.
    """
    source = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.col(text).alias("text"))
    spark = df.sparkSession

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column("doc").to_numpy()
            names, of = [], []
            for rows, _, sizes, words in _parts(b, "text", window):
                x = stretches(words, sizes, window)
                names.append(x.name.view(np.int64))
                of.append(docs[rows[np.searchsorted(np.cumsum(sizes), x.first, "right")]])
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(of))], names=["name", "doc"])

    found = source.mapInArrow(tidy(anchors), "name bigint, doc bigint").groupBy("name").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
    often = spark.sparkContext.broadcast(bitmap(written(found.where("a < b").select("name"), "substring-anchors"), "name"))

    def located(batches: Iterator[pa.RecordBatch], bits: Broadcast) -> Iterator[tuple[pa.RecordBatch, Stretches, int, int, int, list[bytes]]]:
        """(batch, stretches, one that the bitmap lets through, its row, place of its first word in the text, its words)"""
        for b in batches:
            texts, row, ws = b.column("text"), -1, []
            for rows, before, sizes, words in _parts(b, "text", window):
                x = stretches(words, sizes, window)
                some = np.flatnonzero(in_bitmap(bits.value, x.name))
                part = np.searchsorted(np.cumsum(sizes), x.first[some], "right")
                first = x.first[some] + before[part] - (np.cumsum(sizes) - sizes)[part]
                more = x.last[some] - x.first[some] + window
                for i, r, f, m in zip(some.tolist(), rows[part].tolist(), first.tolist(), more.tolist(), strict=True):
                    if r != row:
                        row, ws = r, texts[r].as_py().encode().split()
                    yield b, x, i, r, f, ws[f : f + m]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        docs = keys = batch = None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["name", "check", "doc", "key", "span"])

        for b, x, i, r, f, ws in located(batches, often):
            if b is not batch:
                batch, docs, keys = b, b.column("doc").to_numpy(), b.column("key").to_numpy()
            out.append((int(x.name[i].view(np.int64)), _digest(ws), int(docs[r]), int(keys[r]), f << 32 | (f + len(ws) - window)))
            if len(out) == 20_000:
                yield made()
                out.clear()
        if out:
            yield made()

    held = written(source.withColumn("key", F.xxhash64("text")).mapInArrow(tidy(places), "name bigint, check bigint, doc bigint, key bigint, span bigint"), "substring-stretches")
    # stretches of one name and equal words; names with several are compared window by window
    equal = written(held.groupBy("name", "check").agg(F.min("doc").alias("first"), F.max("doc").alias("last")), "substring-equal")
    several = equal.groupBy("name").agg(F.count("*").alias("n"), F.min("first").alias("a"), F.max("last").alias("b")).where("n > 1 and a < b").select("name")
    mixed = spark.sparkContext.broadcast(bitmap(written(several, "substring-mixed"), "name"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        out: list[tuple] = []
        batch = docs = None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["name", "check", "k", "doc", "window"])

        for b, x, i, r, _, ws in located(batches, mixed):
            if b is not batch:
                batch, docs = b, b.column("doc").to_numpy()
            name, check, doc = int(x.name[i].view(np.int64)), _digest(ws), int(docs[r])
            if met.get(check, doc + 1) <= doc:
                continue
            if len(met) > 1 << 17:  # only spares the shuffle some rows
                met.clear()
            met[check] = doc
            for k in range(len(ws) - window + 1):
                out.append((name, check, k, doc, _digest(ws[k : k + window])))
            if len(out) >= 20_000:
                yield made()
                out.clear()
        if out:
            yield made()

    # equal windows have equal names; of a stretch whose words come first here, windows may still stand in other stretches
    single = source.mapInArrow(tidy(windows), "name bigint, check bigint, k int, doc bigint, window bigint")
    single = single.withColumn("first", F.min("doc").over(Window.partitionBy("name", "window"))).where("first < doc")
    known = single.groupBy("name", "check", F.col("doc").alias("first")).agg(F.array_sort(F.collect_set("k")).alias("ks"))
    decided = equal.join(known, ["name", "check", "first"], "left").where("first < last or ks is not null")
    start = "shiftright(span, 32) + k"
    spans = F.expr(f"case when first < doc then array(span) else transform(ks, k -> shiftleft({start}, 32) + {start}) end")
    hits = held.join(decided.drop("last"), ["name", "check"]).where("first < doc or ks is not null")
    return hits.select("doc", "key", spans.alias("spans")).groupBy("doc", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), whole: bool = True) -> DataFrame:
    """Removes every word that a repeated window covers; one row per input row.

    Returns keep..., n_words, n_removed, kept_sha256 and, if `whole`, kept: the words left, joined by one space, or the
    text as it is where nothing is removed (kept_sha256 is of the joined words always). Null texts have no words and stay
    null; texts of which all is removed are empty. See repeats() for null and repeated ids.
    """
    small_batches(df.sparkSession)
    spans = written(repeats(df, doc_id, text, window).withColumnsRenamed({"doc": "_d", "key": "_k", "spans": "_spans"}), "substring-spans")
    hit = df.sparkSession.sparkContext.broadcast(bitmap(spans, "_k"))
    names = list(dict.fromkeys([*keep, text]))
    rows = df.select(*names, F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("_doc"), F.xxhash64(text).alias("_key"))

    def pick(batches: Iterator[pa.RecordBatch], hits: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_bitmap(hit.value, b.column("_key").to_numpy()) == hits))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, 256):
                b = all_rows.slice(at, 256)
                n_words, n_removed, sha, kept = [], [], [], []
                found = b.column("_spans").to_pylist() if "_spans" in b.schema.names else [None] * b.num_rows
                for t, spans in zip(b.column(text).to_pylist(), found, strict=True):
                    ws = (t or "").encode().split()
                    gone = np.zeros(len(ws) + 1, np.int64)
                    if spans:
                        s = np.array(spans)
                        np.add.at(gone, s >> 32, 1)
                        np.add.at(gone, np.minimum((s & 0xFFFFFFFF) + window, len(ws)), -1)
                    left = np.cumsum(gone)[: len(ws)] == 0
                    out = b" ".join([w for w, k in zip(ws, left.tolist(), strict=True) if k] if spans else ws)
                    n_words.append(len(ws))
                    n_removed.append(len(ws) - int(left.sum()))
                    sha.append(hashlib.sha256(out).hexdigest())
                    kept.append(t if not n_removed[-1] else out.decode())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), *[pa.array(kept, pa.string())] * whole], names=[*keep, "n_words", "n_removed", "kept_sha256", *["kept"] * whole])

    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], "n_words bigint, n_removed bigint, kept_sha256 string", *["kept string"] * whole])
    # texts without repeats, as the bitmap says, stay where they are; the others meet their spans in a shuffle, even if those are few:
    # a stage with two Python functions takes two workers a task, all of which stay and are used in turn by what runs next
    near = rows.mapInArrow(tidy(lambda batches: cut(pick(batches, False))), schema)
    far = rows.mapInArrow(tidy(lambda batches: pick(batches, True)), rows.schema).join(spans.hint("merge"), F.expr("_doc = _d and _key = _k"), "left")
    return near.unionByName(far.select(*names, "_spans").mapInArrow(tidy(cut), schema))
