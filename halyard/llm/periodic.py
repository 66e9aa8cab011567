"""Runs: stretches of words that repeat with a period, four times or more. Lags are counted first, and few are scanned.

How often a text's words equal those `lag` words on is the sum, over its distinct words, of the autocorrelation of the
places of one word. Of a frequent word this is an FFT, exact after rounding; of a rare one, the differences of its pairs of
places. A run of period q has max(6, 4 q) - q such equal pairs at least, so only lags that have so many are scanned for
islands of equal pairs. Lags up to an eighth of BLOCK are counted in blocks that overlap by half, longer ones in blocks of
twice the size and so on, so that a lag needs its matches within a few periods: a long text of ordinary words has none.
A text of BLOCK words or fewer is one block.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 8192
#: Words whose lags are counted at a time, unless one block is longer.
CHUNK = 1 << 17
#: Words that a task numbers before it begins anew.
VOCABULARY = 1_000_000


def needed(lag: np.ndarray | int) -> np.ndarray:
    """Pairs of equal words that a run of this period has at least."""
    return np.maximum(6 - np.asarray(lag), 3 * np.asarray(lag))


def blocks(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, least lag, largest lag) of the blocks of a text of n words, shorter lags first.

    Any 4 q words of a run of period q lie within a block that counts lag q: q is at most an eighth of the block, and blocks
    begin at every half. The last block is the text.
    """
    size, low = BLOCK, 1
    while size < n:
        for a in range(0, n - size // 2, size // 2):
            yield a, min(n, a + size), low, size // 8
        size, low = size * 2, size // 8 + 1
    if n // 4 >= low:
        yield 0, n, low, n // 4


def _pairs(places: np.ndarray, ends: np.ndarray, most: np.ndarray, base: np.ndarray, counts: np.ndarray) -> None:
    """Adds to counts[base + lag] the pairs of places of one word up to `most` apart. ends: where the word's places end."""
    at, shift = np.arange(len(places)), 1
    while True:
        at = at[at + shift < ends[at]]
        if not len(at):
            return
        d = places[at + shift] - places[at]
        near = d <= most[at]
        at = at[near]
        if len(at) > 4096:
            counts += np.bincount(base[at] + d[near], minlength=len(counts))
        else:
            np.add.at(counts, base[at] + d[near], 1)
        shift += 1


def count_lags(ids: np.ndarray, parts: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(first, counts): of part k, counts[first[k] + lag] is how many words of ids[start:end] equal the one lag words on."""
    sizes = np.array([b - a for a, b, _, _ in parts])
    most = np.array([hi for *_, hi in parts])
    first = np.concatenate([[0], np.cumsum(most + 1)])
    counts = np.zeros(first[-1], np.int64)
    x = np.concatenate([ids[a:b] for a, b, _, _ in parts])
    part = np.repeat(np.arange(len(parts)), sizes)
    order = np.argsort(part * (int(ids.max()) + 1) + x, kind="stable")
    px, xx = part[order], x[order]
    new = np.flatnonzero((np.diff(px) != 0) | (np.diff(xx) != 0)) + 1
    starts, stops = np.concatenate([[0], new]), np.concatenate([new, [len(order)]])
    often = stops - starts
    width = 2 ** np.ceil(np.log2(sizes + most + 1)).astype(np.int64)
    cost = (width * np.log2(width) / 2)[px[starts]]
    heavy = (often >= 64) & (often * often > cost)
    light = np.flatnonzero((often > 1) & ~heavy)
    if len(light):
        n = often[light]
        end = np.cumsum(n)
        rows = np.repeat(starts[light] - (end - n), n) + np.arange(end[-1])
        _pairs(order[rows], np.repeat(end, n), most[px[rows]], first[px[rows]], counts)
    which = px[starts]
    for k in np.unique(which[heavy]).tolist():
        power, zero = 0.0, int(sizes[:k].sum())
        for g in np.flatnonzero(heavy & (which == k)).tolist():
            seen = np.zeros(width[k])
            seen[order[starts[g] : stops[g]] - zero] = 1.0
            f = np.fft.rfft(seen)
            power = power + f.real**2 + f.imag**2
        counts[first[k] : first[k + 1]] += np.rint(np.fft.irfft(power, int(width[k]))[: most[k] + 1]).astype(np.int64)
    return first, counts


def _reach(x: np.ndarray, at: int, lag: int, step: int) -> int:
    """How far equal pairs (i, i + lag) go on from `at`, in steps of 1 or -1."""
    here, size = at, 64
    while True:
        if step > 0:
            eq = x[here : min(here + size, len(x) - lag)] == x[here + lag : min(here + size, len(x) - lag) + lag]
        else:
            low = max(0, here - size + 1)
            eq = (x[low : here + 1] == x[low + lag : here + 1 + lag])[::-1]
        if not len(eq):
            return here
        if not eq.all():
            return here + step * int(np.argmin(eq))
        here, size = here + step * len(eq), size * 2


class _Text:
    """Runs of one text, found block by block; ids are its words' numbers."""

    def __init__(self, ids: np.ndarray):
        self.x, self.found, self.until = ids, {}, {}

    def _explain(self, c: np.ndarray, a: int, b: int, run: tuple[int, int], q: int) -> None:
        """Takes from the counts of a block the pairs within a run, whose lags are multiples of its period.

        No other run of such a lag has one of these pairs: it would share a period of words with this run and so be it.
        """
        inside = min(b, run[1]) - max(a, run[0])
        lags = np.arange(q, min(inside, len(c)), q)
        c[lags] -= inside - lags

    def scan(self, a: int, b: int, low: int, counts: np.ndarray) -> None:
        """Finds the runs of x[a:b] with periods from low on. counts[lag]: equal pairs within it."""
        c = counts.copy()
        for run, q in self.found.items():
            if min(b, run[1]) - max(a, run[0]) > low:
                self._explain(c, a, b, run, q)
        lags = np.arange(len(c))
        for lag in np.flatnonzero((c >= needed(lags)) & (lags >= low)).tolist():
            if c[lag] < needed(lag):
                continue
            at = max(a, self.until.get(lag, a))
            eq = self.x[at : b - lag] == self.x[at + lag : b]
            if not len(eq):
                continue
            odd = np.concatenate([[-1], np.flatnonzero(~eq), [len(eq)]])
            size = np.diff(odd) - 1
            for k in np.flatnonzero(size >= needed(lag)).tolist():
                s, e = at + int(odd[k]) + 1, at + int(odd[k + 1])
                if s == at and s > 0:
                    s = _reach(self.x, s - 1, lag, -1) + 1
                if e == b - lag:
                    e = _reach(self.x, e, lag, 1)
                self.until[lag] = max(self.until.get(lag, 0), e)
                run = (s, e + lag)
                if run not in self.found:
                    self.found[run] = lag
                    self._explain(c, a, b, run, lag)
                elif self.found[run] > lag:
                    self.found[run] = lag


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period. A text is its words' numbers.

    A run whose words have a shorter period too is that period's run, with the same ends; it counts once, with the shortest.
    """
    found = [_Text(t) for t in texts]
    rest: list[tuple[int, int, int, int, int]] = []
    size = 0

    def settle() -> None:
        if not rest:
            return
        whole = np.concatenate([texts[d][a:b] for d, a, b, _, _ in rest])
        ends = np.cumsum([b - a for _, a, b, _, _ in rest])
        first, counts = count_lags(whole, [(int(e) - (b - a), int(e), lo, hi) for e, (_, a, b, lo, hi) in zip(ends, rest, strict=True)])
        lag = np.arange(len(counts)) - np.repeat(first[:-1], np.diff(first))
        low = np.repeat([lo for *_, lo, _ in rest], np.diff(first))
        enough = np.flatnonzero((counts >= needed(lag)) & (lag >= low))
        for k in np.unique(np.searchsorted(first, enough, "right") - 1).tolist():
            d, a, b, lo, _ = rest[k]
            found[d].scan(a, b, lo, counts[first[k] : first[k + 1]])
        rest.clear()

    for d, t in enumerate(texts):
        for a, b, lo, hi in blocks(len(t)) if len(t) >= 6 else ():
            rest.append((d, a, b, lo, hi))
            size += b - a
            if size >= CHUNK:
                settle()
                size = 0
    settle()
    return [sorted((s, e - s, q) for (s, e), q in t.found.items()) for t in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds beyond its first period, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for s, n, q in runs:
            keep[s + q : s + n] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", prepare: Callable[[list[bytes], int | None], list[bytes]] | None = None, whole: bool = True) -> DataFrame:
    """Runs of every text: doc_id, n_runs, those of the longest (start, length, period, exponent_milli), runs_sha256,
    collapsed_sha256 and, if whole, runs array<struct<start, length, period>> and collapsed (string).

    Words are maximal stretches of other than ASCII white space, compared by their bytes. The longest run is the first of
    equals by start, then period; without a run its four columns are null. Null and empty texts have no words. Rows are
    independent: repeated rows and ids, and null ids, each give their row. An empty table gives none. A row's memory grows
    with its text, and no row is moved. prepare changes a row's words first, given its id.
    """
    kind = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    kind += ", runs array<struct<start bigint, length bigint, period bigint>>, collapsed string" * whole
    span = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [span, pa.string()] * whole
    names = [c.split()[0] for c in kind.split(", ")[:8]] + ["runs", "collapsed"] * whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 256):
                b = whole_batch.slice(at, 256)
                if len(number) > VOCABULARY:
                    number.clear()
                docs = b.column(0).to_pylist()
                words = [(t or "").encode().split() for t in b.column(1).to_pylist()]
                if prepare:
                    words = [prepare(w, d) for w, d in zip(words, docs, strict=True)]
                found = find_runs([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words])
                rows = []
                for d, w, r in zip(docs, words, found, strict=True):
                    best = max(r, key=lambda x: (x[1], -x[0], -x[2]), default=None)
                    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                    left = collapsed(w, r)
                    told = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest()
                    more = ([dict(zip(("start", "length", "period"), x, strict=True)) for x in r], left.decode()) if whole else ()
                    rows.append((d, len(r), *longest, told, hashlib.sha256(left).hexdigest(), *more))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, kind)
