"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Each labeller votes good, bad or nothing. Votes of all documents are counted by pattern in Spark; of 3^9 patterns at
most, EM on the counts finds how often each labeller is right about good and about bad texts, and a posterior for each
pattern. Posteriors are the soft labels of a logistic scorer on hashed word shapes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import hash_below

BAD, GOOD, NONE = 0, 1, 2
FEATURE_BITS = 16
#: The feature for doubled words, after those of shapes.
TWICE = 1 << FEATURE_BITS
#: Training bound of the scorer; votes are counted over all documents.
MAX_TEXTS = 20_000
KEEP = 0.5
CACHE_WORDS = 300_000
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_TAIL = re.compile(r"[^\w\s.,;:?'\"()\-]{2,}(?=\s|$)")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_RUNS = re.compile(r"(.)\1+")
_SHAPE = {**{i: "A" for i in range(65, 91)}, **{i: "a" for i in range(97, 123)}, **{i: "0" for i in range(48, 58)}, **{i: "l" for i in range(128, 0x250)}}


def _vote(value: float, good: bool, bad: bool) -> int:
    return GOOD if good else BAD if bad else NONE


def votes(text: str) -> list[int]:
    """The labellers' votes on a text: symbols, capitals, symbol tails, table bars, word length, sentence ends, repeated lines, length, doubled words."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    symbols, capitals = len(_SYMBOL.findall(text)) / chars, len(_UPPER.findall(text)) / chars
    tails, bars = len(_TAIL.findall(text)) / max(1, n), words.count("|") / max(1, n)
    length = sum(map(len, words)) / max(1, n)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    ends = sum(x[-1] in ".!?\"')" for x in lines) / max(1, len(lines))
    twice = sum(map(eq, words, words[1:])) / max(1, n - 1)
    again = 1 - len(set(lines)) / max(1, len(lines))
    return [
        _vote(symbols, symbols < 0.02, symbols > 0.06),
        _vote(capitals, capitals < 0.15, capitals > 0.4),
        _vote(tails, tails < 0.02, tails > 0.15),
        _vote(bars, bars == 0, bars > 0.05),
        _vote(length, 2.5 <= length <= 12, n == 0 or length > 20),
        _vote(ends, ends >= 0.6, n > 0 and ends < 0.1),
        _vote(again, again < 0.1, again > 0.3),
        _vote(n, n >= 20, n < 3),
        _vote(twice, twice < 0.03, twice > 0.15),
    ]


LABELLERS = 9


@dataclass(frozen=True)
class LabelModel:
    """chance[k, y, v]: of labeller k's vote v on a text of class y; prior: share of good texts."""

    chance: np.ndarray
    prior: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) for each row of votes."""
        part = [np.log(self.chance[np.arange(LABELLERS), y, patterns]).sum(1) for y in (0, 1)]
        return 1 / (1 + np.exp(np.clip(part[0] + np.log(1 - self.prior) - part[1] - np.log(self.prior), -40, 40)))


#: What a labeller is taken to do before votes are seen, with the weight of PRIOR of all texts: rows bad and good, columns the votes.
HABIT, PRIOR = np.array([[0.4, 0.4, 0.2], [0.01, 0.89, 0.1]]), 0.02


def expectation_maximisation(patterns: np.ndarray, count: np.ndarray, rounds: int = 100) -> LabelModel:
    """Dawid and Skene's model with a vote withheld as a third vote.

    It starts from suspicion of every text with a bad vote, and HABIT stands for labellers that err seldom on good texts;
    this fixes the classes' sides and keeps several kinds of bad text in one class.
    """
    good = np.array([0.95, 0.3, 0.05])[np.minimum(2, (patterns == BAD).sum(1))]
    model = None
    for _ in range(rounds):
        weight = np.stack([count * (1 - good), count * good])
        chance = np.stack([[(weight * (patterns[:, k] == v)).sum(1) for v in range(3)] for k in range(LABELLERS)]).transpose(0, 2, 1)
        chance = chance + HABIT * (PRIOR * count.sum() + 1)
        model = LabelModel(chance / chance.sum(2, keepdims=True), float(np.clip(weight[1].sum() / max(1, weight.sum()), 0.01, 0.99)))
        new = model.posterior(patterns)
        if np.abs(new - good).max(initial=0) < 1e-6:
            break
        good = new
    return model


def shapes(words: list[str], known: dict[str, int]) -> dict[int, float]:
    """Share of each hashed word shape (capitals, small letters, digits, other letters, symbols; runs as one), and of words that repeat the one before."""
    for w in set(words).difference(known):
        known[w] = zlib.crc32(_RUNS.sub(r"\1", w.translate(_SHAPE)).encode("utf-8", "replace")) >> (32 - FEATURE_BITS)
    ids = list(map(known.__getitem__, words))
    n = max(1, len(ids))
    out = {k: v / n for k, v in Counter(ids).items()}
    return out | {TWICE: sum(map(eq, words, words[1:])) / n}


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, x: dict[int, float]) -> float:
        z = self.bias + sum(self.weights[k] * v for k, v in x.items())
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def train(rows: list[tuple[list[int], list[float], float]], rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> Scorer:
    """Logistic regression on sparse rows (features, values, soft label) by full-batch Adagrad."""
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    col = np.concatenate([np.array(r[0], np.int64) for r in rows] or [np.zeros(0, np.int64)])
    val = np.concatenate([np.array(r[1], float) for r in rows] or [np.zeros(0)])
    y = np.array([r[2] for r in rows])
    w, b, seen, seen_b = np.zeros(TWICE + 1), 0.0, np.full(TWICE + 1, 1e-8), 1e-8
    for _ in range(rounds if len(rows) else 0):
        z = np.bincount(doc, w[col] * val, len(rows)) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g, gb = np.bincount(col, err[doc] * val, len(w)) / len(rows) + decay * w, err.mean()
        seen, seen_b = seen + g * g, seen_b + gb * gb
        w, b = w - rate * g / np.sqrt(seen), b - 0.2 * gb / np.sqrt(seen_b)
    return Scorer(w.astype(np.float32), float(b))


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[LabelModel, Scorer]:
    """Counts the vote patterns of all texts, runs EM, trains the scorer on about MAX_TEXTS texts at most, drawn by a hash; rows of one id and text count once there."""
    source = df.select(F.col(doc_id).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter(tuple(votes(t)) for t in b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in found], pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())], names=["votes", "n"])

    table = source.mapInArrow(vote, "votes array<int>, n bigint").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    patterns = np.array([r["votes"] for r in table], np.int64).reshape(-1, LABELLERS)
    count = np.array([r["n"] for r in table], float)
    model = expectation_maximisation(patterns, count)
    share = MAX_TEXTS / max(1.0, count.sum())
    key = F.xxhash64("d", "t")
    sample = source if share >= 1 else source.where(key < hash_below(share))
    # a hash takes all copies of a row or none: they count once, so that no row's copies fill the sample
    sample = sample.groupBy(key.alias("key")).agg(F.first("t").alias("t"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            texts = b.column("t").to_pylist()
            x = [shapes(t.split(), known) for t in texts]
            p = model.posterior(np.array([votes(t) for t in texts], np.int64).reshape(-1, LABELLERS))
            yield pa.RecordBatch.from_arrays([pa.array([list(f) for f in x], pa.list_(pa.int64())), pa.array([list(f.values()) for f in x], pa.list_(pa.float64())), pa.array(p)], names=["k", "v", "p"])

    rows = [(r["k"], r["v"], r["p"]) for r in sample.mapInArrow(featured, "k array<bigint>, v array<double>, p double").orderBy("p", "k", "v").toLocalIterator()]
    return model, train(rows)


def score(df: DataFrame, fitted: tuple[LabelModel, Scorer], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., posterior (of the labellers), score (of the scorer) and keep (score >= KEEP) for every row.

    Null texts count as empty. Texts are whole at any length; repeated rows get equal values; an empty table gives no rows.
    """
    model, scorer = fitted
    names = [*keep, "posterior", "score", "keep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                if len(known) > CACHE_WORDS:
                    known.clear()
                texts = [t or "" for t in b.column(text).to_pylist()]
                p = model.posterior(np.array([votes(t) for t in texts], np.int64).reshape(-1, LABELLERS))
                s = np.array([scorer.score(shapes(t.split(), known)) for t in texts])
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(p), pa.array(s), pa.array(s >= KEEP)], names=names)

    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], "posterior double, score double, keep boolean"])
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
