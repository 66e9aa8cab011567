"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

An instance is a token: a word in lower case with letters only, or a run of single letters written apart. The kernel of
two tokens is the inner product of their gapped subsequences of three letters that span at most five, each weighted by
DECAY to the power of its span, divided by norms that depend on the tokens' lengths; so `idxiot` or `i-d-i-o-t` stay near
`idiot`. Letters are 31 classes, so the subsequences are 15-bit codes and a sum over landmarks is one table of weights.

A text is as toxic as its most toxic token. Training picks the tokens that carry the labels of toxic sentences:
those whose texts are nearly all toxic and differ from each other, so that words of one toxic text with many copies
don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import hash_below, release, small_batches, tidy

DECAY, SPAN = 0.7, 5
#: (second letter, third letter) offsets of the subsequences.
GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
CODES = 1 << 15
#: Training bounds: labelled texts, candidate tokens, clean tokens, landmarks.
MAX_TEXTS, MAX_CANDIDATES, MAX_CLEAN, LANDMARKS = 20_000, 5_000, 60_000, 384
THRESHOLD = 0.7
#: Labels that are broadcast at most, so that texts stay where they are; more of them meet the texts in a shuffle.
SENT = 1 << 19
CACHE_TOKENS = 300_000
MIN_LETTERS, MAX_LETTERS = 3, 40

_CLASS = bytearray(256)
for _b in range(256):
    c = chr(_b).lower()
    if "a" <= c <= "z":
        _CLASS[_b] = ord(c) - 96
    elif c in "013457":
        _CLASS[_b] = ord("oieast"["013457".index(c)]) - 96
    elif _b >= 128:
        _CLASS[_b] = 27 + _b % 5
_CLASS[ord("@")] = 1
_DROP = bytes(b for b in range(1, 256) if not _CLASS[b] and b != 10)
_CLASS = bytes(_CLASS)
_APART = re.compile(r"(?<![^\W_])[^\W\d_](?:[\s.\-_*]{1,3}[^\W\d_](?![^\W_])){2,}")


def letters(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of all letters, padded apart; start of each token; its length). Long tokens are whole."""
    flat = np.frombuffer("\n".join(tokens).encode("utf-8", "replace").translate(None, _DROP), np.uint8)
    cut = np.append(np.flatnonzero(flat == 10), len(flat))
    size = np.diff(np.append(-1, cut)) - 1
    start = np.cumsum(size + SPAN) - size - SPAN
    out = np.zeros(int((size + SPAN).sum()) + SPAN, np.int32)
    table = np.frombuffer(_CLASS, np.uint8)
    inside = flat != 10
    out[np.flatnonzero(inside) + np.cumsum(~inside)[inside] * (SPAN - 1)] = table[flat[inside]]
    return out, start, size


def norms(size: np.ndarray) -> np.ndarray:
    """The length of a token's feature vector if no subsequence occurs twice."""
    sq = sum(DECAY ** (2 * (b + 1)) * np.maximum(size - b, 0) for _, b in GAPS)
    return np.sqrt(np.maximum(sq, DECAY**6))


def linear(tokens: list[str], weights: np.ndarray) -> np.ndarray:
    """For each token the weights' sum over its subsequences, over its norm. weights: [CODES] or [CODES, m]."""
    c, start, size = letters(tokens)
    total = np.zeros((len(c) - SPAN, *weights.shape[1:]), np.float32)
    n = len(total)
    for a, b in GAPS:
        x, y, z = c[:n], c[a : a + n], c[b : b + n]
        total += weights[(x << 10 | y << 5 | z) * ((x > 0) & (y > 0) & (z > 0))] * np.float32(DECAY ** (b + 1))
    sums = np.add.reduceat(total, start) if len(start) and n else np.zeros((len(start), *weights.shape[1:]), np.float32)
    sums[size < MIN_LETTERS] = 0
    return sums / norms(size).reshape(-1, *[1] * (weights.ndim - 1))


def features(tokens: list[str]) -> np.ndarray:
    """The feature vectors of a few tokens, one column each, over their norms."""
    out = np.zeros((CODES, len(tokens)), np.float32)
    c, start, size = letters(tokens)
    norm = norms(size)
    for k, (s, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
        for a, b in GAPS:
            w = c[s : s + n]
            if n > b:
                np.add.at(out[:, k], w[: n - b] << 10 | w[a : n - b + a] << 5 | w[b:], DECAY ** (b + 1) / norm[k])
    return out


def tokens_of(text: str) -> set[str]:
    """The distinct instances of a text."""
    low = text.lower()
    found = set(low.split())
    found.update("".join(x for x in m if x.isalpha()) for m in _APART.findall(low))
    return found


@dataclass(frozen=True)
class Model:
    """weights: of each subsequence code, all landmarks summed; the score is 1 / (1 + exp(-(slope x margin + offset)))."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    landmarks: tuple[str, ...]

    def margins(self, tokens: list[str]) -> np.ndarray:
        return linear(tokens, self.weights) + self.bias if tokens else np.zeros(0, np.float32)

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


class Scorer:
    """Scores whole texts; margins of tokens are kept, up to a bound, from text to text."""

    def __init__(self, model: Model):
        self.model, self.known, self.before = model, {}, {}

    def margins(self, texts: list[str]) -> list[float]:
        found = [tokens_of(t) for t in texts]
        if len(self.known) > CACHE_TOKENS:
            self.known, self.before = {}, self.known
        new = set().union(*found).difference(self.known)
        old = {t: self.before[t] for t in new if t in self.before}
        self.known.update(old)
        new = list(new.difference(old))
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            self.known.update(zip(some, self.model.margins(some).tolist(), strict=True))
        known = self.known
        return [max([known[t] for t in f], default=self.model.bias) for f in found]


#: Tokens whose features are computed, landmarks that they meet, or rows that enter a Newton step, at a time.
TOKENS, MARKS, ROWS = 500, 48, 4096


def _svm(parts: list[tuple[np.ndarray, float, float]], reg: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; parts: rows, label, cost of each row. The last column is 1 and is not regularised."""
    m = parts[0][0].shape[1]
    w, r = np.zeros(m), np.full(m, reg)
    r[-1] = 1e-8
    for _ in range(rounds):
        a, b = np.diag(r), np.zeros(m)
        for x, y, cost in parts:
            for i in range(0, len(x), ROWS):
                near = x[i : i + ROWS].astype(np.float64)
                near = near[y * (near @ w) < 1]
                a += cost * (near.T @ near)
                b += cost * y * near.sum(0)
        new = np.linalg.solve(a, b)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", fold: int | None = 1) -> Model | None:
    """Trains on distinct labelled texts, of which MAX_TEXTS at most are drawn by a hash of their text, evenly at any size.

    Rows whose crc32(doc_id as text) mod 3 is `fold` are left out. Null labels and texts are left out; of several labels
    of one id the largest counts. Texts of equal tokens count once, toxic if half of their rows are. None if there is no
    toxic or no clean text to learn from.
    """
    small_batches(df.sparkSession)
    known = labels.where(F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("_l")).agg(F.max(toxic).alias("y"))
    if fold is not None:
        known = known.where(F.pmod(F.crc32(F.col("_l").cast("string").cast("binary")), F.lit(3)) != fold)
    n_known = known.count()
    known = F.broadcast(known) if n_known <= SENT else known
    rows = df.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t is not null").join(known, F.col("d") == F.col("_l")).select(F.xxhash64("t").alias("h"), "t", "y")
    n = rows.select("h").distinct().count() if n_known > MAX_TEXTS else 0
    if n > MAX_TEXTS:
        rows = rows.where(F.xxhash64("h") < hash_below(MAX_TEXTS / n))
    rows = rows.groupBy("h").agg(F.first("t").alias("t"), F.sum("y").cast("long").alias("y"), F.count("*").alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                s = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([pa.array([sorted(tokens_of(t)) for t in s.column(0).to_pylist()], pa.list_(pa.string())), s.column(1), s.column(2)], names=["tokens", "y", "n"])

    cuts = rows.select("t", "y", "n").mapInArrow(tidy(cut), "tokens array<string>, y bigint, n bigint").withColumn("d", F.xxhash64("tokens"))
    bags = cuts.groupBy("d").agg(F.first("tokens").alias("tokens"), (2 * F.sum("y") >= F.sum("n")).cast("int").alias("y")).persist()
    try:
        total = {r["y"]: r["n"] for r in bags.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if not total.get(1) or not total.get(0):
            return None
        each = bags.select("d", "y", F.explode("tokens").alias("token")).where(F.length("token") <= MAX_LETTERS)
        seen = each.groupBy("token").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).persist()
        try:
            ratio = (F.col("bad") / total[1]) / ((F.col("good") + 0.5) / total[0])
            top = seen.where("bad > 0").orderBy(F.desc(F.when(F.col("bad") > 1, ratio).otherwise(0)), F.desc("bad"), "token").limit(MAX_CANDIDATES).collect()
            clean = seen.where("good > 0 and bad * 4 < good * 3").orderBy(F.xxhash64("token")).select("token").limit(MAX_CLEAN).toArrow()["token"].to_pylist()
        finally:
            seen.unpersist()
        # at most MAX_CANDIDATES names; of each toxic text their numbers, as Arrow
        words = [r["token"] for r in top]
        # from Arrow, as rows of Python objects would start a second set of Python workers in every executor
        names = bags.sparkSession.createDataFrame(pa.table({"i": pa.array(range(len(words)), pa.int32()), "token": pa.array(words, pa.string())}))
        has = each.where("y = 1").join(F.broadcast(names), "token").groupBy("d").agg(F.collect_list("i").alias("i")).orderBy("d").select("i").toArrow()["i"]
        bad = explain([{words[i] for i in x.values.to_numpy()} for x in has], {r["token"]: r["bad"] / (r["bad"] + r["good"] + 0.3) for r in top})
        if not bad:
            return None
        model = _train(bad, clean)
        scorer = Scorer(model)

        def margin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [max(scorer.model.margins(t).tolist(), default=scorer.model.bias) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64()), b.column(1)], names=["m", "y"])

        got = bags.select("tokens", "y").mapInArrow(tidy(margin), "m double, y int").toArrow()
    finally:
        bags.unpersist()
    release()
    return _calibrated(model, got["m"].to_numpy(), got["y"].to_numpy())


def explain(bags: list[set[str]], odds: dict[str, float], least: float = 0.9, share: float = 0.005, common: float = 0.05, alike: float = 0.6) -> list[str]:
    """Tokens that make texts toxic, those in most texts first.

    bags: the candidate tokens of each toxic text; odds: how often a token's texts are toxic. A token must be toxic in
    `least` of its texts and be in at least three bags and `common` of them, or in three and `share` of those that no
    token before it explains. Its bags must differ: bags that overlap by `alike` on average are copies, of which any word
    would do. So rare words that only happen to stand beside an insult are left out.
    """
    holds: dict[str, list[int]] = {}
    for i, b in enumerate(bags):
        for t in b:
            if odds.get(t, 0) >= least and len(t) >= MIN_LETTERS:
                holds.setdefault(t, []).append(i)
    out: list[str] = []
    explained: set[int] = set()
    for t in sorted(holds, key=lambda t: (-len(holds[t]), t)):
        if len(holds[t]) < max(3, share * len(bags)):
            break
        fresh = [i for i in holds[t] if i not in explained]
        if len(holds[t]) < common * len(bags) and len(fresh) < max(3, share * len(bags)):
            continue
        some = [bags[i] for i in holds[t][:: max(1, len(holds[t]) // 40)]]
        pairs = [len(x & y) / len(x | y) for k, x in enumerate(some) for y in some[k + 1 :]]
        if np.mean(pairs) <= alike:
            out.append(t)
            explained.update(holds[t])
    return out


def _margins(tokens: list[str], weights: np.ndarray) -> np.ndarray:
    """linear, some tokens at a time: what many tokens need besides their sums stays small."""
    return np.concatenate([linear(tokens[i : i + 4 * TOKENS], weights) for i in range(0, len(tokens), 4 * TOKENS)] or [linear(tokens, weights)])


def _kernel(tokens: list[str], marks: list[str]) -> np.ndarray:
    """The kernel of tokens and landmarks, some of each at a time; a landmark's features alone are CODES numbers."""
    out = np.empty((len(tokens), len(marks)), np.float32)
    for k in range(0, len(marks), MARKS):
        phi = features(marks[k : k + MARKS])
        for i in range(0, len(tokens), TOKENS):
            out[i : i + TOKENS, k : k + MARKS] = linear(tokens[i : i + TOKENS], phi)
    return out


def _mapped(tokens: list[str], marks: list[str], white: np.ndarray) -> np.ndarray:
    """The tokens' Nyström features and a 1."""
    out = np.ones((len(tokens), white.shape[1] + 1), np.float32)
    for i in range(0, len(tokens), 4 * TOKENS):
        out[i : i + 4 * TOKENS, :-1] = _kernel(tokens[i : i + 4 * TOKENS], marks) @ white
    return out


def _train(bad: list[str], clean: list[str], rounds: int = 3) -> Model:
    """Each round adds the clean tokens that the model so far finds worst, so that few of a long text's words stand out."""
    first = bad[: LANDMARKS // 2]
    near = np.zeros(CODES, np.float32)
    for k in range(0, len(first), MARKS):
        near = np.maximum(near, features(first[k : k + MARKS]).max(1))
    near = _margins(clean, near)
    hard = [clean[i] for i in np.argsort(-near, kind="stable")[:2000]]
    marks = first + hard[: LANDMARKS - len(first)]
    # toxic tokens also with a letter inserted, doubled or lost, as they are written to get past word lists
    rng = np.random.Generator(np.random.PCG64(7))
    odd = []
    for t in bad:
        for _ in range(8):
            i = int(rng.integers(1, len(t)))
            odd.append(t[:i] + chr(97 + int(rng.integers(26))) + t[i:])
            odd.append(t[:i] + t[i - 1] + t[i:])
    value, vector = np.linalg.eigh(_kernel(marks, marks).astype(float) + 1e-4 * np.eye(len(marks)))
    white = (vector / np.sqrt(np.maximum(value, 1e-4))).astype(np.float32)
    positive, rest = _mapped(bad + odd, marks, white), _mapped(clean[:20_000], marks, white)
    met = list(dict.fromkeys(hard))
    for turn in range(rounds):
        more = _mapped(met, marks, white)
        w = _svm([(positive, 1.0, 0.5 / len(positive)), (more, -1.0, 0.5 / (len(more) + len(rest))), (rest, -1.0, 0.5 / (len(more) + len(rest)))])
        share, table = white @ w[:-1], np.zeros(CODES)
        for k in range(0, len(marks), MARKS):
            table += features(marks[k : k + MARKS]) @ share[k : k + MARKS]
        table = table.astype(np.float32)
        if turn < rounds - 1:
            worst = np.argsort(-_margins(clean, table), kind="stable")[:2000]
            met = list(dict.fromkeys([*met, *(clean[i] for i in worst)]))
    return Model(table, float(w[-1]), 1.0, 0.0, tuple(marks))


def _calibrated(model: Model, margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> Model:
    """Platt's logistic fit of labels on margins."""
    x = np.c_[margin, np.ones(len(margin))]
    goal = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (goal - p) - 1e-6 * w)
        w = w + step * min(1.0, 5 / np.abs(step).max())
    return Model(model.weights, model.bias, float(max(w[0], 1e-3)), float(w[1]), model.landmarks)


def score(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """keep..., score and predicted (score >= threshold) for every row; `keep` columns pass through unchanged.

    Null and empty texts have no token and get the score of a text without toxic words. Texts of any length are scored
    whole. Repeated rows get equal scores. Without a model, as of a corpus without toxic labels, every score is 0.
    """
    names = [*keep, "score", "predicted"]
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], "score double", "predicted int"])
    if model is None:
        return df.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                got = model.score(np.array(scorer.margins([t or "" for t in b.column(text).to_pylist()])))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run), schema)
