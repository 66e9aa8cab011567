"""Token counts, hard negatives and periodic runs against brute force."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from halyard.llm import negatives, periodic, token_counts
from halyard.llm.queries import repeat_tail

TEXTS = "doc_id long, text string, n_tokens string, digest int, version string, n int"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = ["der", "the", "naïve", "😀", "x", "  ", "\n", "don't", "1234", "<|endoftext|>", "Ünï"]
    out = [None, "", " ", "a <|endoftext|> b", "x" * 4000, "long text " * 3000]
    out += [" ".join(rng.choice(vocab) for _ in range(rng.randrange(80))) for _ in range(40)]
    return out + out[10:14] * 3


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i == 7 else i % 50, t, "z", 1, "v", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, TEXTS).repartition(3).cache()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, tmp_path, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        one = lambda x: len(model.encode(x))
    else:
        one = library(path)
    got = token_counts.counts(docs, path, f"file://{tmp_path}/cache", limit=100).collect()
    want = [(r.doc_id, len((r.text or "").encode()), one(r.text or "")) for r in docs.collect()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_bytes, r.n_tokens)) for r in got)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_only_misses_are_encoded_and_appended(spark, docs, texts, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    half = docs.where("doc_id < 25 or doc_id is null")
    token_counts.counts(half, BYTES, cache).count()
    distinct = {t or "" for t in texts}
    before = spark.read.parquet(cache).count()
    assert before == len({r.text or "" for r in half.collect()}) < len(distinct)
    token_counts.counts(docs, BYTES, cache).count()
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len(distinct)
    # a run that has nothing to encode writes nothing and gives the same rows
    files = set(tmp_path.rglob("*.parquet"))
    again = token_counts.counts(docs, BYTES, cache).agg(F.sum("n_tokens")).first()[0]
    one = library(BYTES)
    assert again == sum(one(t or "") for t in texts) and set(tmp_path.rglob("*.parquet")) == files
    # counts of another version are not met
    monkeypatch.setattr(token_counts, "library_version", lambda name: "0")
    assert token_counts.tokenizer_version(BYTES) not in {r.version for r in stored.select("version").distinct().collect()}
    token_counts.counts(docs, BYTES, cache).count()
    assert spark.read.parquet(cache).count() == 2 * len(distinct)


def test_a_repeated_append_changes_no_count(spark, docs, texts, tmp_path):
    cache = f"file://{tmp_path}/cache"
    token_counts.counts(docs, BYTES, cache).count()
    rows = spark.read.parquet(cache).collect()
    spark.createDataFrame(rows).write.mode("append").partitionBy("version").parquet(cache)
    assert token_counts.counts(docs, BYTES, cache).count() == len(texts)


def test_full_bitmaps_cost_time_only(spark, docs, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "bitmap", lambda df, col: np.full((1 << 16) // 8, 255, np.uint8))
    one = library(BYTES)
    got = token_counts.counts(docs, BYTES, f"file://{tmp_path}/cache").agg(F.sum("n_tokens")).first()[0]
    assert got == sum(one(t or "") for t in texts)


VECTORS = "vec_id long, embedding array<double>, label int, score string, block int, i int"


def brute_negatives(rows, every, positives=5, negatives=3, low=50, high=95):
    kept = {}
    for v, x, lab in rows:
        if v is None or lab is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        fixed = (lab, [math.floor(256 * c) for c in x])
        kept[v] = max(kept.get(v, fixed), fixed)
    out = []
    for a, (la, xa) in kept.items():
        if a % every:
            continue
        score = {b: sum(p * q for p, q in zip(xa, xb)) for b, (_, xb) in kept.items() if b != a}  # noqa: B905
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if kept[b][0] == la][:positives]:
            hits = [b for b in order if kept[b][0] != la and low * score[p] <= 100 * score[b] <= high * score[p]]
            out += [(a, p, r, b, score[p], score[b]) for r, b in enumerate(hits[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [(3, 7), (256, 4096)])
def test_hard_negatives(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 20) / 7 + 0.2], int(rng.integers(0, 4))) for i in range(90)]
    rows += [(i, rows[7][1], 2) for i in range(90, 110)]  # equal vectors: ties go by id
    rows += [(200, [1.0] * 35, 1), (201, [], 1), (202, [0.0] * 20, 2), (203, [1.0, None], 1), (204, [float("nan")], 1), (205, [float("inf")], 1)]
    rows += [(206, None, 1), (207, [1.0], None), (None, [1.0], 1), rows[3], rows[3], (5, rows[6][1], 3), (-10, rows[8][1], 0)]
    df = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], VECTORS).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 5 == 0, block=block).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows, 5) and len(got) > 100


def shuffled(spark):
    """Bytes that all stages so far wrote for shuffles."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_hard_negatives_shuffle_no_tiles(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=16)], i % 11, "", 0, 0) for i in range(6000)]
    df = spark.createDataFrame(rows, VECTORS)
    before = shuffled(spark)
    assert negatives.mine(df, F.col("vec_id") % 3 == 0).count() > 10_000
    assert shuffled(spark) - before < 16_000_000  # the scores alone are 96 MB


def test_hard_negatives_in_strips(spark, monkeypatch):
    monkeypatch.setattr(negatives, "STRIP", (4, 9))
    monkeypatch.setattr(negatives, "CHUNK", 3)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8) / 5 + 0.3], int(rng.integers(0, 4))) for i in range(120)]
    df = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], VECTORS).repartition(3)
    assert sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 5 == 0).collect()) == brute_negatives(rows, 5)


def test_hard_negatives_of_large_components(spark):
    rows = [(i, [float((i * 7919 + k * 104729) % 1000003) * 1.5 for k in range(18)], i % 3) for i in range(40)]
    df = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], VECTORS)
    assert sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 4 == 0).collect()) == brute_negatives(rows, 4)  # past 2^53
    with pytest.raises(ValueError, match="64 bits"):
        negatives.mine(df.withColumn("embedding", F.array(F.lit(1e12))), F.col("vec_id") % 4 == 0)
    with pytest.raises(Exception, match="too large"):
        negatives.mine(df.withColumn("embedding", F.array(F.lit(1e300))), F.col("vec_id") % 4 == 0)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    one = spark.createDataFrame([(1, [1.0], 0, "", 0, 0)], VECTORS)
    for df in (none, one, one.withColumn("vec_id", F.lit(10))):  # no row, no anchor, an anchor without a positive
        got = negatives.mine(df, F.col("vec_id") % 5 == 0)
        assert got.count() == 0 and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute_runs(x):
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            size = j - i + q
            w = x[i : i + size]
            if j > i and size >= max(6, 4 * q) and all(w[p:] != w[:-p] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def repetitive(rng, n):
    x = []
    while len(x) < n:
        if rng.random() < 0.5:
            x += [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, 12))]
        else:
            unit = [rng.randrange(rng.choice([2, 3, 30])) for _ in range(rng.randrange(1, rng.choice([4, 9, 40])))]
            x += (unit * 10)[: int(len(unit) * rng.uniform(2, 9))]
    return x[:n]


@pytest.mark.parametrize("size", [64, 128, 8192])
def test_runs_of_words(monkeypatch, size):
    monkeypatch.setattr(periodic, "BLOCK", size)
    rng = random.Random(size)
    for _ in range(60):
        texts = [repetitive(rng, rng.choice([0, 1, 5, 6, 7, 20, 100, 300, 700])) for _ in range(4)]
        assert periodic.find_runs([np.array(t, np.int64) for t in texts]) == [brute_runs(t) for t in texts]


def test_frequent_and_rare_words_count_alike():
    """Lags of a text in which one word is frequent enough for the FFT, against all pairs."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 900, 3000))
    first, counts = periodic.count_lags(x, [(0, 3000, 1, 750), (100, 400, 1, 75)])
    assert [int(c) for c in counts[1:751]] == [int((x[k:] == x[:-k]).sum()) for k in range(1, 751)]
    y = x[100:400]
    assert [int(c) for c in counts[first[1] + 1 :]] == [int((y[k:] == y[:-k]).sum()) for k in range(1, 76)]


def test_runs_across_the_blocks_of_a_long_text():
    rng = np.random.default_rng(2)
    unit, plain = rng.integers(0, 10**6, 5000), rng.integers(0, 10**6, 30000)
    x = np.concatenate([plain[:9000], np.tile(unit, 5)[:21000], plain[9000:12000], [7] * 20000, plain[12000:], plain[:3] * 0])
    got = periodic.find_runs([x])[0]
    assert got == [(9000, 21000, 5000), (33000, 20000, 1)]


def test_runs_of_a_table(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a a a a a a", "a b a b a b a b", "x y z " * 200, "é  é \té  é  é  é ", "w " * 20000]
    texts += [" ".join(map(str, repetitive(rng, 300))) for _ in range(30)]
    texts += texts[10:13]
    rows = [(None if i == 3 else i % 40 * 7, t, "z", 1, "v", 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, TEXTS).repartition(3)
    for prepare in (None, repeat_tail):
        want = []
        for d, t, *_ in rows:
            w = (t or "").encode().split()
            if prepare:
                w = planted(w, d)
            r = brute_runs(w) if len(w) < 5000 else [(0, len(w), 1)]
            best = max(r, key=lambda x: (x[1], -x[0], -x[2]), default=None)
            gone = {i for s, n, q in r for i in range(s + q, s + n)}
            left = b" ".join(x for i, x in enumerate(w) if i not in gone)
            told = "".join(f"{s},{n},{q}\n" for s, n, q in r)
            want.append((d, len(r), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
        got = periodic.runs(df, prepare=prepare).collect()
        assert sorted(map(str, want)) == sorted(str(tuple(r)[:8]) for r in got)
        assert all(r.n_runs == len(r.runs) and r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest() for r in got)
    assert periodic.runs(df.limit(0)).count() == 0


def planted(words, doc_id):
    """The query's change of words, word by word."""
    import zlib

    if doc_id is None or not words or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    n, g = len(words), zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
