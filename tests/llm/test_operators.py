"""The training-data operators against brute force, on small tables with nulls, empty and repeated rows and odd columns."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from halyard.llm import ann, bpe, jaccard, media, mixing, quality, substring, token_files, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n int, label string"


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocab, 60)) for _ in range(6)]
    shared = " ".join(f"p{i}" for i in range(20))
    out = [None, "", "   ", "one", "Two Words", "näïve 😀 café don't  DON'T", *base, *base[:2], base[2].upper()]
    out += [base[3] + " tail", f"{base[4]} {shared} end", f"start {shared} {base[5]}", "x " * 3000, "long" * 5000]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, "7", 1, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_refuses_vocabularies_without_word_ends():
    with pytest.raises(ValueError, match="word"):
        bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe(docs, texts):
    name = "word_bpe_49k.json"
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    for r in bpe.encode(docs, public_tokenizers.path(name), tokens=False).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_takes_kinds_of_characters_from_the_library(spark):
    """Texts of characters that tables of Unicode disagree on, and of any others."""
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    kinds, cases = bpe.odd_points(path)
    rng = np.random.default_rng(8)
    odd, every = [i for i, _ in (*kinds, *cases)], [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rows = []
    for k in range(600):
        pool = odd if k % 2 else every
        rows.append((k, "".join(chr(int(rng.choice(pool))) if rng.random() < 0.5 else "ab'st 7!é "[int(rng.integers(10))] for _ in range(12))))
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, tokens=False).collect()
    want = {k: hashlib.sha256(np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for k, x in rows}
    assert {r.doc_id: r.ids_sha256 for r in got} == want


def test_jaccard(docs, texts):
    sets = []
    for t in texts:
        ws = [bytes(w).lower() if w.isascii() else w for w in words(t)]
        sets.append({tuple(ws[i : i + 3]) for i in range(len(ws) - 2)} if len(ws) >= 3 else ({tuple(ws)} if ws else set()))
    least = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    least[i] = min(least[i], least[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, 3, 90).collect()}
    assert got == {i: (len(s), least[i]) for i, s in enumerate(sets)}


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        ws = t.split()
        sets.append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} or {tuple(ws)})
    least = list(range(len(texts)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(a & b) >= percent * len(a | b)]
    for _ in texts:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return dict(enumerate(least))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_of_many_near_copies(spark, n, percent):
    """Groups above FEW of which some link, some only through others, and most do not."""
    rng = np.random.default_rng(n)
    texts = []
    for group, (size, with_base) in enumerate([(90, True), (70, False), (40, False)]):
        base = [f"g{group}w{k}" for k in rng.integers(0, 400, 90)]
        for i in range(size):
            ws = list(base)
            for _ in range(int(rng.integers(0, 6)) + (not with_base)):
                at = int(rng.integers(0, len(ws)))
                ws[at : at + int(rng.integers(0, 2))] = [f"e{rng.integers(0, 9) if group == 2 else rng.integers(0, 10**6)}"]
            texts.append(" ".join(ws[: len(ws) - int(rng.integers(0, 4))]))
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), n, percent).collect()
    want = brute_components(texts, n, percent)
    assert {r.doc_id: r.component_id for r in got} == want and 3 < len(set(want.values())) < len(texts)


def test_jaccard_of_copies_of_an_absent_template(spark, monkeypatch):
    """Copies that each change four words of their own: hardly a pair is verified, though all share most of their n-grams."""
    seen, apart = [], jaccard._apart

    def counted(*args):
        pairs = apart(*args).cache()
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "_apart", counted)
    for n in (150, 450):
        rng = np.random.default_rng(1)
        texts = []
        for i in range(n):
            ws = [f"t{k}" for k in range(302)]
            for k in rng.choice(302, 4, replace=False):
                ws[k] = f"e{i}x{k}"
            texts.append(" ".join(ws))
        got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90).collect()
        assert {r.doc_id: r.component_id for r in got} == brute_components(texts, 3, 90)
    assert all(k <= n for k, n in zip(seen, (150, 450), strict=True))


def test_jaccard_of_very_long_texts(spark):
    n, common = 380_000, 360_000  # 0.9 exactly
    rows = [(k, " ".join(f"{'c' if i < common else 'ab'[k]}{i}" for i in range(n))) for k in range(2)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90).collect()
    assert {(r.n_shingles, r.component_id) for r in got} == {(n, 0)}


def test_substring(docs, texts):
    first = {}
    for i, t in enumerate(texts):
        ws = words(t)
        for k in range(len(ws) - 12):
            first.setdefault(tuple(ws[k : k + 13]), i)
    for r in substring.dedup(docs, whole=False).collect():
        ws = words(texts[r.doc_id])
        gone = {k + j for k in range(len(ws) - 12) if first[tuple(ws[k : k + 13])] < r.doc_id for j in range(13)}
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(ws), len(gone), hashlib.sha256(kept).hexdigest())


def test_substring_of_shared_and_broken_passages(spark):
    """Passages with other words around, cut short, repeated within a document, runs of one word and whole copies."""
    rng = np.random.default_rng(9)
    passages = [[f"p{k}" for k in rng.integers(0, 60, 40)] for _ in range(5)]
    texts = []
    for i in range(80):
        ws = []
        for _ in range(int(rng.integers(1, 5))):
            p = passages[int(rng.integers(0, 5))]
            a = int(rng.integers(0, 25))
            ws += [f"u{x}" for x in rng.integers(0, 500, int(rng.integers(0, 6)))] + p[a : a + int(rng.integers(5, 40))]
        texts.append(" ".join(ws + ["same"] * int(rng.integers(0, 40)) * (i % 4 == 0)))
    texts += texts[:10]
    first = {}
    for i, t in enumerate(texts):
        ws = words(t)
        for k in range(len(ws) - 12):
            first.setdefault(tuple(ws[k : k + 13]), i)
    got = substring.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6), whole=False).collect()
    assert len(got) == len(texts)
    for r in got:
        ws = words(texts[r.doc_id])
        gone = {k + j for k in range(len(ws) - 12) if first[tuple(ws[k : k + 13])] < r.doc_id for j in range(13)}
        assert (r.n_words, r.n_removed) == (len(ws), len(gone))


def test_mix(docs, texts):
    got = mixing.mix(docs).toPandas().set_index("doc_id")
    again = mixing.mix(docs.repartition(5)).toPandas().set_index("doc_id")
    assert got["taken"].sort_index().equals(again["taken"].sort_index())
    assert got["size"].to_dict() == {i: len(words(t)) for i, t in enumerate(texts)}
    assert (got["taken"] <= 2 * got["size"]).all()
    by = got.assign(source=got["source"].fillna("~")).groupby("source")
    assert ((by["taken"].sum() - by["target"].first()).abs() <= 96).all()


def test_mixed_documents_hold_what_the_mix_takes(docs, texts):
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    found = {}
    for r in mixing.mixed_documents(docs).collect():
        got, whole = words(r.text), words(texts[r.doc_id])
        assert set(got) <= set(whole) and len(got) <= len(whole)
        found[r.doc_id] = found.get(r.doc_id, 0) + len(got)
    assert found == {i: n for i, n in taken.items() if n}


def test_ann(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(300, 16))]
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = ann.search(df, df.where("vec_id % 20 = 0"), k=5).toPandas()
    m = np.array(vectors, np.float32).astype(float)
    hits = 0
    for q in range(0, 300, 20):
        s = m @ m[q]
        s[q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(mine["score"], s[mine["vec_id"]])
        hits += len(set(np.argsort(-s)[:5]) & set(mine["vec_id"]))
    assert hits >= 0.9 * 75 and set(got["query_id"]) == set(range(0, 300, 20))


def test_ann_widens_until_enough_is_found(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([np.repeat(centres, 60, 0) + rng.normal(size=(1200, 16)) * 0.01, rng.normal(size=(40, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    asked = [*range(0, 1200, 60), *range(1200, 1240, 2)]
    got = ann.search(df, df.where(F.col("vec_id").isin(asked)), k=20).toPandas()
    m = x.astype(float)
    near = {q: set(np.argsort(-(m @ m[q]) + np.where(np.arange(len(m)) == q, np.inf, 0))[:20]) for q in asked}
    recall = [len(near[q] & set(got[got.query_id == q]["vec_id"])) / 20 for q in asked]
    assert (got.groupby("query_id").size() == 20).all() and got["query_id"].nunique() == len(asked)
    assert np.mean(recall[:20]) >= 0.9 and np.mean(recall[20:]) >= 0.8
    few = df.where("vec_id >= 1220")
    assert ann.search(few, few, k=20).count() == 20 * 19


def test_ann_repeated_rows_count_once(spark):
    rng = np.random.default_rng(6)
    rows = [(0, [1.0, 2.0, 3.0, 4.0])] * 60 + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1, 5)] + [(i, [float(x) for x in rng.normal(size=4)]) for i in range(5, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id = 0").limit(1), k=4).orderBy("rank").collect()
    assert {1, 2, 3, 4} <= {r.vec_id for r in ann.search(df, df.where("vec_id = 0"), k=20).collect()} and len(got) == 4


def test_warc(spark):
    big = "<p>" + "a" * 1200
    pages = spark.createDataFrame([(1, "u", big, 1), (2, "u", None, 1), (3, None, big, 1), (4, "v", "small", 1), (5, "v", "small", 1)], "page_id long, url string, html string, payload_bytes int")
    got = {int(r.page_id): r for r in warc.read(warc.write(pages), payload=False).select(warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to_id").alias("to"), "error").collect()}
    assert {k: (r.record_type, r.to) for k, r in got.items()} == {1: ("revisit", 3), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None)}
    assert all(r.error is None for r in got.values()) and got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and got[2].payload_bytes == 0


def test_warc_misses_no_record(spark, tmp_path):
    """An archive that is cut between two frames or within one, or that is damaged, is not taken for whole."""
    pages = spark.createDataFrame([(i, "u", f"<p>{i} " + "word " * (200 + i)) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write(pages).coalesce(1)
    row = manifest.first()
    raw = open(row.path.removeprefix("file:"), "rb").read()
    offsets = [r.offset for r in warc.read(manifest, payload=False).orderBy("offset").collect()]
    assert len(offsets) == 20
    flipped = bytearray(raw)
    flipped[(offsets[5] + offsets[6]) // 2] ^= 255
    for name, cut in (("between", raw[: offsets[12]]), ("within", raw[: offsets[12] + 9]), ("flipped", bytes(flipped))):
        (tmp_path / name).write_bytes(cut)
        bad = spark.createDataFrame([(f"file://{tmp_path}/{name}", row.records)], "path string, records long")
        assert warc.read(bad, payload=False).where("error is not null").count() >= 1


def test_samples_never_empty(spark):
    from halyard.llm.common import hash_below

    n = spark.range(20_000).where(F.xxhash64("id") < hash_below(0.1)).count()
    assert 1700 < n < 2300 and spark.range(1).select(hash_below(1e-30) > F.lit(-(1 << 63))).first()[0]


def test_media(docs, texts):
    read = media.read(*media.store(docs), media.features, media.FEATURES).collect()
    assert len(read) == len(texts)
    for r in read:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_token_files(docs, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_files.read(token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2), ids=False).collect()}
    at = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("sf", ["sf0.01", pytest.param("sf0.001", marks=pytest.mark.xfail(reason="known fault: of so few toxic texts it learns too little and finds none of five"))])
def test_toxicity_is_right_on_the_held_out_fold(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]]
    assert got["score"].between(0, 1).all() and (held["predicted"] == held["toxic"]).mean() >= 0.95


def prose(rng, n):
    return ["".join(rng.choice(list("abdefghiklmnoprstuvw"), int(rng.integers(3, 8)))) for _ in range(n)]


def test_toxicity_counts_copies_once(spark):
    rng = np.random.default_rng(4)
    vocab = prose(rng, 400)
    write = lambda *more: " ".join([*rng.choice(vocab, 30), *more])
    rows = [(t, 1) for t in [write("zyxquark")] * 300 + [write("zyxquark") for _ in range(40)]]
    rows += [(t, 0) for t in [write("zyxquark")] * 300 + [write() for _ in range(200)]]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, fold=None)
    assert model is not None
    new = spark.createDataFrame([(0, write("zyxquark")), (1, write())], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(new, model).collect()} == {0: 1, 1: 0}


def test_quality_scores_every_row(docs, texts):
    got = quality.score(docs, quality.fit(docs))
    assert got.count() == len(texts) and got.select("doc_id").distinct().count() == len(texts)


def test_copies_do_not_fill_the_quality_sample(spark, monkeypatch):
    met = []
    monkeypatch.setattr(quality, "MAX_TEXTS", 50)
    monkeypatch.setattr(quality, "train", lambda rows: met.append(len(rows)))
    rows = [(None, "the same boilerplate text of a null id")] * 5000 + [(i, f"text {i} of its own") for i in range(1000)]
    quality.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert met[0] <= 50


def test_empty_tables(spark, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(pages)).count() == 0 and quality.score(empty, quality.fit(empty)).count() == 0
    assert media.read(*media.store(empty), media.features, media.FEATURES).count() == 0
    assert token_files.read(token_files.write(empty, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(vectors, vectors).count() == 0
    for found in (bpe.encode(empty, path, tokens=False), jaccard.near_duplicates(empty), substring.dedup(empty), mixing.mix(empty), mixing.mixed_documents(empty)):
        assert found.count() == 0


def test_repeated_rows_stay(spark, docs):
    twice = docs.where("doc_id in (0, 3, 6)").unionByName(docs.where("doc_id in (0, 3, 6)"))
    assert jaccard.near_duplicates(twice).count() == 6 and substring.dedup(twice).count() == 6 and mixing.mix(twice).count() == 6
    assert jaccard.representatives(twice).select(F.count("*")).first()[0] == 4  # of equal rows one stays; those without words all do


def test_toxicity_training_fits_the_driver():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 13))) for _ in range(21_000)})
    tracemalloc.start()
    try:
        model = toxicity._train([w + "zq" for w in words[:60]], words)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.margins([words[0] + "zq"])[0] > model.margins([words[500]])[0]
    assert peak < 90_000_000  # all landmarks' features at once take 50 MB, and 100 MB in doubles
