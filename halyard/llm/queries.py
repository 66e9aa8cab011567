"""The thin queries of the dealt operators, with production parameters on whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import ann, bpe, jaccard, media, mixing, negatives, periodic, quality, substring, token_counts, token_files, toxicity, warc
from halyard.llm.common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(_table(spark, sf_dir, "pages")), payload=False)
    sound = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("bad WARC record: "), "error")))
    return records.select(warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), warc.page_id("refers_to_id").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
             max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM d"""


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), tokens=False)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_table(spark, sf_dir, "documents"), whole=False)


OP8_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(len(ws) - 12)) AS i, ws FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, list_slice(ws, i + 1, i + 13) AS win FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM r, range(13) t(k)),
marks AS (SELECT doc_id, list(pos) AS ats FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ats), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ats IS NULL THEN array_to_string(ws, ' ')
                   ELSE array_to_string(list_filter(ws, lambda x, k: NOT list_contains(ats, k - 1)), ' ') END) AS kept_sha256
FROM w LEFT JOIN marks USING (doc_id)"""


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read(*media.store(_table(spark, sf_dir, "documents")), media.features, media.FEATURES)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("form").cast("long").alias("media_bytes"), F.sha2("form", 256).alias("media_sha256"), "feature")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read(manifest, ids=False)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "token-count-cache"), limit=1024)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3, window=(50, 95))


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


def repeat_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words that op13 is to look at: of a tenth of the documents, the words from a place on repeat with a period."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    unit = words[a : a + 1 + (len(words) - a) // (3 + g % 8)]
    tail = len(words) - a
    return words[:a] + (unit * -(-tail // len(unit)))[:tail]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs(_table(spark, sf_dir, "documents"), prepare=repeat_tail, whole=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_mix, op3_toxicity, op4_bpe, op5_jaccard, op6_quality, op7_ann, op8_substring, op9_media, op10_token_files, op11_token_counts, op12_hard_negatives, op13_periodic_runs)
}
ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op8_substring": OP8_SQL, "op12_hard_negatives": OP12_SQL}
