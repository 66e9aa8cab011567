"""Token counts from a digest cache: only distinct texts that it doesn't hold are encoded, and their counts are appended.

The cache is a Parquet folder of version (of the tokenizer), digest (SHA-256 of a normalised text) and n_tokens, in folders
by version. A version is a digest of the tokenizer's file, its library's version and the way it is called, so another
tokenizer, or another library that might count otherwise, never meets counts of this one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.metadata import version as library_version

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from halyard.llm.common import bitmap, in_bitmap, written
from halyard.llm.token_files import tokenizer

CACHE = "digest binary, n_tokens bigint, version string"
#: Digests of repeated texts that a task remembers to have sent on, before it forgets them all.
REMEMBERED = 500_000


def _library(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def tokenizer_version(path: str) -> str:
    """Names what counts depend on: the file, the library and how it is called."""
    with open(path, "rb") as f:
        file = hashlib.file_digest(f, "sha256").hexdigest()
    name = _library(path)
    return "v" + hashlib.sha256(f"{name} {library_version(name)} {file} no-special whole".encode()).hexdigest()[:32]


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens of whole texts as the file's library does, without begin, end or added special tokens."""
    if _library(path) == "sentencepiece":
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    fast = tokenizer(path)
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cut = made["pre_tokenizer"] or {}
    by_bytes = made["normalizer"] is None and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
    if by_bytes and all("<|" in t["content"] for t in made["added_tokens"]):
        return lambda texts: [len(x) // 4 for x in fast.encode(texts)]
    return lambda texts: [len(x.ids) for x in fast.tok.encode_batch_fast(texts, add_special_tokens=False)]


def as_written(text: Column) -> Column:
    """The normal form that keeps every tokenizer's counts: null is empty, all else stays."""
    return F.coalesce(text, F.lit(""))


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of one version, each digest once; no row where nothing was written yet.

    Two jobs that append at once, or one that is run again, may write a digest twice: counts depend on nothing but digest
    and version, so one of the rows serves.
    """
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _head(digest: Column) -> Column:
    """The first 64 bits of a digest as a long."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def _encode_misses(texts: DataFrame, missing: np.ndarray, repeated: np.ndarray, path: str) -> DataFrame:
    """digest, n_tokens of the texts (digest, text) whose digests are in `missing`, each digest encoded about once.

    A text whose digest is not in `repeated` is the only one, and is encoded where it is read. The others meet by digest
    first, without their copies in the same task. A bitmap that says yes too often costs time, never a count.
    """
    bits = texts.sparkSession.sparkContext.broadcast((missing, repeated))
    kind = "digest binary, n_tokens bigint, text string"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, (wanted, many), sent = counter(path), bits.value, set()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                head = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                miss, several = in_bitmap(wanted, head), in_bitmap(many, head)
                alone = pa.array(miss & ~several)
                ids, texts = b.column(0).filter(alone), b.column(1).filter(alone).to_pylist()
                if len(ids):
                    yield pa.RecordBatch.from_arrays([ids, pa.array(count(texts), pa.int64()), pa.nulls(len(ids), pa.string())], names=["digest", "n_tokens", "text"])
                later = np.flatnonzero(miss & several)
                new = []
                for i, d in zip(later.tolist(), b.column(0).take(pa.array(later)).to_pylist(), strict=True):
                    if d not in sent:
                        sent.add(d)
                        new.append(i)
                if len(sent) > REMEMBERED:
                    sent.clear()
                if new:
                    pick = pa.array(new)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pick), pa.nulls(len(new), pa.int64()), b.column(1).take(pick)], names=["digest", "n_tokens", "text"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                n = b.column(1).to_pylist()
                todo = [i for i, x in enumerate(n) if x is None]
                for i, x in zip(todo, count(b.column(2).take(pa.array(todo, pa.int64())).to_pylist()) if todo else [], strict=True):
                    n[i] = x
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    # the number of partitions is given, so that few bytes of texts that are dear to encode don't end in few tasks
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = texts.mapInArrow(first, kind).repartition(parts, "digest").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"), F.max("text").alias("text"))
    return met.mapInArrow(rest, "digest binary, n_tokens bigint")


def counts(df: DataFrame, path: str, cache: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = as_written) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row; new counts are appended to `cache`.

    Null texts count as empty. Repeated rows and ids, and null ids, each give their row; equal texts are encoded once. An
    empty table gives no row and appends none. The text is encoded whole, whatever its length. normalise maps texts of one
    count to one text; what it changes must not change a count. n_bytes is of the text as given.
    """
    spark = df.sparkSession
    given = F.col(text).cast("string")
    content = normalise(given)
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    version = tokenizer_version(path)
    keys = written(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(as_written(given)).cast("long").alias("n_bytes"), digest.alias("digest")), "count-keys")
    known = read_cache(spark, cache, version)
    seen = keys.groupBy("digest").agg(F.count("*").alias("n"))
    misses = written(seen.join(known, "digest", "left_anti").withColumn("head", _head(F.col("digest"))), "count-misses")
    if not misses.isEmpty():
        missing, repeated = bitmap(misses, "head"), bitmap(misses.where("n > 1"), "head")
        texts = df.select(digest.alias("digest"), content.alias("text")).withColumn("head", _head(F.col("digest"))).select("digest", "text", "head")
        new = _encode_misses(texts, missing, repeated, path).join(misses.select("digest"), "digest", "left_semi")
        new.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    found = keys.join(read_cache(spark, cache, version), "digest", "left")
    lost = F.raise_error(F.lit("the cache lost a count while it was read"))
    n = F.coalesce("n_tokens", lost.cast("long"))
    return found.select("doc_id", "n_bytes", n.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
