"""Mixing sources to target weights with fixed-length blocks of words.

Each source's words, documents one after another, are cut into blocks. Every output shard draws a multinomial count per
source; the draws of a source, numbered through all shards, map through a pseudorandom permutation of its block indices,
and blocks meet their draws in a join on (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import WORD_GAP, mix64, word_count, written

BLOCK = 64
#: Blocks that one output shard holds.
SHARD = 4096
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
SEED = 20240601
#: Words of a source that one group of the prefix sum holds.
BUCKET = 1 << 18


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words to take from each source: share x all sizes by weight, at most `most` x its size, the excess reshared.

    Sources by code point, null last, get the weights in turn. Sources with nothing to take get 0.
    """
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in set(full)]
    return {s: float(out[s]) for s in order}


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index through a keyed bijection of range(n): a four-round Feistel network, walked until it is inside again."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, left = index.astype(np.uint64), np.arange(len(index))
    size = n.astype(np.uint64)
    while len(left):
        x, h, m, k = out[left], half[left], low[left], key[left].astype(np.uint64)
        a, b = x >> h, x & m
        for r in range(4):
            a, b = b, a ^ (mix64(b ^ mix64(k + np.uint64(r))) & m)
        out[left] = (a << h) | b
        left = left[out[left] >= size[left]]
    return out.astype(np.int64)


def _key(doc_id: str, text: str, source: str) -> Column:
    """Tells rows apart up to whole repetition."""
    return F.xxhash64(F.coalesce(F.col(source), F.lit("")), F.col(source).isNull(), F.coalesce(F.col(text), F.lit("")), F.col(doc_id).isNull(), F.col(doc_id).cast("long"))


def plan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, key, source, sid, size, source_size, target, at; their fragments in drawn blocks: sid, at, block, first, n, uses).

    at: words before the row in its source; with sid it names a row that has words. first, n: the row's words in the block.
    The prefix sum takes two steps, so that a source of any size is dealt to many tasks: rows fall into buckets by a hash
    of their id, one window sums within a bucket and another over the bucket totals of a source.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _key(doc_id, text, source).alias("key"))
    rows = written(rows, "mix-sizes")
    # one row for each source: mixing weights are a list as long as a configuration
    sizes = {r["source"]: r["words"] for r in rows.groupBy("source").agg(F.sum("size").alias("words")).toLocalIterator()}
    target = targets(sizes)
    names = list(target)
    whole = [int(target[s] // sizes[s]) if sizes[s] else 0 for s in names]
    n_blocks = [-(-sizes[s] // block) for s in names]
    # full passes over a source, then the draws of its last pass: together its quota
    last = [min(n, round((target[s] - w * sizes[s]) / block)) for s, w, n in zip(names, whole, n_blocks, strict=True)]
    quota = [w * n + x for w, n, x in zip(whole, n_blocks, last, strict=True)]
    # from Arrow, as rows of Python objects would start a second set of Python workers in every executor
    columns = {"sid": pa.int32(), "s": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "n_buckets": pa.int64()}
    table = spark.createDataFrame(pa.Table.from_pylist([dict(zip(columns, (i, s, sizes[s], float(target[s]), max(1, -(-sizes[s] // BUCKET))), strict=True)) for i, s in enumerate(names)], pa.schema(columns)))

    placed = rows.join(F.broadcast(table), F.expr("source <=> s")).drop("s").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("n_buckets")))
    inner = Window.partitionBy("sid", "bucket").orderBy("doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    outer = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(outer), F.lit(0))).drop("n")
    placed = placed.join(before, ["sid", "bucket"]).withColumn("at", F.col("before") + F.col("inner"))
    docs = written(placed.select("doc_id", "key", "source", "sid", "size", "source_size", "target", "at"), "mix-places")

    fragments = docs.where("size > 0").select("sid", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    fragments = fragments.withColumn("first", F.greatest(F.col("block") * block, F.col("at")) - F.col("at")).withColumn("n", F.least((F.col("block") + 1) * block, F.col("at") + F.col("size")) - F.col("at") - F.col("first")).drop("size")
    uses = slots(spark, quota, n_blocks, seed).groupBy("sid", "block").agg(F.count("*").alias("uses"))
    return docs, fragments.join(uses, ["sid", "block"])


def slots(spark, quota: list[int], n_blocks: list[int], seed: int = SEED) -> DataFrame:
    """The mix: one row for each slot of each shard: shard, sid, draw, block.

    A shard's counts per source are multinomial with the quotas as weights. Draws beyond a source's quota are void, and
    what a source still lacks after the last shard follows in closing shards, so that each quota is met exactly.
    """
    total, k = sum(quota), len(quota)
    if not total:
        return spark.createDataFrame([], "shard bigint, sid int, draw bigint, block bigint")
    p = np.array(quota, float) / total
    shards = -(-total // SHARD)
    sizes = np.array(n_blocks, np.int64)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["id"].tolist():
                n = np.random.Generator(np.random.Philox(key=[seed, s])).multinomial(min(SHARD, total - s * SHARD), p)
                some = np.flatnonzero(n)
                yield pd.DataFrame({"shard": s, "sid": some.astype(np.int32), "n": n[some]})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = sizes[b["sid"]]
            turn, at = np.divmod(b["draw"].to_numpy(), n)
            key = mix64(np.uint64(seed) + b["sid"].to_numpy().astype(np.uint64) * np.uint64(1 << 20) + turn.astype(np.uint64))
            yield b.assign(block=permuted(at, n, key))

    counts = spark.range(0, shards).mapInPandas(draw, "shard bigint, sid int, n bigint")
    counts = written(counts, "mix-counts")
    order = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("from", F.coalesce(F.sum("n").over(order), F.lit(0)))
    want = F.broadcast(spark.createDataFrame(pa.table({"sid": pa.array(range(len(quota)), pa.int32()), "quota": pa.array(quota, pa.int64())})))
    drawn = counts.join(want, "sid").withColumn("to", F.least(F.col("from") + F.col("n"), F.col("quota"))).select("shard", "sid", "from", "to")
    have = counts.groupBy("sid").agg(F.sum("n").alias("have"))
    rest = want.join(have, "sid", "left").withColumn("from", F.coalesce("have", F.lit(0))).where(F.col("from") < F.col("quota"))
    # closing shards of at most SHARD slots for each source
    rest = rest.select("sid", "quota", F.explode(F.sequence(F.col("from"), F.col("quota") - 1, F.lit(SHARD))).alias("from")).select((F.lit(shards) + F.floor(F.col("from") / SHARD)).alias("shard"), "sid", "from", F.least(F.col("from") + SHARD, F.col("quota")).alias("to"))
    every = drawn.where("from < to").unionByName(rest).select("shard", "sid", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("draw"))
    return every.mapInPandas(index, "shard bigint, sid int, draw bigint, block bigint")


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What the mix takes from every row: doc_id, source, size, source_size, target, taken; one row per input row.

    size is the number of words, 0 for null and empty texts, of which nothing is taken. A null source is a source, last
    in order. Rows of one id are ordered by a hash of the text. Other columns are ignored. An empty table gives no rows.
    Every block is used at most MOST times, so no row gives more than MOST x its size; a source's taken words differ
    from its target by less than a block and a half. The result depends on the rows and the seed only.
    """
    docs, fragments = plan(df, doc_id, text, source)
    taken = fragments.groupBy(F.col("sid").alias("t_sid"), F.col("at").alias("t_at")).agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
    joined = docs.join(taken, F.expr("sid = t_sid and at = t_at and size > 0"), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents with df's columns: for each pass, the words of a row that this pass takes.

    The blocks used at least once make the first copy, those used twice the second. A copy that takes every word keeps
    its text as it is; else its words are joined by one space. Rows without words have no block and give no row.
    """
    docs, fragments = plan(df, doc_id, text, source)
    passes = fragments.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
    copies = passes.groupBy("sid", "at", "pass").agg(F.sum("n").alias("take"), F.sort_array(F.collect_list(F.struct("first", "n"))).alias("parts"))
    # rows that are alike in id, source and text share their copies; each of them gets the next of the list
    alike = docs.where("size > 0").join(copies, ["sid", "at"]).groupBy(F.coalesce("doc_id", F.lit(-1)).alias("_d"), F.col("key").alias("_k"), "at").agg(F.collect_list(F.struct("take", "parts")).alias("copies"))
    alike = alike.groupBy("_d", "_k").agg(F.sort_array(F.collect_list(F.struct("at", "copies"))).alias("_all"))
    rows = df.withColumns({"_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)), "_key": _key(doc_id, text, source)})
    joined = rows.join(alike, (F.col("_id") == F.col("_d")) & (F.col("_key") == F.col("_k")))
    joined = joined.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_key"))).withColumn("_c", F.explode(F.get("_all", F.col("_n") - 1)["copies"]))
    words = F.split(F.regexp_replace(F.col(text), rf"^{WORD_GAP}|{WORD_GAP}$", ""), WORD_GAP)
    # the outer lambda binds the words, which else would be cut anew for each part
    pick = lambda w: F.array_join(F.flatten(F.transform("_c.parts", lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["n"].cast("int")))), " ")
    cut = F.element_at(F.transform(F.array(words), pick), 1)
    out = joined.withColumn("_t", F.when(F.col("_c.take") == word_count(F.col(text)), F.col(text)).otherwise(cut))
    return out.select(*[F.col("_t").alias(c) if c == text else F.length("_t").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in df.columns])
