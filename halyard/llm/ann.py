"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled to the largest norm and get one more coordinate that makes them unit vectors, so the largest inner
product is the smallest distance. A table has HASHES functions floor((a.x + b) / WIDTH) with Gaussian a, and its buckets
are the cells they make. A query visits cells in the order of the estimated chance that a neighbour at the usual
distance lies there, until these chances add up to MASS; candidates of all tables are merged and ranked by the exact
product. Queries that find fewer than k, or whose k-th is farther than the distance they were probed for, ask again
with a larger one, at last in all cells. Cells are packed into blocks of bounded size, large cells are split; a block meets its queries in a cogroup.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import written

TABLES, HASHES, WIDTH = 2, 4, 1.2
#: Cells beyond +-EDGE are one; a function has 2 * EDGE values.
EDGE = 3
#: Estimated chance, per table, that a neighbour lies in a visited cell.
MASS = 0.8
BLOCK_ROWS = 32_768
#: Queries that meet a block at a time; with more, each block meets them in as many groups.
ASK_ROWS = 50_000
#: No two unit vectors are farther apart; queries of this distance visit all cells.
FARTHEST = 2.0
#: Rows of the sample that the usual distance of the k-th neighbour is estimated from.
SAMPLE = 2000
SEED = 11


def _erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26; good to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    y = 1 - t * np.exp(-x * x) * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * y


class Tables:
    def __init__(self, dim: int, tables: int = TABLES, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.standard_normal((tables, dim + 1, HASHES))
        self.b = rng.uniform(0, WIDTH, (tables, HASHES))
        self.place = (2 * EDGE) ** np.arange(HASHES)
        self.cells = np.array(list(itertools.product(range(2 * EDGE), repeat=HASHES)))

    def cell(self, t: int, x: np.ndarray) -> np.ndarray:
        k = np.clip(np.floor((x @ self.a[t] + self.b[t]) / WIDTH), -EDGE, EDGE - 1) + EDGE
        return (k @ self.place).astype(np.int64) + t * len(self.cells)

    def probes(self, t: int, q: np.ndarray, distance: np.ndarray, mass: float = MASS) -> list[np.ndarray]:
        """For each query the cells to visit, the likeliest first."""
        v = q @ self.a[t] + self.b[t]
        edge = np.r_[-np.inf, np.arange(1 - EDGE, EDGE) * WIDTH, np.inf]
        p = 0.5 * np.diff(_erf((edge[None, None, :] - v[:, :, None]) / (distance[:, None, None] * 2**0.5)), axis=2)
        out = []
        for row in p:
            chance = np.prod([row[h][self.cells[:, h]] for h in range(HASHES)], axis=0)
            order = np.argsort(-chance, kind="stable")
            n = int(np.searchsorted(np.cumsum(chance[order]), mass)) + 1
            out.append((self.cells[order[:n]] @ self.place).astype(np.int64) + t * len(self.cells))
        return out


def _rows(col: pa.Array, dim: int) -> np.ndarray:
    return np.array(col.to_pylist(), dtype=np.float64).reshape(len(col), dim)


def unit(x: np.ndarray, top: float) -> np.ndarray:
    """The vectors over the largest norm, with the coordinate that makes them unit vectors."""
    y = x / top
    return np.c_[y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))]


def directed(q: np.ndarray) -> np.ndarray:
    return np.c_[q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))]


def search(df: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", mass: float = MASS) -> DataFrame:
    """The k nearest of df's vectors for each row of queries, its own vec_id excepted: query_id, rank, vec_id, score.

    Both tables have vec_id and vector columns; others are ignored. Vectors that are null or zero, have null, NaN or
    infinite components, or another length than most, take no part. Equal vectors are searched once and come back as all
    their ids, ties to smaller ones; fewer than k only if there are no more; rows that repeat an id and vector count once. Ids that stand for several vectors
    count as several. Scores are double-precision products of the original vectors. Empty tables give no rows.
    """
    good = lambda d: d.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"))
    base = good(df)
    out = "query_id bigint, rank int, vec_id bigint, score double"
    dims = base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("top")).orderBy(F.desc("n"), "dim").first()
    if dims is None:
        return df.sparkSession.createDataFrame([], out)
    dim, n, top = dims["dim"], dims["n"], dims["top"]
    # equal vectors: only the k + 1 smallest ids can be among a query's k nearest
    members = base.where(F.size("v") == dim).withColumn("key", F.sha2(F.transform("v", lambda x: x + F.lit(0.0)).cast("string").cast("binary"), 256))
    few = members.withColumn("n", F.dense_rank().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = written(few.groupBy("key").agg(F.min("id").alias("rep"), F.array_sort(F.collect_set("id")).alias("ids"), F.first("v").alias("v")), "ann-classes")
    tables, asked = Tables(dim), written(good(queries).where(F.size("v") == dim).dropDuplicates(["id"]), "ann-queries")
    distance = _distance(classes, asked, top, k)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(_rows(b.column("v"), dim), top)
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("v"), pa.array(tables.cell(t, x))], names=["rep", "v", "cell"])

    placed = written(classes.select("rep", "v").mapInArrow(cells, "rep bigint, v array<double>, cell bigint"), "ann-cells")
    # at most TABLES x (2 EDGE)^HASHES rows
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    home: dict[int, range] = {}
    block, room = 0, BLOCK_ROWS
    for key in sorted(counts):
        split = -(-counts[key] // BLOCK_ROWS)
        if split > 1 or counts[key] > room:
            block, room = block + 1, BLOCK_ROWS
        home[key] = range(block, block + split)
        block, room = (block + split - 1, 0) if split > 1 else (block, room - counts[key])

    groups = max(1, -(-asked.count() // ASK_ROWS))

    def housed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [home[c] for c in b.column("cell").to_pylist()]
            where = [h[r % len(h)] for h, r in zip(at, b.column("rep").to_pylist(), strict=True)]
            for g in range(groups):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(where) * groups + g, pa.int64()), b.column("rep"), b.column("v"), b.column("cell")], names=["block", "rep", "v", "cell"])

    everywhere = sorted({h for c, at in home.items() if c < len(tables.cells) for h in at})

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                q, ids, rows = directed(_rows(b.column("v"), dim)), b.column("id").to_pylist(), []
                far = b.column("d").to_numpy()
                for t in range(TABLES):
                    for i, seen in enumerate(tables.probes(t, q, far, mass)):
                        if far[i] >= FARTHEST:
                            continue
                        visits: dict[int, list[int]] = {}
                        for c in seen.tolist():
                            for h in home.get(c, ()):
                                visits.setdefault(h, []).append(c)
                        rows += [(h * groups + ids[i] * 2654435761 // 65536 % groups, ids[i], b.column("v")[i].as_py(), cs) for h, cs in visits.items()]
                # no cells: all of the first table
                rows += [(h * groups + ids[i] * 2654435761 // 65536 % groups, ids[i], b.column("v")[i].as_py(), []) for i in np.flatnonzero(far >= FARTHEST).tolist() for h in everywhere]
                if rows:
                    h, i, v, cs = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(i, pa.int64()), pa.array(v, pa.list_(pa.float64())), pa.array(cs, pa.list_(pa.int64()))], names=["block", "query_id", "q", "cells"])

    most = k + 1

    def meet(data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(data) or not len(asks):
            return none
        x, rep, cell = np.stack(data["v"].to_numpy()), data["rep"].to_numpy(), data["cell"].to_numpy()
        parts = []
        for at in range(0, len(asks), 512):
            some = asks.iloc[at : at + 512]
            q = np.stack(some["q"].to_numpy())
            s = q @ x.T
            for i, seen in enumerate(some["cells"]):
                s[i, ~np.isin(cell, seen) if len(seen) else cell >= len(tables.cells)] = -np.inf
            m = min(TABLES * most, s.shape[1])  # a block may hold a vector once for each table
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            r, c = np.repeat(np.arange(len(q)), m), best.ravel()
            ok = s[r, c] > -np.inf
            r, c = r[ok], c[ok]
            got = pd.DataFrame({"query_id": some["query_id"].to_numpy()[r], "rep": rep[c], "score": np.einsum("ij,ij->i", q[r], x[c])})
            got = got.drop_duplicates(["query_id", "rep"]).sort_values(["query_id", "score", "rep"], ascending=[True, False, True])
            parts.append(got[got.groupby("query_id").cumcount() < most])
        return pd.concat(parts)

    blocks = placed.mapInArrow(housed, "block bigint, rep bigint, v array<double>, cell bigint").groupBy("block")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")

    def asking(asks: DataFrame, before: DataFrame | None) -> DataFrame:
        met = asks.mapInArrow(probing, "block bigint, query_id bigint, q array<double>, cells array<bigint>").groupBy("block")
        near = blocks.cogroup(met).applyInPandas(meet, "query_id bigint, rep bigint, score double")
        near = near if before is None else near.unionByName(before.select("query_id", "rep", "score"))
        near = near.groupBy("query_id", "rep").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).drop("n")
        return written(near.join(classes.select("rep", "ids"), "rep"), "ann-found")

    # the query's own id may be one of those found, so k + 1 of them are sure to hold k others
    so_far = best.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asks, found = asked.withColumn("d", F.lit(distance)), None
    while True:
        found = asking(asks, found)
        kth = found.withColumn("n", F.sum(F.size("ids")).over(so_far)).where(F.col("n") > k).groupBy("query_id").agg(F.max("score").alias("kth"))
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        away = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("kth") / (size * top)))
        wider = asks.where(F.col("d") < FARTHEST).join(kth, F.col("id") == F.col("query_id"), "left").withColumn("away", F.when(F.col("kth").isNull(), 2 * F.col("d")).otherwise(away))
        asks = written(wider.where("away > d").select("id", "v", F.col("away").alias("d")), "ann-wider")
        if asks.isEmpty():
            break
    each = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _distance(classes: DataFrame, asked: DataFrame, top: float, k: int) -> float:
    """The usual distance of the k-th neighbour, over-estimated from a sample of SAMPLE vectors and 100 queries."""
    x = [r["v"] for r in classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").collect()]
    q = [r["v"] for r in asked.orderBy(F.xxhash64("id")).limit(100).select("v").collect()]
    if not x or not q:
        return 1.0
    s = directed(np.array(q)) @ unit(np.array(x), top).T
    kth = -np.sort(-s, axis=1)[:, min(k, s.shape[1] - 1)]
    return float(np.sqrt(np.maximum(0.01, 2 - 2 * np.median(kth))))
