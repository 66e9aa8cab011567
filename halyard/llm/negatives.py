"""Hard negatives by a two-dimensional block matrix product: rows in blocks, dimensions in chunks, scores in int64 tiles.

Scores of anchors and rows are a product of two matrices. Rows of both are cut into blocks; a grid place (anchor block, row
block) gets its row and its column of the grid, as in SUMMA, and adds the products of their chunks of dimensions itself, strip
by strip. What a strip keeps of an anchor is a few rows, so that no tile is ever stored or shuffled.

Blocks grow with the table once there are GRID of them, so that rows and anchors are sent to a fixed number of places, and
what places keep of an anchor meets in fixed numbers: all that is shuffled grows with the table, not with its square.

Two products are made. The first, of blocks whose labels share a hash group, gives each anchor its positives. The second, of
all blocks, carries the positives' scores along with the anchors and keeps, of each anchor and positive, the best rows within
the positive's window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import release, written

#: Anchors and rows of a block at least, anchor blocks and row blocks at most, dimensions of a chunk.
ANCHORS, ROWS, GRID, CHUNK = 16_384, 16_384, (2, 32), 64
#: Anchors and rows of a strip, whose scores are in memory at a time.
STRIP = (256, 16_384)
#: Hash groups of labels: the first product is of one group at a time.
GROUPS = 16
#: No score: below all, and its negative is above all.
NONE = -np.iinfo(np.int64).max


def fixed_point(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; a row whose components do not fit 62 bits stops the job."""
    large = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) >= float(1 << 62))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(~large, whole).otherwise(F.raise_error(F.lit("a component is too large for fixed point")).cast("array<bigint>"))


def sound(vector: Column) -> Column:
    """Whether a vector is there and has no null and no component that is not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact: in doubles where every sum stays below 2^53, else in int64."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    top = max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min()))) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 1 << 62:
        return a @ b.T
    raise ValueError("a score does not fit 64 bits")


def _spans(count: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """The first and the last block of each group. count: rows of each group."""
    out, at = {}, 0
    for g, n in sorted(count.items()):
        out[g] = (at, at + max(1, -(-n // size)) - 1)
        at = out[g][1] + 1
    return out


def _of(group: Column, values: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(x).cast("int") for kv in values.items() for x in kv])[group]


def _dealt(rows: DataFrame, place: str, own: dict[int, tuple[int, int]], other: str, span: dict[int, tuple[int, int]], together: bool) -> DataFrame:
    """The rows of every block in all places of its row or column of the grid: i and j beside their columns.

    A block is a part of the hashes of its group's ids. together: blocks of a group meet blocks of that group only.
    """
    g = F.col("group")
    many = {k: hi - lo + 1 for k, (lo, hi) in own.items()}
    block = _of(g, {k: lo for k, (lo, _) in own.items()}) + F.pmod(F.xxhash64("vec_id"), _of(g, many)).cast("int")
    if together:
        ends = [_of(g, {k: x[e] for k, x in span.items()}) for e in (0, 1)]
    else:
        ends = [F.lit(0), F.lit(max(hi for _, hi in span.values()))]
    known = [c for c in rows.columns if c != "group"]
    return rows.where(g.isin(list(span)) if together else F.lit(True)).select(block.alias(place), F.explode(F.sequence(*ends)).alias(other), *known)


class Side:
    """The anchors or the rows of a place in order of id: ids, labels, components, and what the anchors want."""

    def __init__(self, part: pa.Table):
        part = part.sort_by("vec_id").combine_chunks()
        self.ids, self.labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
        flat = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.v = flat.reshape(part.num_rows, -1)
        self.wants = part.column("wants").to_pylist() if "wants" in part.column_names else []


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The products of all chunks of dimensions, added."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    total = _product(x[:, :CHUNK], y[:, :CHUNK])
    for k in range(CHUNK, x.shape[1], CHUNK):
        total += _product(x[:, k : k + CHUNK], y[:, k : k + CHUNK])
    return total


def _falling(score: np.ndarray, out: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of each row's scores from the largest on, ties by place, the first `most` or all; those of `out` become NONE."""
    n = score.shape[1]
    bits = max(1, int(n - 1).bit_length())
    if score.size and max(abs(int(score.max())), abs(int(score.min()))) < 1 << (61 - bits):
        # score and place in one number, which sorts faster than places do
        key = -((score << bits) + ((1 << bits) - 1 - np.arange(n)))
        key[out] = -NONE
        if most is not None and most < n:
            key = np.partition(key, most, axis=1)[:, :most]
        key.sort(axis=1)
        gone, key = key == -NONE, -key
        place, fall = (1 << bits) - 1 - (key & ((1 << bits) - 1)), key >> bits
        fall[gone], place[gone] = NONE, 0
        return place, fall
    score[out] = NONE
    order = np.argsort(-score, axis=1, kind="stable")[:, :most]
    return order, np.take_along_axis(score, order, 1)


def _first(cols: list[np.ndarray], keys: int, most: int) -> list[np.ndarray]:
    """Of rows with equal first `keys` columns the first `most`: largest score first (the last column), ties by id (the one before)."""
    order = np.lexsort((cols[-2], -cols[-1], *cols[keys - 1 :: -1]))
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)
    start = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return [c[rank < most] for c in cols]


def _best(anchors: DataFrame, rows: DataFrame, together: bool, sizes: tuple[int, int] | None, pick: Callable[[Side, slice, Side, slice, np.ndarray], list[np.ndarray]], names: list[str], keys: int, most: int) -> DataFrame:
    """What `pick` finds in the strips of every place, of equal keys the best: bigint columns, the last two an id and a score."""
    if not together:  # blocks of all labels, so that a small group fills no block of its own
        anchors, rows = (df.withColumn("group", F.lit(0)) for df in (anchors, rows))
    count = {side: dict(df.groupBy("group").count().collect()) for side, df in (("a", anchors), ("b", rows))}
    if sizes is None:
        sizes = tuple(max(least, -(-sum(count[side].values()) // n)) for side, least, n in (("a", ANCHORS, GRID[0]), ("b", ROWS, GRID[1])))
    span_a, span_b = _spans(count["a"], sizes[0]), _spans(count["b"], sizes[1])
    left = _dealt(anchors, "i", span_a, "j", span_b, together)
    right = _dealt(rows, "j", span_b, "i", span_a, together)

    def place(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = []
        if a.num_rows and b.num_rows:  # a block may have no rows
            x, y = Side(a), Side(b)
            for r in range(0, len(y.ids), STRIP[1]):
                for k in range(0, len(x.ids), STRIP[0]):
                    sa, sb = slice(k, k + STRIP[0]), slice(r, r + STRIP[1])
                    found.append(pick(x, sa, y, sb, _scores(x.v[sa], y.v[sb])))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * len(names)
        out = pa.Table.from_arrays([pa.array(c, pa.int64()) for c in _first(cols, keys, most)], names=names)
        release()
        return out

    near = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(place, ", ".join(f"{c} bigint" for c in names))
    order = Window.partitionBy(*names[:keys]).orderBy(F.desc(names[-1]), names[-2])
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _positives(anchors: DataFrame, rows: DataFrame, most: int, sizes: tuple[int, int] | None) -> DataFrame:
    """anchor_id, positive_id, score: of each anchor its best rows of its label, ties by smaller id."""

    def pick(x: Side, sa: slice, y: Side, sb: slice, score: np.ndarray) -> list[np.ndarray]:
        own, ids = x.ids[sa], y.ids[sb]
        top, found = _falling(score, (x.labels[sa][:, None] != y.labels[sb][None, :]) | (own[:, None] == ids[None, :]), most)
        k, r = np.nonzero(found != NONE)
        return [own[k], ids[top[k, r]], found[k, r]]

    return _best(anchors, rows, True, sizes, pick, ["anchor_id", "positive_id", "score"], 1, most).drop("rank")


def _negatives(anchors: DataFrame, rows: DataFrame, most: int, window: tuple[int, int], sizes: tuple[int, int] | None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    low, high = window

    def pick(x: Side, sa: slice, y: Side, sb: slice, score: np.ndarray) -> list[np.ndarray]:
        ids = y.ids[sb]
        order, fall = _falling(score, x.labels[sa][:, None] == y.labels[sb][None, :])
        out: list[tuple[int, ...]] = []
        for k, (anchor, wants) in enumerate(zip(x.ids[sa].tolist(), x.wants[sa], strict=True)):
            rise = -fall[k]
            for w in wants:
                p = w["score"]
                # the window in whole scores; Python's integers don't overflow
                top, floor = high * p // 100, -(-low * p // 100)
                at = int(np.searchsorted(rise, -top, "left"))
                for r, s in zip(order[k, at : at + most].tolist(), fall[k, at : at + most].tolist(), strict=True):
                    if s >= floor and s != NONE:
                        out.append((anchor, w["positive_id"], p, int(ids[r]), s))
        return list(np.array(out, np.int64).reshape(-1, 5).T)

    ranked = _best(anchors, rows, False, sizes, pick, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"], 2, most)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: tuple[int, int] | None = None) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 x); a score is the integer inner product with the anchor. An anchor (a row of which
    `anchors`, over vec_id, holds) has as positives its best `positives` other rows of its label; of each come the best
    `negatives` rows of other labels with window[0] % <= negative_score / positive_score <= window[1] %, as integers. Higher
    scores come first, ties by smaller vec_id. Rows without an id or a label, and those whose vector is null or holds null or
    a number that is not finite, take no part. Of repeated ids, the row of the largest label, then vector, counts, once. A
    shorter vector counts as if zeros followed. An empty table, or one without anchors, gives no row. Scores that could pass
    62 bits stop the job. block: anchors and rows of a block, if not by the size of the table.
    """
    spark = df.sparkSession
    given = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    good = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound(F.col("v"))).withColumn("v", fixed_point(F.col("v")))
    once = good.groupBy("vec_id").agg(F.max(F.struct("label", "v")).alias("x")).select("vec_id", "x.*")
    rows = written(once.withColumn("group", F.pmod(F.hash("label"), F.lit(GROUPS))), "negatives-rows")
    size, top = rows.agg(F.max(F.size("v")), F.max(F.greatest(F.coalesce(F.array_max("v"), F.lit(0)), -F.coalesce(F.array_min("v"), F.lit(0))))).first()
    chosen = rows.where(anchors)
    if size is None or chosen.isEmpty():
        return spark.createDataFrame([], RESULT)
    if size * top * top >= 1 << 62:
        raise ValueError("scores may not fit 64 bits")
    kind = next(t for t, bits in (("smallint", 15), ("int", 31), ("bigint", 63)) if top < 1 << bits)
    filled = F.concat(F.col("v").cast(f"array<{kind}>"), F.array_repeat(F.lit(0).cast(kind), F.lit(max(1, size)) - F.size("v")))
    rows = rows.withColumn("v", filled)
    chosen = rows.where(anchors)
    found = written(_positives(chosen, rows, positives, block), "negatives-positives")
    wants = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("positive_id", "score"))).alias("wants"))
    asked = written(chosen.join(wants, "vec_id").select("vec_id", "label", "wants", "group", "v"), "negatives-anchors")
    if asked.isEmpty():
        return spark.createDataFrame([], RESULT)
    return _negatives(asked, rows, negatives, window, block)
