"""Near-duplicate documents: a grouped prefix join on Jaccard similarity of word n-gram sets.

Sets are ordered by how common their n-grams are, rarest first, as a sketch of fixed size counts them; any order that all
sets share is right, this one keeps common passages out of the prefixes. Two sets that are similar enough share an n-gram
of their prefixes. Equal sets are one class; classes with equal prefixes and sizes form a group, whose prefix is looked
up once. Pairs of groups that share a prefix n-gram are filtered by size and by the n-gram's places, then expanded into
classes and verified on the whole sets.

An n-gram that many groups share would make pairs with the square of their number. There every class is compared with the
most typical one instead. Classes near it link through one of them; all others that link must share differences from it,
so that a second prefix join, on differences, finds their pairs. Nothing is capped: the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import bitmap, in_bitmap, mix64, small_batches, tidy, word_hashes, written
from halyard.llm.components import components

WORDS, PERCENT = 5, 80
#: Counters of the sketch: 16 MB in a counting task and the driver, 4 MB as levels in a worker, whatever the input's size.
SKETCH_BITS = 22
_CHUNK = 1 << 16
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def sets_of(col: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; of a shorter text, the hash of all its words; else none."""
    words, sizes = word_hashes(col, lower=True)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams = mix64(grams * _ODD[0] + words[k : k + len(grams)] + np.uint64(k))
    out, at = [], 0
    for size in sizes.tolist():
        if size >= n:
            out.append(np.unique(grams[at : at + size - n + 1]))
        elif size:
            h = np.zeros(1, np.uint64)
            for k in range(size):
                h = mix64(h * _ODD[1] + words[at + k : at + k + 1] + np.uint64(k))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def _class_id(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a = mix64(np.array([mix64(s).sum() + np.uint64(len(s))]))
        b = np.array([mix64(s ^ _ODD[2]).sum()])
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _group_id(prefix: np.ndarray, n: int) -> int:
    """64 bits that name a prefix of sets of n n-grams.

    One long, so that joins of groups have one long as key: the hash table of a broadcast with a longer key takes a whole
    page of an executor's heap, however small it is, until the driver collects its garbage.
    """
    return int(mix64(np.array([_class_id(prefix)[0]], np.int64).view(np.uint64) + np.uint64(n)).view(np.int64)[0])


def _slices(batches: Iterator[pa.RecordBatch], text: str, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            yield b, sets_of(b.column(text), n)


def sketch(df: DataFrame, text: str, n: int) -> np.ndarray:
    """How common the n-grams are, by the upper bits of their hashes, each document counted once: 16 log2(1 + count), 255 at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for _, sets in _slices(batches, text, n):
            np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        counts = np.minimum(total, 2**16 - 1).astype(np.uint16).reshape(-1, _CHUNK)
        # a small partition meets few n-grams: their places and counts are far less than all counters
        chunk = np.flatnonzero(counts.any(axis=1))
        some = [np.flatnonzero(counts[c]) for c in chunk]
        few = [2 * len(at) < _CHUNK for at in some]
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk, pa.int32()), pa.array(np.full(len(chunk), TaskContext.get().partitionId() % 64 // 16), pa.int32()),
             pa.array([at.astype(np.uint16).tobytes() if f else b"" for at, f in zip(some, few, strict=True)], pa.binary()),
             pa.array([(counts[c][at] if f else counts[c]).tobytes() for c, at, f in zip(chunk, some, few, strict=True)], pa.binary())],
            names=["chunk", "part", "at", "counts"],
        )

    def add(kind: type, low: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(_CHUNK, np.float32)
            for at, c in zip(pdf["at"], pdf["counts"], strict=True):
                total[np.frombuffer(at, np.uint16) if at else slice(None)] += np.frombuffer(c, kind)
            out = np.minimum(16 * np.log2(1 + total), 255).astype(np.uint8) if low else total
            return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "part": -1, "at": [b""], "counts": [out.tobytes()]})

        return run

    schema = "chunk int, part int, at binary, counts binary"
    parts = df.select(text).mapInArrow(tidy(count), schema).groupBy("chunk", "part").applyInPandas(add(np.uint16, False), schema)
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for chunk, _, _, levels in parts.groupBy("chunk").applyInPandas(add(np.float32, True), schema).toLocalIterator():
        out[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(levels, np.uint8)
    return out


def classes(df: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, cid, n; component of each linked class: node, label). cid is null for empty sets."""
    spark = df.sparkSession
    small_batches(spark)
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = spark.sparkContext.broadcast(sketch(source, "text", words))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _slices(batches, "text", words):
            cid, other, group, prefix, common = [], [], [], [], []
            for s in sets:
                if not len(s):
                    for x in (cid, other, group, prefix, common):
                        x.append(None)
                    continue
                c = _counted(s, counts.value)
                p = s[np.lexsort((s, c))[: len(s) - -(-percent * len(s) // 100) + 1]]
                a, o = _class_id(s)
                cid.append(a)
                other.append(o)
                group.append(_group_id(p, len(s)))
                prefix.append(p.view(np.int64))
                common.append(float(c.mean()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cid, pa.int64()), pa.array(other, pa.int64()), pa.array(group, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(common, pa.float64())], names=["doc_id", "n", "cid", "other", "prefix_id", "prefix", "common"])

    kind = df.schema[doc_id].dataType.simpleString()
    rows = written(source.mapInArrow(tidy(prefixes), f"doc_id {kind}, n bigint, cid bigint, other bigint, prefix_id bigint, prefix array<bigint>, common double"), "jaccard-prefixes")
    documents = rows.select("doc_id", "cid", "n")
    each = rows.where("cid is not null").groupBy("cid", "other", "n", "prefix_id").agg(F.max("common").alias("common"), F.min("doc_id").alias("rep"))
    members = written(each.select("cid", "n", "prefix_id", "common", F.xxhash64("rep").alias("rep")), "jaccard-classes")
    groups = written(members.groupBy("prefix_id", "n").agg(F.count("*").alias("k"), F.max(F.struct("common", "cid")).alias("typical")), "jaccard-groups")

    met = _keyed(rows.where("cid is not null").select("prefix_id", "n", "prefix"), groups, percent)
    hot = F.col("total") > FEW
    # group pairs of keys with few classes, filtered, then expanded
    few = met.where(~hot).select("key", "prefix_id", "n", "lo", "hi")
    other = few.toDF("key", "prefix_b", "m", "lo_b", "hi_b")
    pairs = few.join(other, "key").where("(prefix_id, n) < (prefix_b, m) and lo <= hi_b and lo_b <= hi").select("prefix_id", "n", "prefix_b", "m").distinct()
    pairs = _likely(written(pairs, "jaccard-group-pairs"), rows, percent)
    left, right = members.select("prefix_id", F.col("cid").alias("a")), members.select(F.col("prefix_id").alias("prefix_b"), F.col("cid").alias("b"))
    pairs = pairs.join(left, "prefix_id").join(right, "prefix_b").select("a", "b")
    inside = members.join(groups.where(f"k between 2 and {FEW}").select("prefix_id"), "prefix_id")
    inside = inside.select("prefix_id", F.col("cid").alias("a")).join(right.toDF("prefix_id", "b"), "prefix_id").where("a < b").select("a", "b")
    pairs = written(pairs.unionByName(inside), "jaccard-pairs")
    # of keys and groups with many classes each class meets the most typical one
    led = met.where(hot).select("prefix_id", "lead").unionByName(groups.where(f"k > {FEW}").select("prefix_id", F.col("typical.cid").alias("lead"))).distinct()
    stars = written(led.join(members, "prefix_id").select("lead", "cid").unionByName(led.select("lead", F.col("lead").alias("cid"))).distinct(), "jaccard-stars")

    links = _verified(pairs, source, words, members, percent)
    if stars.isEmpty():
        return documents, components(links)
    far = written(_differences(stars, _sets(source, words, stars.select("cid"), members), counts, percent), "jaccard-differences")
    best = far.groupBy("lead").agg(F.max(F.struct("slack", "cid")).alias("best"))
    near = far.join(best, "lead").where("slack + best.slack >= 0 and cid != best.cid").select(F.col("cid").alias("a"), F.col("best.cid").alias("b"))
    links = written(links.unionByName(near), "jaccard-links")
    label = components(links)
    pairs = written(_apart(far, label, percent), "jaccard-rest")
    if pairs.isEmpty():
        return documents, label
    return documents, components(links.unionByName(_verified(pairs, source, words, members, percent)))


#: Keys with more classes than this are settled through their most typical class instead of pair by pair.
FEW = 16


def _counted(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def _range(d: str, n: str, pos: str, percent: int) -> tuple[Column, Column]:
    """(lo, hi) of an element at place pos of a set of d elements: two sets whose first common element lies at these places can only be alike if each lo is at most the other's hi.

    Sets of n and m n-grams link if they differ in (n + m) (100 - percent) / (100 + percent) n-grams at most.
    """
    rest, whole = 100 - percent, 100 + percent
    return F.expr(f"{whole} * {d} - {rest} * {n}"), F.expr(f"{whole} * {d} + {rest} * {n} - {2 * whole} * {pos}")


def _in_reach(rows: DataFrame, name: str) -> DataFrame:
    """rows (key, lo, hi, ...) that some row of their key may be alike to, written."""
    limits = rows.groupBy("key").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return written(rows.join(limits, "key").where("lo <= most and hi >= least").drop("least", "most").distinct(), name)


#: Rows of ids that are broadcast at most; more of them meet the other side in a shuffle.
SENT = 1 << 19


def _among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose columns, those of ids, are in ids."""
    return df.join(F.broadcast(ids) if ids.count() <= SENT else ids, ids.columns, "left_semi")


def _likely(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The group pairs that share as many prefix n-grams as groups with similar sets must.

    Of two prefixes in one order, the one that ends first shares only prefix n-grams with the other; so sets share at most
    the prefixes' common n-grams and the rest of one set.
    """
    ids = written(pairs.select("prefix_id").union(pairs.select("prefix_b")).distinct(), "jaccard-likely")
    known = _among(rows.select("prefix_id", "prefix"), ids).dropDuplicates(["prefix_id"])
    both = pairs.join(known.withColumnRenamed("prefix", "x"), "prefix_id").join(known.toDF("prefix_b", "y"), "prefix_b")
    most = F.size(F.array_intersect("x", "y")) + F.greatest(F.col("n") - F.size("x"), F.col("m") - F.size("y"))
    return both.where((100 + percent) * most >= percent * (F.col("n") + F.col("m"))).select("prefix_id", "n", "prefix_b", "m")


def _keyed(rows: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """key, prefix_id, n, lo, hi, total, lead: the groups under each n-gram that several prefixes hold, written.

    total: classes under the key; lead: the class with the most common n-grams. A key stands for an n-gram and a class of
    sizes: sets that fit in size share one of two.
    """
    spark = rows.sparkSession
    # n-grams that one row holds only make no pair; those of copies alone go below, where groups count once
    shared = rows.select(F.explode("prefix").alias("gram")).groupBy("gram").agg(F.count("*").alias("rows")).where("rows > 1").select("gram")
    several = spark.sparkContext.broadcast(bitmap(shared, "gram"))
    log = max(1e-9, -np.log(percent / 100)) * 1.0001  # a little wider, so that rounding never parts a pair by two classes

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for b in batches:
            for pid, n, prefix in zip(*[b.column(c).to_pylist() for c in ("prefix_id", "n", "prefix")], strict=True):
                if (pid, n) in done:
                    continue
                if len(done) > 1 << 19:  # only spares the shuffle some rows
                    done.clear()
                done.add((pid, n))
                p = np.array(prefix, np.int64)
                at = np.flatnonzero(in_bitmap(several.value, p))
                if not len(at):
                    continue
                size = int(np.log(n) / log)
                grams = p[at].view(np.uint64)
                key = np.concatenate([mix64(grams + np.uint64(k * int(_ODD[0]) % (1 << 64))) for k in (size, size + 1)])
                m = len(key)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(m, pid)), pa.array(np.full(m, n)), pa.array(np.r_[at, at].astype(np.int32))], names=["key", "prefix_id", "n", "pos"])

    lo, hi = _range("n", "n", "pos", percent)
    found = rows.mapInArrow(tidy(_batched(keys)), "key bigint, prefix_id bigint, n bigint, pos int").withColumns({"lo": lo, "hi": hi}).drop("pos")
    inside = _in_reach(written(found, "jaccard-found"), "jaccard-reach")
    several = inside.groupBy("key").agg(F.min("prefix_id").alias("a"), F.max("prefix_id").alias("b"), F.min("n").alias("c"), F.max("n").alias("d")).where("a != b or c != d").select("key")
    met = written(inside.join(several, "key").join(groups.drop("n"), "prefix_id"), "jaccard-keys")
    held = met.groupBy("key").agg(F.sum("k").alias("total"), F.max("typical").alias("typical"))
    return met.select("key", "prefix_id", "n", "lo", "hi").join(held.select("key", "total", F.col("typical.cid").alias("lead")), "key")


def _batched(run):
    """Joins the many small batches that run yields."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows > 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def _sets(source: DataFrame, words: int, asked: DataFrame, members: DataFrame) -> DataFrame:
    """cid, grams (sorted 64-bit hashes) of the classes asked for; only the first document of each class is parsed."""
    wanted = written(asked.toDF("cid").distinct().join(members, "cid").select("cid", "rep"), "jaccard-asked")
    ids = source.sparkSession.sparkContext.broadcast(bitmap(wanted, "cid"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for _, sets in _slices(batches, "text", words):
            cids = np.array([_class_id(s)[0] if len(s) else 0 for s in sets], np.int64)
            out = []
            for i in np.flatnonzero(in_bitmap(ids.value, cids) & np.array([len(s) > 0 for s in sets], bool)).tolist():
                if cids[i] not in met:
                    met.add(int(cids[i]))
                    out.append(i)
            if len(met) > 1 << 20:  # only spares the shuffle some rows
                met.clear()
            yield pa.RecordBatch.from_arrays([pa.array(cids[out]), pa.array([sets[i].view(np.int64) for i in out], pa.list_(pa.int64()))], names=["cid", "grams"])

    first = _among(source.select("text", F.xxhash64("doc_id").alias("rep")), wanted.select("rep")).select("text")
    return first.mapInArrow(tidy(pick), "cid bigint, grams array<bigint>").dropDuplicates(["cid"])


def _verified(pairs: DataFrame, source: DataFrame, words: int, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, written."""
    sets = _sets(source, words, pairs.select("a").union(pairs.select("b")), members)
    first = sets.select(F.col("cid").alias("a"), F.col("grams").alias("x"))
    both = pairs.join(first, "a").join(sets.select(F.col("cid").alias("b"), F.col("grams").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return written(both.where((100 + percent) * common >= percent * (F.size("x") + F.size("y"))).select("a", "b"), "jaccard-links")


#: n-grams of members that meet a copy of their base in one group.
MEET = 1 << 18
#: Classes of a leader whose common n-grams are its base.
VOTERS = 25


def _bases(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """lead, base: the n-grams that most of a few of a leader's classes hold, drawn by a hash.

    Copies of one text that each differ in places of their own have nothing in common against it, as they would have against
    any one of them. Which base it is changes no link, only how many pairs are looked at.
    """
    order = Window.partitionBy("lead").orderBy(F.xxhash64("cid", "lead"))
    drawn = stars.withColumn("r", F.row_number().over(order)).where(F.col("r") <= VOTERS).select("lead", "cid").join(sets, "cid")

    def vote(some: pd.DataFrame) -> pd.DataFrame:
        grams, held = np.unique(np.concatenate([np.asarray(x, np.int64) for x in some["grams"]]), return_counts=True)
        return pd.DataFrame({"lead": some["lead"].iloc[:1], "base": [grams[2 * held > len(some)]]})

    return drawn.groupBy("lead").applyInPandas(vote, "lead bigint, base array<bigint>")


def _differences(stars: DataFrame, sets: DataFrame, counts: Broadcast, percent: int) -> DataFrame:
    """lead, cid, n, d, slack, keys: how each class differs from its leader's base.

    d: n-grams that only one of both has. Two classes of a leader differ in d + d' n-grams at most, so they link if their
    slacks add up to 0 or more; the class of most slack links with every class of such a pair. All others that link have
    differences in common; keys holds the hashed first of them, those likely to be rare first, as in a prefix join.
    """
    sets = written(sets, "jaccard-star-sets")
    sized = stars.join(sets, "cid").withColumn("n", F.size("grams"))
    parts = sized.groupBy("lead").agg(F.sum("n").cast("long").alias("words")).select("lead", F.ceil(F.col("words") / MEET).cast("int").alias("parts"))
    sized = sized.join(parts, "lead").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    leaders = parts.join(_bases(stars, sets), "lead").select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "base").toDF("leader", "share", "base")
    rest, whole = 100 - percent, 100 + percent

    def differ(mine: pd.DataFrame, leader: pd.DataFrame) -> pd.DataFrame:
        base = np.asarray(leader["base"].iloc[0], np.int64).view(np.uint64)
        salt = mix64(np.array([leader["leader"].iloc[0]], np.int64).view(np.uint64))
        ds, keys = [], []
        for x in mine["grams"]:
            s = np.asarray(x, np.int64).view(np.uint64)
            new, gone = np.setdiff1d(s, base, assume_unique=True), np.setdiff1d(base, s, assume_unique=True)
            a, b = _counted(new, counts.value), _counted(gone, counts.value).astype(np.int64)
            e = np.concatenate([new[np.lexsort((new, a))], gone[np.lexsort((gone, -b))]])
            ds.append(len(e))
            keys.append(mix64(e[: len(s) * rest * (100 + percent) // (whole * percent) + 1] ^ salt).view(np.int64))
        n, d = mine["n"].to_numpy(np.int64), np.array(ds, np.int64)
        return pd.DataFrame({"lead": mine["lead"], "cid": mine["cid"], "n": n, "d": d, "slack": n * rest - d * whole, "keys": keys})

    return sized.groupBy("lead", "part").cogroup(leaders.groupBy("leader", "share")).applyInPandas(differ, "lead bigint, cid bigint, n bigint, d bigint, slack bigint, keys array<bigint>")


def _apart(far: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components that share one of the first differences from a leader, where it may suffice."""
    rows = far.select("cid", "n", "d", F.posexplode("keys").alias("pos", "key"))
    lo, hi = _range("d", "n", "pos", percent)
    rows = rows.select("key", "cid", lo.alias("lo"), hi.alias("hi"))
    several = rows.groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a != b").select("key")
    rows = rows.join(several, "key").join(label, F.col("cid") == F.col("node"), "left").select("key", "cid", "lo", "hi", F.coalesce("label", "cid").alias("label"))
    inside = _in_reach(rows, "jaccard-reach")
    several = inside.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("key")
    met = written(inside.join(several, "key"), "jaccard-apart")
    pairs = met.join(met.toDF("key", "b", "lo_b", "hi_b", "label_b"), "key").where("cid < b and label != label_b and lo <= hi_b and lo_b <= hi").select(F.col("cid").alias("a"), "b").distinct()
    # of what two classes of one leader differ in they must share as much as the bound asks for, in their first differences or beyond
    most = far.groupBy("lead", "cid").agg(F.first("n").alias("n"), F.first("d").alias("d"), F.first("keys").alias("keys"))
    x, y = most.toDF("lead", "a", "n", "d", "x"), most.toDF("lead", "b", "m", "e", "y")
    held = F.xxhash64("lead", "b").alias("held")  # one long as key; what else has it by chance is one more pair to verify
    both = written(pairs, "jaccard-apart-pairs").join(x, "a").select("*", held).join(y.select("m", "e", "y", held), "held")
    shared = F.size(F.array_intersect("x", "y")) + F.greatest(F.col("d") - F.size("x"), F.col("e") - F.size("y"))
    return both.where((100 + percent) * (F.col("d") + F.col("e") - 2 * shared) <= (100 - percent) * (F.col("n") + F.col("m"))).select("a", "b").distinct()


def near_duplicates(df: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row.

    Texts are lower-cased in A-Z and cut into words. A row's set holds its distinct runs of `words` words; with fewer
    words, all of them as one run; null, empty and blank texts have an empty set, link with nothing and get their own id.
    Rows link if 100 x intersection >= percent x union. component_id is the smallest doc_id reachable by links, the row's
    own included; null ids are passed over, and if there is no other, it is null. Rows that repeat an id or a text are
    each returned. Texts are whole at any length. An empty table gives an empty result.
    """
    documents, label = classes(df, words, percent, doc_id, text)
    near = documents.where("cid is not null").join(label, documents["cid"] == label["node"], "left").withColumn("label", F.coalesce("label", "cid"))
    near = written(near.select("doc_id", "n", "label"), "jaccard-labelled")
    least = near.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = near.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(documents.where("cid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def representatives(df: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of near duplicates: that whose doc_id is the component's.

    Of rows that share this id and their text one stays; rows with empty sets and rows with null ids all stay.
    """
    found = near_duplicates(df, words, percent, doc_id, text)
    kept = found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_kept")).where("_kept is not null").distinct()
    empty = F.col(text).isNull() | ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = df.where(~empty & F.col(doc_id).isNotNull()).join(kept, F.col(doc_id) == F.col("_kept")).drop("_kept").dropDuplicates([doc_id, text])
    return rows.unionByName(df.where(empty | F.col(doc_id).isNull()))
