"""A keyed table that grows: of each key one row, however often or by how many writers it is appended.

Data lie in folders that never change; a manifest of each version lists those that count. An append writes the rows that the
table doesn't hold, then tries to be the one who puts the next version's manifest in place, which only one writer can. Who
comes too late leaves out what the others have added since, and tries again. A writer that dies leaves a folder that no
manifest lists.

Caches of model answers are such tables: cards with CARD_KEYS, raw scenarios with RAW_KEYS, so that an answer of another
model, or to another version of the question, is never taken for this one's.
"""

from __future__ import annotations

import json
import os
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.sources.files import listed, open_fs

CARD_KEYS = ("unit_id", "model", "version", "doc_id")
RAW_KEYS = ("unit_id", "model", "version")
#: Folders of a version beyond which an append rewrites the table as one.
MOST_FOLDERS = 64


def _manifests(path: str) -> list[str]:
    fs, base = open_fs(path)
    return [f.path for f in listed(fs, f"{base}/_versions") if f.is_file and f.path.endswith(".json")]


def _latest(path: str) -> tuple[int, list[str]]:
    """(version, folders) of the last manifest; version 0 holds nothing."""
    found = _manifests(path)
    if not found:
        return 0, []
    with open_fs(path)[0].open_input_stream(found[-1]) as f:
        return int(os.path.basename(found[-1])[:-5]), json.loads(f.read())["folders"]


def _put_once(spark: SparkSession, path: str, version: int, folders: list[str]) -> bool:
    """Puts the manifest of a version in place, whole, unless another writer has: then False."""
    fs, base = open_fs(path)
    fs.create_dir(f"{base}/_versions", recursive=True)
    target, aside = f"{base}/_versions/{version:010}.json", f"{base}/_versions/.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside, compression=None) as out:
        out.write(json.dumps({"folders": folders}).encode())
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            os.link(aside, target)
        except FileExistsError:
            return False
        finally:
            fs.delete_file(aside)
        return True
    # a rename that may not overwrite is one step on HDFS; on stores without renames, one writer at a time
    jvm, root = spark._jvm, path.rstrip("/")
    here, there = (jvm.org.apache.hadoop.fs.Path(f"{root}/_versions/{os.path.basename(x)}") for x in (aside, target))
    done = here.getFileSystem(spark._jsc.hadoopConfiguration()).rename(here, there)
    if not done:
        fs.delete_file(aside)
    return bool(done)


def read_keyed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's rows; none where nothing was appended."""
    folders = _latest(path)[1]
    return _read(spark, path, folders, schema)


def _read(spark: SparkSession, path: str, folders: list[str], schema: str) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{f}" for f in folders])


def append_keyed(rows: DataFrame, keys: tuple[str, ...], path: str, tries: int = 20) -> int:
    """Adds the rows whose keys the table doesn't hold; returns the version that holds them. Of rows of one key the least counts.

    Keys are not null. Nothing is written where nothing is new.
    """
    spark, names = rows.sparkSession, rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    order = Window.partitionBy(*keys).orderBy(*[F.to_json(F.struct(c)) for c in names])
    once = rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k").where(" and ".join(f"`{k}` is not null" for k in keys))
    version, folders = _latest(path)
    for _ in range(tries):
        new = once.join(_read(spark, path, folders, schema).select(*keys), list(keys), "left_anti").select(*names)
        whole = len(folders) >= MOST_FOLDERS
        if whole:
            new = new.unionByName(_read(spark, path, folders, schema))
        folder = f"data-{uuid.uuid4().hex}"
        new.write.parquet(f"{path.rstrip('/')}/{folder}")
        mine = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{folder}")
        if mine.isEmpty():
            return version
        if _put_once(spark, path, version + 1, [folder] if whole else [*folders, folder]):
            return version + 1
        # what was written is the input of the next try, so that rows aren't computed anew
        once = mine
        version, folders = _latest(path)
    raise RuntimeError(f"{path}: other writers were faster {tries} times")


def misses(docs: DataFrame, cache: DataFrame, model: str, version: str, keys: tuple[str, ...] = ("unit_id", "doc_id")) -> DataFrame:
    """Rows that the cache holds no answer of, by this model to this version of the question."""
    held = cache.where((F.col("model") == model) & (F.col("version") == version)).select(*keys)
    return docs.join(held, list(keys), "left_anti")
