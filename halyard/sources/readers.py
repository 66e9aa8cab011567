"""Cards, panels, corpora, adjustments and run files as DataFrames."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.sources.files import open_fs
from halyard.sources.panel_files import SCHEMA, PanelFiles, read_panel
from halyard.sources.unit_files import read_unit_files

UNIT_SCHEMA = (
    "unit_id string, family string, target_type string, value_unit string, asof date, n_draws_min int, assets array<string>, "
    "horizons array<int>, panel_meta array<struct<panel string, asset_ids array<string>, frequency string>>, stress_prob double, tail_df double"
)
SCENARIO_SCHEMA = "struct<scenarios array<struct<name string, weight double, drift map<string,double>, vol_mult map<string,double>, evidence array<string>, established boolean>>, tail_df double, notes array<string>>"


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(str(s.getPath()) for s in path.getFileSystem(conf).globStatus(path) or [])


def _unit(card: dict[str, Any]) -> dict[str, Any]:
    t, params = card["targets"], (card.get("scoring", {}).get("params") or {})
    panels = {k: v for k, v in (card.get("panels") or {}).items() if isinstance(v, dict)}
    cutoff = card.get("provenance", {}).get("data_cutoff")
    return {
        "unit_id": str(card["task"]["id"]), "family": str(card.get("metadata", {}).get("category", "")), "target_type": str(t.get("target_type", "level")),
        "value_unit": str(t.get("value_unit", "")), "asof": str(cutoff)[:10] if cutoff else None, "n_draws_min": int(t.get("n_draws_min") or params.get("n_draws_min") or 200),
        "assets": [str(a) for a in t["asset_ids"]], "horizons": [int(h) for h in t["horizons"]],
        "panel_meta": [{"panel": k, "asset_ids": [str(a) for a in v.get("asset_ids", [])], "frequency": str(v.get("frequency", ""))} for k, v in panels.items()],
    }


CARD_SCHEMA = UNIT_SCHEMA.replace("asof date", "asof string") + ", problem string, file string"


CARD_NAMES = ("unit_id", "family", "target_type", "value_unit", "asof", "n_draws_min", "assets", "horizons", "panel_meta", "stress_prob", "tail_df", "problem", "file")


def _parse_cards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, text in frame.itertuples(index=False):
            try:
                row = _unit(tomllib.loads(text)) | {"problem": None}
            except (KeyError, TypeError, ValueError, AttributeError) as e:  # no TOML, or no card
                row = {"problem": f"{type(e).__name__}: {e}"}
            rows.append([row.get(n) if n != "file" else path for n in CARD_NAMES])
        yield pd.DataFrame(rows, columns=list(CARD_NAMES)).astype({"n_draws_min": "Int32", "stress_prob": "float64", "tail_df": "float64"})


def read_cards(spark: SparkSession, *patterns: str) -> DataFrame:
    """Units of all cards that the patterns find, parsed in tasks; asof is null where a card has no cutoff (see asof_or_latest).

    A file that is no card gives a row with its problem and no unit_id.
    """
    found = [p for pattern in patterns for p in _paths(spark, pattern)]
    if not found:
        raise FileNotFoundError(f"no card at {', '.join(patterns)}")
    texts = spark.read.text(found, wholetext=True).select("_metadata.file_path", "value")
    units = texts.mapInPandas(_parse_cards, CARD_SCHEMA)
    return units.withColumn("asof", F.col("asof").try_cast("date"))


def find_card(spark: SparkSession, folder: str, explicit: str | None = None) -> str:
    """The card that is named, else that of the folder, else that of the folder above."""
    for at in [explicit] if explicit else [f"{folder}/card.toml", f"{PurePosixPath(folder).parent}/card.toml"]:
        if _paths(spark, at):
            return at
    raise FileNotFoundError(f"no card for {folder}")


def _unit_folder(depth: int) -> Column:
    """The folder of a unit in the path of a file that lies so many folders below it."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return F.url_decode(F.element_at(parts, -1 - depth))


def asof_or_latest(units: DataFrame, panels: DataFrame) -> DataFrame:
    latest = panels.groupBy("unit_id").agg(F.max("date").alias("latest"))
    return units.join(latest, "unit_id", "left").withColumn("asof", F.coalesce("asof", "latest")).drop("latest")


def read_panels(spark: SparkSession, folder: str, unit_id: str) -> DataFrame:
    """Every Parquet file of a unit's folder, else of the folder above, with (date, asset or asset_id, value); the rest are passed over."""
    for at in (folder, str(PurePosixPath(folder).parent)):
        found = _paths(spark, f"{at}/*.parquet")
        if found:
            files = spark.createDataFrame([(p,) for p in found], "path string").repartition(len(found))
            rows = files.mapInArrow(_read_files(unit_id), SCHEMA)
            broken = rows.where("problem is not null").first()
            if broken:
                raise ValueError(f"{broken.file}: {broken.problem}")
            if rows.isEmpty():
                break
            return rows.drop("file", "problem")
    raise FileNotFoundError(f"no panel with date, asset and value in {folder}")


def _read_files(unit_id: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                yield from read_panel(open_fs(path)[1], path, unit_id, PurePosixPath(path).stem)

    return run


def read_panel_files(spark: SparkSession, root: str, units: list[str] | None = None) -> DataFrame:
    """Panels of every unit below root, or of some, in one scan, with the problem of a file that can't be read (see PanelFiles)."""
    spark.dataSource.register(PanelFiles)
    source = spark.read.format("halyard_panels")
    return (source if units is None else source.option("units", json.dumps(units))).load(root)


def read_corpora(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(index, files) of every unit below root, from its folder `text`, as read_corpus gives them for one; one scan each."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    none = spark.createDataFrame([], "unit_id string, file string, text string")
    texts = f"{root}/*/text/*.txt"
    files = spark.read.text(texts, wholetext=True).select(_unit_folder(2).alias("unit_id"), F.url_decode(name).alias("file"), F.col("value").alias("text")) if _paths(spark, texts) else none
    indexes = f"{root}/*/text/corpus_index.json"
    if not _paths(spark, indexes):
        return spark.createDataFrame([], "unit_id string, file string, doc_id string, day string, kind string, pos int"), files
    return _entries(spark.read.text(indexes, wholetext=True).select(_unit_folder(2).alias("unit_id"), "value")), files


def _entries(texts: DataFrame) -> DataFrame:
    """unit_id, file, doc_id, day, kind, pos of indexes (unit_id, value): an object with documents, or a list."""
    entry = "array<struct<doc_id string, file string, timestamp string, doc_type string, source string>>"
    listed = F.coalesce(F.from_json("value", f"struct<documents {entry}>")["documents"], F.from_json("value", entry))
    index = texts.select("unit_id", F.posexplode_outer(listed).alias("pos", "d")).where("d.file is not null")
    stem = F.regexp_replace("d.file", r"\.[^.]*$", "")
    return index.select("unit_id", "d.file", F.coalesce("d.doc_id", stem).alias("doc_id"), F.coalesce(F.substring("d.timestamp", 1, 10), F.lit("")).alias("day"), F.coalesce("d.doc_type", "d.source", F.lit("")).alias("kind"), "pos")


@dataclass(frozen=True)
class Loaded:
    """Units below a folder with their panels and corpora, and what could not be read."""

    units: DataFrame
    panels: DataFrame
    index: DataFrame
    files: DataFrame
    problems: DataFrame


def load_units(spark: SparkSession, root: str) -> Loaded:
    """Every unit below root: a folder for each, with card.toml in it or in its folder `panels` (which goes first), panels and `text`.

    A card names its unit; rows of the files carry that name, not the folder's. Folders without a card, cards and panel files
    that can't be read, and cards of one name are problems (unit_id, asset, problem, known), and the units of such cards are left out.
    """
    cards = read_cards(spark, f"{root}/*/card.toml", f"{root}/*/panels/card.toml")
    parts = F.split("file", "/")
    inner = F.element_at(parts, -2) == "panels"
    cards = cards.withColumn("folder", F.url_decode(F.when(inner, F.element_at(parts, -3)).otherwise(F.element_at(parts, -2)))).withColumn("inner", inner)
    first = Window.partitionBy("folder").orderBy(F.desc("inner"))
    cards = cards.withColumn("k", F.row_number().over(first)).where("k = 1").withColumn("same", F.count("*").over(Window.partitionBy("unit_id"))).drop("k", "inner")
    good = cards.where("problem is null and same = 1")
    names = good.select("folder", "unit_id")
    found = read_panel_files(spark, root).withColumnRenamed("unit_id", "folder")
    rows = found.join(names, "folder")
    index, files = (df.withColumnRenamed("unit_id", "folder").join(names, "folder").drop("folder") for df in read_corpora(spark, root))
    panels = rows.where("problem is null").select("unit_id", "panel", "asset", "date", "value", "tie")
    folders = spark.createDataFrame([(p.rstrip("/").rsplit("/", 1)[-1],) for p in _paths(spark, f"{root}/*")], "folder string").where("folder not like '\\_%'")
    null = F.lit(None).cast("string")
    none = F.array().cast("array<string>").alias("known")
    bad = cards.where("problem is not null or same > 1").select(F.coalesce("unit_id", "folder").alias("unit_id"), null.alias("asset"), F.coalesce(F.concat(F.lit("card: "), "problem"), F.lit("card: its name is another card's too")).alias("problem"), none)
    bare = folders.join(cards.select("folder"), "folder", "left_anti").select(F.col("folder").alias("unit_id"), null.alias("asset"), F.lit("no card").alias("problem"), none)
    broken = found.where("problem is not null").join(names, "folder", "left").select(F.coalesce("unit_id", "folder").alias("unit_id"), null.alias("asset"), F.concat(F.lit("panel "), "panel", F.lit(": "), "problem").alias("problem"), none)
    units = asof_or_latest(good.drop("folder", "same", "problem", "file"), panels)
    return Loaded(units, panels, index, files, bad.unionByName(bare).unionByName(broken).distinct())


def read_corpus(spark: SparkSession, folder: str, unit_id: str) -> tuple[DataFrame, DataFrame]:
    """(index: unit_id, file, doc_id, day, kind, pos; files: unit_id, file, text). Without an index, or one that can't be parsed, the index is empty."""
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    files = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.lit(unit_id).alias("unit_id"), name.alias("file"), F.col("value").alias("text"))
    texts = spark.read.text(_paths(spark, f"{folder}/corpus_index.json") or [f"{folder}/*.txt"], wholetext=True)
    return _entries(texts.where(F.col("_metadata.file_name") == "corpus_index.json").select(F.lit(unit_id).alias("unit_id"), "value")), files


def read_adjustments(spark: SparkSession, pattern: str) -> DataFrame:
    """unit_id (the file's name), scenario, name, weight, asset, drift, vol_mult, established, tail_df of adjustment files."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    rows = spark.read.text(pattern, wholetext=True).select(stem.alias("unit_id"), F.from_json("value", SCENARIO_SCHEMA).alias("a"))
    rows = rows.select("unit_id", "a.tail_df", F.posexplode("a.scenarios").alias("scenario", "s"))
    assets = F.array_distinct(F.concat(F.coalesce(F.map_keys("s.drift"), F.array().cast("array<string>")), F.coalesce(F.map_keys("s.vol_mult"), F.array().cast("array<string>"))))
    rows = rows.select("unit_id", "scenario", "s", "tail_df", F.explode_outer(assets).alias("asset"))
    return rows.select("unit_id", "scenario", "s.name", "s.weight", "asset", F.try_element_at("s.drift", "asset").alias("drift"), F.try_element_at("s.vol_mult", "asset").alias("vol_mult"), F.coalesce("s.established", F.lit(False)).alias("established"), "tail_df")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a score of a summary CSV; of a unit with several such rows, the last of them.

    Rows are in order of the file's name, then of their place in it.
    """
    rows = spark.read.csv(path, header=True)
    cols = rows.columns
    scored = rows.withColumn("composite_score", F.expr("try_cast(composite_score as double)")).withColumn("at", F.struct(F.col("_metadata.file_name"), F.monotonically_increasing_id())).where("composite_score is not null")
    return scored.groupBy("unit_id").agg(F.max_by(F.struct(*cols), "at").alias("r")).select("r.*")


#: What a ledger holds of each asset and horizon, and of its scenarios.
LEDGER = (
    "struct<mode string, n_draws bigint, source string, scenarios array<struct<name string, weight double, n_draws bigint>>, "
    "assets map<string, struct<vol0 double, vol_lr double, horizons map<string, struct<steps int, sd_working double, q05 double, q50 double, q95 double>>>>>"
)


def ledger_cells(ledgers: DataFrame) -> DataFrame:
    """unit_id, asset, horizon, q05, q50, q95 of ledgers (unit_id, value: JSON); those that can't be parsed are passed over."""
    rows = ledgers.select("unit_id", F.from_json("value", LEDGER)["assets"].alias("a"))
    rows = rows.select("unit_id", F.explode("a").alias("asset", "x")).select("unit_id", "asset", F.explode("x.horizons").alias("h", "q"))
    return rows.select("unit_id", "asset", F.col("h").cast("int").alias("horizon"), "q.q05", "q.q50", "q.q95")


def read_ledgers(spark: SparkSession, path: str, file: str = "info.json") -> DataFrame:
    """The cells of the ledgers that sinks.write_ledgers has written."""
    return ledger_cells(read_unit_files(spark, path, file))


def read_ledger_files(spark: SparkSession, pattern: str) -> DataFrame:
    """The cells of loose ledger files; each is named by its unit."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return ledger_cells(spark.read.text(pattern, wholetext=True).select(stem.alias("unit_id"), "value"))


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    """Draws that sinks.write_draws has written."""
    return read_unit_files(spark, path, "forecast.parquet", "unit_id string, draw int, asset string, horizon int, value double")


def read_realized(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes that sinks.write_realized has written."""
    return read_unit_files(spark, path, "realized.parquet", "unit_id string, asset string, horizon int, value double")


def pick_units(units: DataFrame, part: str | None = None, limit: int | None = None) -> DataFrame:
    """Units whose id holds `part` in any case, in order of id, `limit` at most."""
    out = units if part is None else units.where(F.contains(F.lower("unit_id"), F.lit(part.lower())))
    out = out.orderBy("unit_id")
    return out if limit is None else out.limit(limit)
