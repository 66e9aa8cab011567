"""Draws, ledgers, reports, outcomes and summaries as files, one for each unit (see unit_files) or for a run."""

from __future__ import annotations

import json
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.operators import batch, calibrate
from halyard.operators.batch import Forecasts
from halyard.sources.files import open_fs
from halyard.sources.unit_files import write_unit_files


def write_draws(drawn: DataFrame, units: DataFrame, path: str) -> None:
    """draw, asset, horizon, value for each unit, in order of draw, asset and horizon. Values that are not finite stop the write."""
    place = units.select("unit_id", F.posexplode("assets").alias("pos", "asset"))
    value = F.when(batch.finite(F.col("value")), F.col("value")).otherwise(F.raise_error(F.lit("a draw is not finite")))
    rows = drawn.withColumn("value", value).join(place, ["unit_id", "asset"])
    rows = rows.repartition("unit_id").sortWithinPartitions("unit_id", "draw", "pos", "horizon")
    write_unit_files(rows.select("unit_id", F.col("draw").cast("int").alias("draw"), "asset", F.col("horizon").cast("int").alias("horizon"), "value"), path, "forecast.parquet", placed=True)


def write_texts(rows: DataFrame, value: str, path: str, file: str) -> None:
    """A text of each unit as a file of its own."""
    write_unit_files(rows.select("unit_id", F.col(value).alias("value")), path, file)


def inside(path: str, folder: str) -> bool:
    """Whether a path is a folder or lies below it."""
    (a, x), (b, y) = open_fs(path), open_fs(folder)
    return a.type_name == b.type_name and (x + "/").startswith(y + "/")


def write_ledgers(f: Forecasts, path: str, beside: str | None = None) -> None:
    """Each unit's ledger as info.json. It must not lie where the draws are (beside)."""
    if beside is not None and inside(path, beside):
        raise ValueError("ledgers must not lie in the folder of the draws")
    write_texts(batch.ledger(f).select("unit_id", F.to_json("info").alias("text")), "text", path, "info.json")


def _lines(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), "\n")


def _g(x: Column) -> Column:
    return F.format_string("%.6g", x)


def report(f: Forecasts, docs: DataFrame | None = None, cards: DataFrame | None = None) -> DataFrame:
    """unit_id and a Markdown report: method, anchors and scale, quantiles, scenarios with their draws, regime, documents and what they did.

    docs: unit_id, doc_id, day, kind. cards: as in `evidence`; of each, up to three facts if it has a column fact_list.
    """
    rows = batch.ledger(f).join(f.simulation.units.select("unit_id", "asof", "target_type", "value_unit", F.col("assets").alias("asked"), "horizons"), "unit_id")
    base = F.array().cast("array<struct<day string, doc_id string, kind string>>")
    if docs is None:
        rows = rows.withColumn("docs", base)
    else:
        listed = docs.groupBy("unit_id").agg(F.array_sort(F.collect_set(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("day", "doc_id", "kind")]))).alias("docs"))
        rows = rows.join(listed, "unit_id", "left").withColumn("docs", F.coalesce("docs", base))
    facts = F.slice("fact_list", 1, 3) if cards is not None and "fact_list" in cards.columns else F.array().cast("array<string>")
    if cards is None:
        rows = rows.withColumn("read", F.array().cast("array<string>"))
    else:
        said = F.concat("asset", F.lit(": "), F.coalesce("direction", F.lit("0")), F.lit(" ("), F.coalesce("uncertainty", F.lit("same")), F.lit(")"))
        each = cards.groupBy("unit_id", "doc_id").agg(F.first("relevance").alias("relevance"), F.first(facts).alias("facts"), F.array_join(F.array_sort(F.collect_list(said)), "; ").alias("said"))
        line = F.format_string("| `%s` | %s | %s | %s |", "doc_id", F.coalesce("relevance", F.lit("")), F.substring(F.coalesce(F.nullif(F.array_join("facts", "; "), F.lit("")), F.lit("none")), 1, 200), F.substring("said", 1, 160))
        rows = rows.join(each.groupBy("unit_id").agg(F.array_sort(F.collect_list(line)).alias("read")), "unit_id", "left").withColumn("read", F.coalesce("read", F.array().cast("array<string>")))
    i = F.col("info")
    assets = F.map_entries(i["assets"])
    anchors = _lines(assets, lambda e: F.format_string("| %s | %s | %s | %s | %s | %s | %s | %s | %s |", e["key"], e["value"]["panel"], e["value"]["space"], _g(e["value"]["anchor"]), e["value"]["last_date"].cast("string"), _g(e["value"]["vol0"]), _g(e["value"]["vol_lr"]), _g(e["value"]["vol_full"]), _g(e["value"]["prior_drift_step"])))
    cells = F.array_join(F.flatten(F.transform(assets, lambda e: F.transform(F.map_entries(e["value"]["horizons"]), lambda h: F.format_string("| %s | %d | %d | %s | %s | %s | %s |", e["key"], h["key"], h["value"]["steps"], _g(h["value"]["sd_working"]), _g(h["value"]["q05"]), _g(h["value"]["q50"]), _g(h["value"]["q95"]))))), "\n")

    def told(m: Column, form: str, none: str) -> Column:
        text = F.array_join(F.transform(F.map_entries(m), lambda e: F.format_string(form, e["key"], e["value"])), ", ")
        return F.when(text == "", none).otherwise(text)

    scenarios = _lines(i["scenarios"], lambda s: F.format_string("| %s | %.2f | %d | %s | %s | %s | %s |", s["name"], s["weight"], s["n_draws"], told(s["drift"], "%s: %+.2f", "none"), told(s["vol_mult"], "%s: x%.2f", "none"), F.when(s["established"], "yes").otherwise("no"), F.when(F.size(s["evidence"]) > 0, F.array_join(s["evidence"], ", ")).otherwise("none")))
    unmoved = F.forall(i["scenarios"], lambda s: (F.size(s["drift"]) == 0) & (F.size(s["vol_mult"]) == 0))
    documents = F.when(F.size("docs") == 0, "No document was at hand.").otherwise(_lines(F.col("docs"), lambda d: F.concat(F.lit("- `"), d["doc_id"], F.lit("` "), d["day"], F.lit(" "), d["kind"])))
    read = F.when(F.size("read") == 0, "").otherwise(F.concat(F.lit("\n\n| document | relevance | facts | read of assets |\n|-|-|-|-|\n"), F.array_join("read", "\n")))
    effect = F.when(unmoved & (F.size("docs") > 0), "The documents moved nothing: drift and width are those of the series alone.").when(unmoved, "Drift and width are those of the series alone.").otherwise("The scenarios above rest on the documents they name. One that is not established may move or widen a forecast, never narrow it.")
    joined = F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in (
        "# Forecast of ", F.col("unit_id"), "\n\nAs of ", F.col("asof").cast("string"), ": ", i["n_draws"].cast("string"), " joint draws of ", F.array_join("asked", ", "), " at ", F.array_join(F.transform("horizons", lambda h: h.cast("string")), ", "),
        " business days; target ", F.col("target_type"), F.when(F.col("value_unit") == "", "").otherwise(F.concat(F.lit(" in "), "value_unit")), ".\n\n## Method\n\n", i["mode"], " of ", i["freq"], " increments over ", i["path_steps"].cast("string"), " steps, in blocks of ", i["block_mean"].cast("string"),
        " on average. Shocks come from ", i["pool_recent_rows"].cast("string"), " recent rows (weight ", F.format_string("%.2f", i["w_recent"]), ") and ", i["pool_full_rows"].cast("string"), " in all; their scale starts at today's volatility and reverts to the long run within about ", F.format_string("%.0f", i["vol_revert_tau"]), " steps.",
        "\n\n## Anchors and scale\n\n| asset | panel | space | anchor | last row | volatility now | long run | whole sample | drift a step |\n|-|-|-|-|-|-|-|-|-|\n", anchors, "\n\n| asset | horizon | steps | deviation | 5 % | 50 % | 95 % |\n|-|-|-|-|-|-|-|\n", cells,
        "\n\n## Scenarios\n\n| scenario | weight | draws | drift | width | established | evidence |\n|-|-|-|-|-|-|-|\n", scenarios, "\n\nOf the paths, ", F.format_string("%.0f", 100 * i["p_stress"]), " % come from the ", i["stress_rows"].cast("string"), " rows of stress; the others have a scale factor of deviation ", F.format_string("%.2f", i["vol_uncertainty"]), ".",
        F.when(i["tail_df"].isNotNull(), F.concat(F.lit(" Tails: Student t with "), F.format_string("%.3g", i["tail_df"]), F.lit(" degrees of freedom."))).otherwise(""), F.when(F.size(i["notes"]) == 0, "").otherwise(F.concat(F.lit("\n\n"), _lines(i["notes"], lambda n: F.concat(F.lit("- "), n)))),
        "\n\n## Documents\n\n", documents, read, "\n\n", effect, "\n",
    )])
    return rows.select("unit_id", joined.alias("report"))


def write_forecasts(f: Forecasts, path: str, info: str | None = None, docs: DataFrame | None = None, cards: DataFrame | None = None) -> None:
    """All that a run gives: forecast.parquet, forecast_meta.json and rationale.md of each unit, their problems, and ledgers in `info`."""
    if info is not None and inside(info, path):
        raise ValueError("ledgers must not lie in the folder of the draws")
    write_draws(f.draws, f.simulation.units, path)
    write_texts(batch.meta(f), "meta", path, "forecast_meta.json")
    write_texts(report(f, docs, cards), "report", path, "rationale.md")
    said = f.problems.groupBy("unit_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("asset", "problem", "known")))).alias("text"))
    write_texts(said, "text", path, "problems.json")
    if info is not None:
        write_ledgers(f, info)


def write_realized(outcomes: DataFrame, path: str) -> None:
    rows = outcomes.select("unit_id", "asset", F.col("horizon").cast("int").alias("horizon"), F.col("value").cast("double").alias("value"))
    write_unit_files(rows, path, "realized.parquet", ("asset", "horizon"))


def void_units(units: DataFrame, outcomes: DataFrame) -> DataFrame:
    """unit_id of the units without an outcome."""
    return units.select("unit_id").join(outcomes.select("unit_id").distinct(), "unit_id", "left_anti")


def outcome_report(panels: DataFrame, units: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of what an outcome run found: units, realized, void (units without), panels, series, rows, first, last, least, largest, of the pooled rows."""
    done = outcomes.select("unit_id").distinct().withColumn("done", F.lit(1))
    asked = units.select("unit_id").join(done, "unit_id", "left").agg(F.count("*").alias("units"), F.count("done").alias("realized"))
    pooled = calibrate.pooled(panels)
    stats = pooled.agg(F.count_distinct("panel").alias("panels"), F.count_distinct("panel", "asset").alias("series"), F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"), F.min("value").alias("least"), F.max("value").alias("largest"))
    both = asked.withColumn("k", F.lit(1)).join(stats.withColumn("k", F.lit(1)), "k").drop("k")  # a row each
    return both.select("units", "realized", (F.col("units") - F.col("realized")).alias("void"), "panels", "series", "rows", "first", "last", "least", "largest")


def write_outcome_report(report_row: DataFrame, path: str) -> None:
    """`_report.json` in path, put in place in one step."""
    fs, base = open_fs(path)
    fs.create_dir(base, recursive=True)
    aside = f"{base}/_report.json.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside, compression=None) as out:
        out.write(json.dumps(report_row.first().asDict(), default=str, indent=2).encode())
    fs.move(aside, f"{base}/_report.json")


def read_outcome_report(path: str) -> dict | None:
    fs, base = open_fs(path)
    if fs.get_file_info(f"{base}/_report.json").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{base}/_report.json") as f:
        return json.loads(f.read())


def write_summary(rows: list[DataFrame], path: str) -> None:
    """Rows of several runs, columns in order of appearance, as CSV."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    out.write.csv(path, header=True)
