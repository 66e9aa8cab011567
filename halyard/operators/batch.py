"""Forecasts of many units in one job. A unit that can't be forecast becomes a row that says why; the others go on.

Problems are found where the data are: an asset that no panel holds, too short a series, a card without a date, adjustments
that break their rules, draws that are not finite. Each is a row of unit_id, asset, problem, known; the unit's rows are
taken out by a semi join there, and nothing raises.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from halyard.config import DEFAULT, Config
from halyard.operators import evidence, series, simulate
from halyard.operators.series import by_freq
from halyard.sources.shared import settled

PROBLEM = "unit_id string, asset string, problem string, known array<string>"


@dataclass(frozen=True)
class Forecasts:
    """Draws of the units that could be forecast, why the others could not, and what the draws were made of."""

    draws: DataFrame
    quantiles: DataFrame
    problems: DataFrame
    simulation: simulate.Simulation
    stage: evidence.Stage
    config: Config
    #: Figures taken while the draws were written: rows, units with draws, bad (not finite).
    figures: dict[str, int]


def finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))


def given_stage(units: DataFrame, given: DataFrame) -> evidence.Stage:
    """What adjustment files say (see readers.read_adjustments), and the neutral scenario for units without one."""
    base = F.array().cast("array<string>")
    own = given.join(units.select("unit_id"), "unit_id", "left_semi")
    proof = F.first("evidence") if "evidence" in given.columns else base
    scenarios = own.groupBy("unit_id", "scenario").agg(F.first("name").alias("name"), F.first("weight").alias("weight"), F.bool_or("established").alias("established"), proof.alias("evidence"))
    bare = units.select("unit_id").join(own.select("unit_id").distinct(), "unit_id", "left_anti")
    neutral = bare.select("unit_id", F.lit(0).alias("scenario"), F.lit("baseline").alias("name"), F.lit(1.0).alias("weight"), F.lit(False).alias("established"), base.alias("evidence"))
    overlays = own.where("asset is not null").select("unit_id", "scenario", "asset", F.coalesce("drift", F.lit(0.0)).alias("drift"), F.coalesce("vol_mult", F.lit(1.0)).alias("vol_mult"))
    null = F.lit(None).cast("double")
    knobs = own.groupBy("unit_id").agg(F.max("tail_df").alias("tail_df")).select("unit_id", "tail_df", null.alias("stress_prob"), F.lit("file").alias("source"), F.lit(None).cast("string").alias("note"))
    knobs = knobs.unionByName(bare.select("unit_id", null.alias("tail_df"), null.alias("stress_prob"), F.lit("neutral").alias("source"), F.lit("no adjustments; neutral").alias("note")))
    return evidence.Stage(scenarios.unionByName(neutral), overlays, knobs)


def _rejected(given: DataFrame, units: DataFrame) -> DataFrame:
    """Units whose adjustment file breaks a rule, a row for each breach."""
    rules = evidence.violations(given.where("asset is not null").select("unit_id", "scenario", "asset", "vol_mult", "established"), units)
    held = units.select("unit_id", F.array_sort("assets").alias("known"))
    return rules.join(held, "unit_id").select("unit_id", "asset", F.concat(F.lit("adjustments: "), F.coalesce(F.concat(F.lit("scenario "), F.col("scenario").cast("string"), F.lit(": ")), F.lit("")), "problem").alias("problem"), "known")


def forecast(panels: DataFrame, units: DataFrame, n_draws: int = 2000, given: DataFrame | None = None, stage: evidence.Stage | None = None, config: Config = DEFAULT) -> Forecasts:
    """Forecasts every unit from its panels and what documents say.

    given: adjustment files; they go before what the text stage says. stage: see evidence.text_stage. Without either, units
    are neutral. Units in trouble are in .problems, and in no other table of the result.
    """
    empty = units.sparkSession.createDataFrame([], PROBLEM)
    for name in ("stress_prob", "tail_df"):
        units = units if name in units.columns else units.withColumn(name, F.lit(None).cast("double"))
    rows, assets = series.prepare(panels, units, config)
    found = series.problems(panels, units, assets)
    rejected = empty
    if given is not None:
        rejected = settled(_rejected(given, units), "rejected-adjustments")
        found = found.unionByName(rejected)
        files = given_stage(units, given)
        if stage is not None:
            own = given.select("unit_id").distinct()
            files = evidence.Stage(*[getattr(files, t).join(own, "unit_id", "left_semi").unionByName(getattr(stage, t).join(own, "unit_id", "left_anti")) for t in ("scenarios", "overlays", "knobs")])
        stage = files
    elif stage is None:
        stage = given_stage(units, units.limit(0).select("unit_id", F.lit(0).alias("scenario"), F.lit("").alias("name"), F.lit(1.0).alias("weight"), F.lit("").alias("asset"), F.lit(0.0).alias("drift"), F.lit(1.0).alias("vol_mult"), F.lit(False).alias("established"), F.lit(None).cast("double").alias("tail_df")))
    good = assets.where("sound").select("unit_id").distinct().join(rejected.select("unit_id").distinct(), "unit_id", "left_anti")
    sound = settled(units.drop("stress_prob", "tail_df").join(good, "unit_id", "left_semi").join(stage.knobs.select("unit_id", "tail_df", "stress_prob"), "unit_id", "left"), "sound-units")
    simulation = simulate.run(rows.join(good, "unit_id", "left_semi") if given is not None else rows, sound, n_draws, stage.scenarios, stage.overlays, config)
    seen = Observation("draws")
    bad = F.count_if(~finite(F.col("value")))
    draws = settled(simulation.draws.observe(seen, F.count("*").alias("rows"), bad.alias("bad")), "draws")
    figures = {k: int(v or 0) for k, v in seen.get.items()}
    if figures["bad"]:
        wild = draws.where(~finite(F.col("value"))).groupBy("unit_id").agg(F.min("asset").alias("asset"))
        wild = settled(wild.join(units.select("unit_id", F.array_sort("assets").alias("known")), "unit_id").select("unit_id", "asset", F.lit("a draw is not finite").alias("problem"), "known"), "wild-draws")
        draws, found = draws.join(wild.select("unit_id"), "unit_id", "left_anti"), found.unionByName(wild)
    problems = settled(found, "problems")
    return Forecasts(draws, settled(simulate.quantiles(draws), "quantiles"), problems, simulation, stage, config, figures)


def scenario_draws(f: Forecasts) -> DataFrame:
    """unit_id, scenario, n_draws: how many draws each scenario got, none included."""
    drawn = f.simulation.plan.groupBy("unit_id", "scenario").agg(F.count("*").alias("n"))
    named = f.stage.scenarios.join(f.simulation.units.select("unit_id"), "unit_id", "left_semi")
    return named.select("unit_id", "scenario").join(drawn, ["unit_id", "scenario"], "left").select("unit_id", "scenario", F.coalesce("n", F.lit(0)).alias("n_draws"))


def _map(key: str, value: str | Column) -> Column:
    return F.map_from_entries(F.collect_list(F.struct(F.col(key).alias("key"), (F.col(value) if isinstance(value, str) else value).alias("value"))))


def _sorted(name: str) -> Column:
    """A map column with its keys in order."""
    m = F.col(name)
    return F.map_from_entries(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("key"), F.element_at(m, k).alias("value")))).alias(name)


def ledger(f: Forecasts) -> DataFrame:
    """unit_id and a struct `info`: how the unit was forecast, its scenarios, and its assets with scale and quantiles.

    Everything that one unit has is small: its scenarios, assets and horizons.
    """
    c, sim = f.config, f.simulation
    done = f.quantiles.select("unit_id").distinct()
    width = sim.steps.join(sim.vol, ["unit_id", "asset", "step"]).select("unit_id", "asset", "horizon", F.col("step").alias("steps"), F.sqrt("cum_var").alias("sd_working"))
    cells = f.quantiles.join(width, ["unit_id", "asset", "horizon"]).groupBy("unit_id", "asset").agg(_map("horizon", F.struct("steps", "sd_working", "q05", "q50", "q95")).alias("horizons"))
    cells = cells.select("unit_id", "asset", _sorted("horizons"))
    facts = ["panel", "space", "freq", "anchor", "last_date", F.col("n").alias("n_increments"), "vol0", "vol_full", "vol_lr", "level_factor", F.col("prior_drift").alias("prior_drift_step")]
    assets = sim.spec.join(cells, ["unit_id", "asset"]).groupBy("unit_id").agg(_map("asset", F.struct(*facts, "horizons")).alias("assets"), F.max(F.when(F.col("freq") == "daily", 1).otherwise(0)).alias("any_daily"))
    assets = assets.select("unit_id", _sorted("assets"), "any_daily")
    said = f.stage.overlays.groupBy("unit_id", "scenario").agg(_map("asset", "drift").alias("drift"), _map("asset", "vol_mult").alias("vol_mult"))
    said = said.select("unit_id", "scenario", _sorted("drift"), _sorted("vol_mult"))
    moves = "map<string,double>"
    shares = simulate.scenario_ranges(f.stage.scenarios.select("unit_id", "scenario", "weight")).select("unit_id", "scenario", F.col("weight").alias("share"))
    lines = f.stage.scenarios.join(shares, ["unit_id", "scenario"]).join(scenario_draws(f), ["unit_id", "scenario"]).join(said, ["unit_id", "scenario"], "left")
    told = F.struct(
        "scenario", "name", F.col("share").alias("weight"), F.map_filter(F.coalesce("drift", F.create_map().cast(moves)), lambda k, v: F.abs(v) > 1e-9).alias("drift"),
        F.map_filter(F.coalesce("vol_mult", F.create_map().cast(moves)), lambda k, v: F.abs(v - 1) > 1e-9).alias("vol_mult"), "evidence", "established", "n_draws",
    )
    lines = lines.groupBy("unit_id").agg(_map("scenario", told).alias("scenarios")).select("unit_id", F.map_values(_sorted("scenarios")).alias("scenarios"))
    size = sim.pool.groupBy("unit_id", "asset", "pool").agg(F.count("*").alias("n"))
    of = [F.coalesce(F.min(F.when(F.col("pool") == p, F.col("n"))), F.lit(0)).alias(f"{p}_rows") for p in ("recent", "full", "stress")]
    # of the stress pool the least counts, of which an asset may have none
    pooled = size.groupBy("unit_id").agg(*of, F.count_if(F.col("pool") == "stress").alias("stressed"))
    pooled = pooled.join(sim.mode.select("unit_id", "n_assets"), "unit_id").withColumn("stress_rows", F.when(F.col("stressed") == F.col("n_assets"), F.col("stress_rows")).otherwise(0))
    longest = sim.steps.groupBy("unit_id").agg(F.max("step").alias("path_steps"))
    plan = sim.plan.groupBy("unit_id").agg(F.count("*").cast("int").alias("n_draws"))
    freq = F.when((F.col("n_freq") == 1) & (F.col("any_daily") == 0), "monthly").otherwise("daily")
    out = assets.join(done, "unit_id", "left_semi").join(sim.mode.drop("n_assets"), "unit_id").join(lines, "unit_id").join(pooled.drop("n_assets"), "unit_id").join(longest, "unit_id").join(plan, "unit_id")
    out = out.join(f.stage.knobs.select("unit_id", "tail_df", F.col("stress_prob").alias("asked_stress"), "source", "note"), "unit_id").withColumn("freq", freq)
    p = F.when(F.col("stress_rows") >= c.min_pool_rows, F.coalesce("asked_stress", F.lit(c.p_stress))).otherwise(0.0)
    info = F.struct(
        F.when(F.col("joint"), "joint-bootstrap").otherwise("independent-bootstrap").alias("mode"), "freq", "aligned_rows", F.col("recent_rows").alias("pool_recent_rows"), F.col("full_rows").alias("pool_full_rows"),
        F.lit(c.w_recent).alias("w_recent"), by_freq(c.block_daily, c.block_monthly).alias("block_mean"), by_freq(c.tau_daily, c.tau_monthly).alias("vol_revert_tau"), p.alias("p_stress"), "stress_rows",
        F.lit(c.vol_uncertainty).alias("vol_uncertainty"), "path_steps", "n_draws", "scenarios", "tail_df", "source", F.array_compact(F.array("note")).alias("notes"), "assets",
    )
    return out.select("unit_id", info.alias("info"))


def meta(f: Forecasts, version: str = "1", report_name: str = "rationale.md") -> DataFrame:
    """unit_id and `meta`, JSON that says what the unit's draws are."""
    told = ledger(f).select("unit_id", F.col("info.mode").alias("mode"), F.col("info.n_draws").alias("n_draws"), F.col("info.source").alias("source"))
    rows = f.simulation.units.join(told, "unit_id")
    agent = F.struct(F.lit(version).alias("version"), F.lit(f.config.seed).alias("seed"), F.col("source").alias("text_source"))
    method = F.struct(F.lit(report_name).alias("file"), F.concat(F.lit("halyard "), F.lit(version), F.lit(": "), "mode", F.lit(", scenario mixture, text="), "source").alias("method"))
    cols = ["unit_id", F.col("asof").cast("string").alias("asof"), F.lit("samples").alias("representation"), F.col("assets").alias("asset_ids"), "horizons", "n_draws", F.col("target_type").alias("target"), method.alias("rationale"), agent.alias("agent")]
    return rows.select("unit_id", F.to_json(F.struct(*cols)).alias("meta"))
