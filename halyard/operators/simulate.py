"""Joint block-bootstrap simulation as joins and windows; random numbers are hashed counters, so any partitioning agrees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.config import DEFAULT, Config
from halyard.functions.columns import add_business_days, chi_square, normal, uniform
from halyard.operators.series import KEYS, asset_rows, asset_spec, by_freq
from halyard.sources.shared import settled


def horizon_steps(spec: DataFrame, units: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """unit_id, asset, horizon, step: business days, or months from the last row to what is published by then."""
    asked = units.select("unit_id", "asof", F.explode("horizons").alias("horizon"))
    due = F.date_sub(add_business_days(F.col("asof"), F.col("horizon")), config.lag_days)
    last = F.col("last_date")
    months = (F.year(due) - F.year(last)) * 12 + (F.month(due) - F.month(last)) + (F.day(due) - F.day(last)) / 30.0
    step = F.when(F.col("freq") == "daily", F.col("horizon")).otherwise(F.greatest(F.lit(1), F.bround(months).cast("int")))
    return spec.select(*KEYS, "freq", "last_date").join(asked, "unit_id").select(*KEYS, "horizon", step.cast("int").alias("step"))


def vol_path(spec: DataFrame, steps: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """unit_id, asset, step, sigma, cum_var for every step of the unit's longest path."""
    longest = steps.groupBy("unit_id").agg(F.max("step").alias("longest"))
    rows = spec.join(longest, "unit_id").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("longest"))))
    lr2 = F.col("vol_lr") * F.col("vol_lr")
    start = F.greatest("vol0", config.vol0_floor * F.col("vol_lr"))
    var = lr2 + (start * start - lr2) * F.exp(-F.col("step") / by_freq(config.tau_daily, config.tau_monthly))
    rows = rows.select(*KEYS, "step", (config.width * F.sqrt(F.greatest(var, F.lit(1e-18)))).alias("sigma"))
    return rows.withColumn("cum_var", F.sum(F.col("sigma") * F.col("sigma")).over(asset_rows().orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))


def aligned(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """rows with n_assets of their unit, complete (every asset has a z on the date) and shaken (any of them is in stress)."""
    size = spec.groupBy("unit_id").agg(F.count("*").alias("n_assets"))
    day = Window.partitionBy("unit_id", "date")
    out = rows.where("z is not null").join(size, "unit_id")
    return out.withColumn("complete", F.count("*").over(day) == F.col("n_assets")).withColumn("shaken", F.max("stress").over(day))


def modes(together: DataFrame, spec: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """unit_id, n_assets, n_freq, aligned_rows, joint: one index drives all assets of the unit."""
    dates = together.groupBy("unit_id").agg(F.count_distinct(F.when(F.col("complete"), F.col("date"))).alias("aligned_rows"))
    out = spec.groupBy("unit_id").agg(F.count("*").alias("n_assets"), F.count_distinct("freq").alias("n_freq")).join(dates, "unit_id", "left").fillna(0, ["aligned_rows"])
    return out.withColumn("joint", (F.col("n_assets") == 1) | ((F.col("n_freq") == 1) & (F.col("aligned_rows") >= config.min_joint_rows)))


def pools(together: DataFrame, mode: DataFrame, spec: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Shock pools: unit_id, pool (full, recent, stress), salt, asset, row_id, n, shock.

    full and recent have mean 0 and deviation 1 for each asset; stress holds raw moves times the level factor. salt is '*'
    where one index serves all assets, else the asset.
    """
    rows = together.join(mode.select("unit_id", "joint"), "unit_id").join(spec.select(*KEYS, "level_factor"), KEYS).where("complete or not joint")
    rows = rows.withColumn("salt", F.when(F.col("joint"), F.lit("*")).otherwise(F.col("asset"))).withColumn("shaken", F.when(F.col("joint"), F.col("shaken")).otherwise(F.col("stress")))
    rows = rows.withColumn("back", F.row_number().over(asset_rows().orderBy(F.desc("date"))))
    recent = rows.where(F.col("back") <= by_freq(config.recent_daily, config.recent_monthly)).withColumn("pool", F.lit("recent")).withColumn("raw", F.col("z"))
    full = rows.withColumn("pool", F.lit("full")).withColumn("raw", F.col("z"))
    hard = rows.where("shaken").withColumn("pool", F.lit("stress")).withColumn("raw", F.col("x") * F.col("level_factor"))
    every = full.unionByName(recent).unionByName(hard)
    each = Window.partitionBy("unit_id", "asset", "pool")
    every = every.withColumn("n", F.count("*").over(each)).withColumn("row_id", F.row_number().over(each.orderBy("date")) - 1)
    sd = F.when(F.col("n") > 2, F.nullif(F.stddev_samp("raw").over(each), F.lit(0.0)))
    shock = F.when(F.col("pool") == "stress", F.col("raw")).otherwise((F.col("raw") - F.avg("raw").over(each)) / F.coalesce(sd, F.lit(1.0)))
    return every.select("unit_id", "pool", "salt", "asset", "row_id", "n", shock.alias("shock"))


def scenario_ranges(scenarios: DataFrame) -> DataFrame:
    """unit_id, scenario, low, high: each scenario's share of [0, 1). Negative weights count as 0; with none left, all count alike.

    A range begins where the one before ends, so that they leave no gap.
    """
    unit = Window.partitionBy("unit_id")
    w = F.greatest(F.col("weight"), F.lit(0.0))
    out = scenarios.withColumn("w", F.when(F.sum(w).over(unit) > 0, w).otherwise(1.0))
    out = out.withColumn("w", F.col("w") / F.sum("w").over(unit))
    high = F.sum("w").over(unit.orderBy("scenario").rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("scenario").over(unit) == F.col("scenario")
    out = out.withColumn("high", F.when(last, 1.0).otherwise(high))
    return out.select("unit_id", "scenario", F.col("w").alias("weight"), F.coalesce(F.lag("high").over(unit.orderBy("scenario")), F.lit(0.0)).alias("low"), "high")


def with_neutral(scenarios: DataFrame, units: DataFrame) -> DataFrame:
    """unit_id, scenario, weight, and the neutral scenario for every unit that has none."""
    rows = scenarios.select("unit_id", F.col("scenario").cast("int").alias("scenario"), F.col("weight").cast("double").alias("weight"))
    return rows.unionByName(neutral(units.join(rows, "unit_id", "left_anti")))


def tail_factor(config: Config = DEFAULT) -> Column:
    """One factor for each draw: sqrt(df / chi-square) where the unit has tail_df, else 1.

    A chi-square of whole degrees of freedom up to 8 is a sum of squares, others are drawn by rejection.
    """
    squares = [F.pow(normal(config.seed, f"chi{k}", "unit_id", "draw"), F.lit(2)) for k in range(8)]
    chi = sum((F.when(F.col("tail_df") > k, x).otherwise(0.0) for k, x in enumerate(squares)), F.lit(0.0))
    whole = (F.col("tail_df") <= 8) & (F.col("tail_df") == F.floor("tail_df"))
    chi = F.when(whole, chi).otherwise(chi_square(config.seed, F.col("tail_df"), "unit_id", "draw"))
    return F.when(F.col("tail_df").isNull(), 1.0).otherwise(F.sqrt(F.col("tail_df") / chi))


def draw_count(n_draws: int) -> Column:
    """How many draws a unit gets: what is asked for, its minimum and 200, but 20,000 at most."""
    return F.least(F.greatest(F.lit(n_draws), F.col("n_draws_min"), F.lit(200)), F.lit(20_000))


def draw_plan(units: DataFrame, scenarios: DataFrame, pool: DataFrame, spec: DataFrame, n_draws: int, config: Config = DEFAULT) -> DataFrame:
    """unit_id, draw, scenario, pool, vol_factor, tail. Stress is drawn only where every pool of the unit has rows enough.

    Units without a scenario draw the neutral one. units: also stress_prob and tail_df, null where the defaults hold.
    """
    ready = pool.where("pool = 'stress'").groupBy(*KEYS).agg(F.count("*").alias("rows"))
    ready = spec.select(*KEYS).join(ready, KEYS, "left").groupBy("unit_id").agg((F.min(F.coalesce("rows", F.lit(0))) >= config.min_pool_rows).alias("ready"))
    n = draw_count(n_draws)
    draws = units.select("unit_id", "stress_prob", "tail_df", F.explode(F.sequence(F.lit(0), n - 1)).alias("draw")).join(ready, "unit_id")
    draws = draws.withColumn("u", uniform(config.seed, "scenario", "unit_id", "draw"))
    draws = draws.join(scenario_ranges(with_neutral(scenarios, units)), "unit_id").where("u >= low and u < high")
    p = F.when(F.col("ready"), F.coalesce("stress_prob", F.lit(config.p_stress))).otherwise(0.0)
    kind = F.when(uniform(config.seed, "regime", "unit_id", "draw") < p, "stress").when(uniform(config.seed, "recent", "unit_id", "draw") < config.w_recent, "recent").otherwise("full")
    v = config.vol_uncertainty
    return draws.select("unit_id", "draw", "scenario", kind.alias("pool"), F.exp(v * normal(config.seed, "vol", "unit_id", "draw") - 0.5 * v * v).alias("vol_factor"), tail_factor(config).alias("tail"))


def block_index(plan: DataFrame, pool: DataFrame, spec: DataFrame, steps: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """unit_id, draw, scenario, pool, vol_factor, salt, step, n, row_id: circular blocks of geometric length.

    A step begins a block with probability 1 / mean; the row is that of the block's start, moved on by the steps since.
    """
    sizes = _salts(pool, spec)[0]
    longest = steps.groupBy("unit_id").agg(F.max("step").alias("longest"))
    rows = plan.join(sizes, ["unit_id", "pool"]).join(longest, "unit_id").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("longest"))))
    keys = ("unit_id", "draw", "salt", "step")
    begins = (F.col("step") == 1) | (uniform(config.seed, "jump", *keys) < F.lit(1.0) / by_freq(config.block_daily, config.block_monthly))
    rows = rows.withColumn("begins", begins).withColumn("at", F.when(F.col("begins"), F.floor(uniform(config.seed, "start", *keys) * F.col("n")))).withColumn("from", F.when(F.col("begins"), F.col("step")))
    path = Window.partitionBy("unit_id", "draw", "salt").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    start, since = F.last("at", ignorenulls=True).over(path), F.last("from", ignorenulls=True).over(path)
    return rows.withColumn("row_id", F.pmod(start + F.col("step") - since, F.nullif(F.col("n"), F.lit(0)))).drop("begins", "at", "from", "longest")


def paths(index: DataFrame, pool: DataFrame, spec: DataFrame, vol: DataFrame, steps: DataFrame, overlays: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """unit_id, draw, asset, step, inc, cum: increments with regime, scale, drift and scenario, and their running sum.

    overlays: unit_id, scenario, asset, drift, vol_mult; what is missing is 0 and 1. Pools of fewer than 30 rows give way
    to normal shocks.
    """
    members = _salts(pool, spec)[1]
    rows = index.join(members, ["unit_id", "salt"]).join(pool.drop("n", "salt"), ["unit_id", "pool", "asset", "row_id"], "left")
    first = steps.groupBy(*KEYS).agg(F.min_by("step", "horizon").alias("first_step"))
    first = first.join(vol.withColumnRenamed("step", "first_step").select(*KEYS, "first_step", F.sqrt("cum_var").alias("first_sd")), [*KEYS, "first_step"])
    per_asset = spec.select(*KEYS, "prior_drift").join(first, KEYS)
    rows = rows.join(vol.select(*KEYS, "step", "sigma"), [*KEYS, "step"]).join(per_asset, KEYS).join(overlays, ["unit_id", "scenario", "asset"], "left")
    shock = F.when(F.col("n") >= config.min_pool_rows, F.col("shock")).otherwise(normal(config.seed, "gauss", "unit_id", "draw", "asset", "step"))
    base = F.when(F.col("pool") == "stress", F.col("shock")).otherwise(shock * F.col("tail") * F.col("sigma") * F.col("vol_factor"))
    inc = base * F.coalesce("vol_mult", F.lit(1.0)) + F.col("prior_drift") + F.coalesce("drift", F.lit(0.0)) * F.col("first_sd") / F.col("first_step")
    rows = rows.select("unit_id", "draw", "asset", "step", inc.alias("inc"))
    return rows.withColumn("cum", F.sum("inc").over(Window.partitionBy("unit_id", "draw", "asset").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))


def samples(walked: DataFrame, spec: DataFrame, steps: DataFrame) -> DataFrame:
    """unit_id, draw, asset, horizon, value in the units of the series."""
    rows = walked.join(steps, [*KEYS, "step"]).join(spec.select(*KEYS, "space", "anchor"), KEYS)
    value = F.when(F.col("space") == "log", F.col("anchor") * F.exp("cum")).when(F.col("space") == "diff", F.col("anchor") + F.col("cum")).otherwise(F.col("cum"))
    return rows.select("unit_id", F.col("draw").cast("int").alias("draw"), "asset", F.col("horizon").cast("int").alias("horizon"), value.alias("value"))


def _salts(pool: DataFrame, spec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unit_id, pool, salt, n, freq: what one index walks through; unit_id, salt, asset: the assets that it drives)."""
    members = pool.select("unit_id", "salt", "asset").distinct()
    freq = members.join(spec.select(*KEYS, "freq"), KEYS).groupBy("unit_id", "salt").agg(F.first("freq").alias("freq"))
    sizes = pool.groupBy("unit_id", "salt", "pool").agg(F.max("n").alias("n")).join(freq, ["unit_id", "salt"])
    # an asset without a shock walks alone, on normal ones
    bare = spec.join(pool.select(*KEYS).distinct(), KEYS, "left_anti")
    alone = bare.select("unit_id", F.col("asset").alias("salt"), F.explode(F.array(F.lit("full"), F.lit("recent"))).alias("pool"), F.lit(0).cast("bigint").alias("n"), "freq")
    return sizes.unionByName(alone), members.unionByName(bare.select("unit_id", F.col("asset").alias("salt"), "asset"))


def walks(plan: DataFrame, pool: DataFrame, spec: DataFrame, vol: DataFrame, steps: DataFrame, overlays: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """unit_id, draw, asset, horizon, value: what samples(paths(block_index(...))) gives, with a path as an array in one row.

    Steps never become rows: a draw's index is folded into an array, which each asset's row uses to pick shocks out of its
    pool, an array too, and to sum them up. So draws x steps are neither shuffled nor sorted; what is joined are draws, and
    small tables of units and assets.
    """
    sizes, members = _salts(pool, spec)
    shocks = pool.groupBy("unit_id", "pool", "asset").agg(F.array_sort(F.collect_list(F.struct("row_id", "shock"))).alias("s")).select("unit_id", "pool", "asset", F.col("s.shock").alias("shocks"))
    scale = vol.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("step", "sigma", "cum_var"))).alias("v"))
    ends = steps.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("horizon", "step"))).alias("ends"))
    facts = spec.select(*KEYS, "prior_drift", "space", "anchor").join(ends, KEYS).join(scale, KEYS)
    first = F.col("ends")[0]["step"]
    facts = facts.select(*KEYS, "prior_drift", "space", "anchor", "ends", F.col("v.sigma").alias("sigmas"), (F.sqrt(F.element_at("v", first)["cum_var"]) / first).alias("drift_unit"))
    shocks, facts, sizes, members = (settled(df, name) for df, name in ((shocks, "pool-arrays"), (facts, "asset-arrays"), (sizes, "salt-sizes"), (members, "salt-members")))

    longest = steps.groupBy("unit_id").agg(F.max("step").alias("longest"))
    rows = plan.join(sizes, ["unit_id", "pool"]).join(longest, "unit_id")
    keys = ("unit_id", "draw", "salt")
    chance = F.lit(1.0) / by_freq(config.block_daily, config.block_monthly)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("path"))

    def move(done: Column, k: Column) -> Column:
        begins = (k == 1) | (uniform(config.seed, "jump", *keys, k) < chance)
        at = F.when(begins, F.floor(uniform(config.seed, "start", *keys, k) * F.col("n"))).otherwise(F.pmod(done["at"] + 1, F.nullif(F.col("n"), F.lit(0)))).cast("bigint")
        return F.struct(at.alias("at"), F.array_append(done["path"], at).alias("path"))

    index = F.aggregate(F.sequence(F.lit(1), F.col("longest")), start, move, lambda done: done["path"])
    rows = rows.select("unit_id", "draw", "scenario", "pool", "vol_factor", "tail", "salt", "n", index.alias("index"))
    rows = rows.join(members, ["unit_id", "salt"]).join(facts, KEYS).join(overlays, ["unit_id", "scenario", "asset"], "left").join(shocks, ["unit_id", "pool", "asset"], "left")
    drift = F.col("prior_drift") + F.coalesce("drift", F.lit(0.0)) * F.col("drift_unit")
    width = F.coalesce("vol_mult", F.lit(1.0))

    def step(done: Column, k: Column) -> Column:
        drawn = F.get(F.col("shocks"), F.element_at("index", k))
        shock = F.when(F.col("n") >= config.min_pool_rows, drawn).otherwise(normal(config.seed, "gauss", "unit_id", "draw", "asset", k))
        base = F.when(F.col("pool") == "stress", drawn).otherwise(shock * F.col("tail") * F.element_at("sigmas", k) * F.col("vol_factor"))
        total = done["cum"] + (base * width + drift)
        return F.struct(total.alias("cum"), F.array_append(done["path"], total).alias("path"))

    begin = F.struct(F.lit(0.0).alias("cum"), F.array().cast("array<double>").alias("path"))
    cum = F.aggregate(F.sequence(F.lit(1), F.size("index")), begin, step, lambda done: done["path"])
    rows = rows.select("unit_id", F.col("draw").cast("int").alias("draw"), "asset", "space", "anchor", cum.alias("cum"), F.explode("ends").alias("end"))
    x = F.element_at("cum", F.col("end.step"))
    value = F.when(F.col("space") == "log", F.col("anchor") * F.exp(x)).when(F.col("space") == "diff", F.col("anchor") + x).otherwise(x)
    return rows.select("unit_id", "draw", "asset", F.col("end.horizon").cast("int").alias("horizon"), value.alias("value"))


def neutral(units: DataFrame) -> DataFrame:
    return units.select("unit_id", F.lit(0).alias("scenario"), F.lit(1.0).alias("weight"))


@dataclass(frozen=True)
class Simulation:
    """Draws and the tables that they were made of, all keyed by unit_id."""

    units: DataFrame
    spec: DataFrame
    steps: DataFrame
    vol: DataFrame
    mode: DataFrame
    pool: DataFrame
    plan: DataFrame
    draws: DataFrame


def run(rows: DataFrame, units: DataFrame, n_draws: int = 2000, scenarios: DataFrame | None = None, overlays: DataFrame | None = None, config: Config = DEFAULT) -> Simulation:
    """Simulates every unit from prepared rows (see series.prepared). Units without scenarios have the neutral one."""
    for name, kind in (("stress_prob", "double"), ("tail_df", "double")):
        units = units if name in units.columns else units.withColumn(name, F.lit(None).cast(kind))
    spec = settled(asset_spec(rows, config), "spec")
    steps = settled(horizon_steps(spec, units, config), "steps")
    vol = vol_path(spec, steps, config)
    together = aligned(rows, spec)
    mode = modes(together, spec, config)
    pool = settled(pools(together, mode, spec, config), "pools")
    scenarios = neutral(units) if scenarios is None else scenarios
    if overlays is None:
        overlays = spec.limit(0).select("unit_id", F.lit(0).alias("scenario"), "asset", F.lit(0.0).alias("drift"), F.lit(1.0).alias("vol_mult"))
    plan = settled(draw_plan(units, scenarios, pool, spec, n_draws, config), "draw-plan")
    draws = walks(plan, pool, spec, settled(vol, "vol-path"), steps, overlays, config)
    return Simulation(units, spec, steps, vol, mode, pool, plan, draws)


def simulate(rows: DataFrame, units: DataFrame, n_draws: int = 2000, scenarios: DataFrame | None = None, overlays: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Draws of every unit."""
    return run(rows, units, n_draws, scenarios, overlays, config).draws


def quantiles(drawn: DataFrame) -> DataFrame:
    """Exact interpolated quantiles of each asset and horizon."""
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = drawn.groupBy("unit_id", "asset", "horizon").agg(q.alias("q"), F.count("*").alias("n"))
    return out.select("unit_id", "asset", "horizon", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("q05", "q50", "q95"))])
