"""Outcomes, calibration of draws against them, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.config import DEFAULT, Config
from halyard.functions.columns import add_business_days

CALIBRATION = ("in50", "in90", "below05", "above95", "below01", "above99", "z_mean")


def pooled(panels: DataFrame) -> DataFrame:
    """All units' rows of a panel together; values that differ on a date give way to their median."""
    return panels.groupBy("panel", "asset", "date").agg(F.expr("median(value)").alias("value"))


def realized(panels: DataFrame, units: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """unit_id, asset, horizon, value: the h-th row after the as-of, a return summed over them, or the month due by then.

    An asset is taken from the first declared panel that lists it; if none does, from the first by name of the unit's panels. A unit with a horizon without an outcome, or a gap in a return, has none.
    """
    meta = units.select("unit_id", F.posexplode("panel_meta").alias("pos", "m")).select("unit_id", "pos", "m.panel", "m.asset_ids", "m.frequency")
    asked = units.select("unit_id", "asof", "target_type", F.explode("assets").alias("asset"))
    listed = asked.join(meta, "unit_id").where(F.array_contains("asset_ids", F.col("asset"))).drop("asset_ids")
    own = panels.select("unit_id", "panel").distinct().join(meta.select("unit_id", "panel", "frequency"), ["unit_id", "panel"], "left")
    unlisted = asked.join(listed.select("unit_id", "asset").distinct(), ["unit_id", "asset"], "left_anti").join(own, "unit_id").withColumn("pos", F.lit(0))
    each = Window.partitionBy("unit_id", "asset")
    rows = listed.unionByName(unlisted).join(pooled(panels), ["panel", "asset"]).withColumn("rank", F.struct("pos", "panel")).withColumn("best", F.min("rank").over(each)).where("rank = best")
    cells = units.select("unit_id", F.explode("assets").alias("asset"), "horizons").withColumn("horizon", F.explode("horizons")).drop("horizons")

    monthly = F.coalesce(F.lower("frequency"), F.lit("")).contains("month")
    after = rows.where(~monthly & (F.col("date") > F.col("asof"))).withColumn("k", F.row_number().over(each.orderBy("date")))
    so_far = each.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    finite = F.coalesce(~F.isnan("value") & (F.abs("value") != float("inf")), F.lit(False))
    sums = F.sum(F.when(F.col("target_type") == "log_return", F.log1p("value"))).over(so_far)
    good = F.min(finite).over(so_far)
    after = after.select("unit_id", "asset", F.col("k").alias("horizon"), F.when(F.col("target_type") == "log_return", F.when(good, sums)).otherwise(F.col("value")).alias("value"))
    due = cells.join(units.select("unit_id", "asof"), "unit_id").withColumn("date", F.trunc(F.date_sub(add_business_days(F.col("asof"), F.col("horizon")), config.lag_days), "month").cast("date"))
    by_month = rows.where(monthly).select("unit_id", "asset", "date", "value").join(due, ["unit_id", "asset", "date"]).select("unit_id", "asset", "horizon", "value")
    found = cells.join(after.unionByName(by_month), ["unit_id", "asset", "horizon"], "left")
    return found.withColumn("whole", F.bool_and(F.col("value").isNotNull()).over(Window.partitionBy("unit_id"))).where("whole").drop("whole")


def pit_cells(drawn: DataFrame, outcomes: DataFrame) -> DataFrame:
    """unit_id, asset, horizon, pit, z and the tails in which the outcome lies."""
    key = ["unit_id", "asset", "horizon"]
    rows = drawn.join(outcomes.withColumnRenamed("value", "y"), key)
    q = F.percentile("value", F.array(*[F.lit(x) for x in (0.01, 0.05, 0.95, 0.99)]))
    out = rows.groupBy(*key, "y").agg(F.avg((F.col("value") < F.col("y")).cast("double")).alias("pit"), q.alias("q"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    z = (F.col("y") - F.col("mean")) / F.coalesce(F.nullif(F.col("sd"), F.lit(0.0)), F.lit(1e-12))
    return out.select(*key, "pit", z.alias("z"), *[(F.col("y") < F.col("q")[i]).alias(c) for i, c in enumerate(("below01", "below05"))], *[(F.col("y") > F.col("q")[i + 2]).alias(c) for i, c in enumerate(("above95", "above99"))])


def pit_stats(cells: DataFrame) -> DataFrame:
    """Calibration of each unit, rounded to three digits, the largest |z| to two."""

    def share(c: Column) -> Column:
        return F.bround(F.avg(c.cast("double")), 3)

    p = F.col("pit")
    return cells.groupBy("unit_id").agg(
        F.count("*").alias("n_cells"), share(p).alias("pit_mean"), share(p.between(0.25, 0.75)).alias("in50"), share(p.between(0.05, 0.95)).alias("in90"),
        *[share(F.col(c)).alias(c) for c in ("below01", "below05", "above95", "above99")], share(F.col("z")).alias("z_mean"), F.bround(F.max(F.abs("z")), 2).alias("z_absmax"),
    )


def ratios(run: DataFrame, reference: DataFrame, most: float = 4.0) -> DataFrame:
    """unit_id, family, target, ratio: a run's score over the reference's, `most` at most; only where that is positive."""
    ref = reference.select("unit_id", F.col("composite_score").alias("b")).where("b > 0")
    return run.where("composite_score is not null").join(ref, "unit_id").select("unit_id", "family", "target", F.least(F.col("composite_score") / F.col("b"), F.lit(most)).alias("ratio"))


def summary(found: DataFrame) -> DataFrame:
    """Ratios over all units, by family and by target, from one pass: level, name, n, mean, median, better, worst."""
    sets = found.groupingSets([[], ["family"], ["target"]], "family", "target")
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("ratio").alias("mean"), F.expr("median(ratio)").alias("median"), F.count_if(F.col("ratio") < 1).alias("better"), F.max("ratio").alias("worst"))
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "family").otherwise("target")
    return out.select(level.alias("level"), F.when(F.col("g") == 3, "").when(F.col("g") == 1, F.col("family")).otherwise(F.col("target")).alias("name"), "n", "mean", "median", "better", "worst")


def worst_units(found: DataFrame, k: int = 6) -> DataFrame:
    return found.orderBy(F.desc("ratio"), F.desc("unit_id")).limit(k).select("unit_id", "ratio")


def calibration_means(run: DataFrame) -> DataFrame:
    return run.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in CALIBRATION])


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """unit_id, asset, horizon, shift (of the centre, in b's deviations), width (ratio). Horizons may be numbers or strings."""
    key = ["unit_id", "asset", "horizon"]
    right = b.withColumn("horizon", F.col("horizon").cast("int")).select(*key, *[F.col(c).alias(f"{c}_b") for c in ("q05", "q50", "q95")])
    rows = a.withColumn("horizon", F.col("horizon").cast("int")).join(right, key).withColumn("w", F.col("q95_b") - F.col("q05_b"))
    sd = F.when(F.col("w") > 0, F.col("w") / 3.29)
    return rows.select(*key, ((F.col("q50") - F.col("q50_b")) / sd).alias("shift"), ((F.col("q95") - F.col("q05")) / F.nullif(F.col("w"), F.lit(0.0))).alias("width"))


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.agg(F.count("*").alias("cells"), F.avg(F.abs("shift")).alias("mean_shift"), F.expr("median(width)").alias("median_width"))


def run_rows(units: DataFrame, verdicts: DataFrame, usage: DataFrame, scores: DataFrame) -> DataFrame:
    """One summary row for each unit, whatever is missing: not admissible, no scores."""
    out = units.select("unit_id", "family", F.col("target_type").alias("target"), F.size("assets").alias("n_assets"), F.array_join(F.transform("horizons", lambda h: h.cast("string")), " ").alias("horizons"), "asof")
    out = out.join(verdicts, "unit_id", "left").join(usage, "unit_id", "left").join(scores, "unit_id", "left")
    return out.withColumn("admissible", F.coalesce("admissible", F.lit(False)))


def run_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("units"), F.count_if(F.col("admissible")).alias("admissible"), F.avg("elapsed_s").alias("mean_elapsed"))
