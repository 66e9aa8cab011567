"""Series of asked assets: as-of scan, panel preference, working space, gap-aware increments, volatility, stress.

panels: unit_id, panel, asset, date, value, tie (orders rows of one date; the largest wins).
units: unit_id, family, target_type, asof, n_draws_min, assets, horizons, panel_meta (array of panel, asset_ids, frequency).
All windows are partitioned by (unit_id, asset), so one shuffle serves the whole chain and units run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from halyard.config import DEFAULT, Config
from halyard.sources.shared import settled

KEYS = ["unit_id", "asset"]


def asset_rows() -> WindowSpec:
    return Window.partitionBy(*KEYS)


def by_date() -> WindowSpec:
    return asset_rows().orderBy("date")


def so_far() -> WindowSpec:
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def keep_last(panel: DataFrame, keys: list[str], value: str = "value", tie: str | Column = "tie") -> DataFrame:
    """One row for each key, with the value of the largest tie; NaN becomes null."""
    return panel.groupBy(*keys).agg(F.max_by(F.nanvl(F.col(value), F.lit(None).cast("double")), tie).alias(value))


def by_freq(daily: float, monthly: float) -> Column:
    return F.when(F.col("freq") == "monthly", F.lit(monthly)).otherwise(F.lit(daily))


def series(panels: DataFrame, units: DataFrame) -> DataFrame:
    """Each asked asset up to its unit's as-of, from the panel that lists it first, else the first that has it."""
    asked = units.select("unit_id", "asof", "target_type", F.explode("assets").alias("asset"))
    meta = units.select("unit_id", F.posexplode("panel_meta").alias("pos", "m")).select("unit_id", "pos", "m.*").withColumnRenamed("frequency", "declared")
    rows = panels.join(asked, KEYS).where("date <= asof").join(meta, ["unit_id", "panel"], "left")
    listed = F.coalesce(F.array_contains("asset_ids", F.col("asset")), F.lit(False))
    rows = rows.withColumn("rank", F.struct((~listed).cast("int").alias("a"), F.when(listed, F.col("pos")).otherwise(0).alias("b"), F.col("panel").alias("c")))
    rows = rows.withColumn("best", F.min("rank").over(asset_rows())).where("rank = best")
    return rows.groupBy(*KEYS, "panel", "target_type", "declared", "date").agg(F.max_by(F.nanvl("value", F.lit(None).cast("double")), "tie").alias("value"))


def frequency(rows: DataFrame) -> DataFrame:
    """Adds gap (days since the row before), typical (its median) and freq: declared, else monthly from 20 days on."""
    rows = rows.withColumn("gap", F.datediff("date", F.lag("date").over(by_date())))
    rows = rows.withColumn("typical", F.expr("median(gap)").over(asset_rows()))
    word = F.coalesce(F.nullif(F.col("declared"), F.lit("")), F.when(F.col("typical") >= 20, "monthly").otherwise("business_daily"))
    return rows.withColumn("freq", F.when(F.lower(word).contains("month"), "monthly").otherwise("daily")).drop("declared")


def working(rows: DataFrame) -> DataFrame:
    """Adds space, work, anchor, last_date and mean_level."""
    space = F.when(F.col("target_type") == "log_return", "cumlog").when(F.lower("panel").contains("rate") | (F.min("value").over(asset_rows()) <= 0), "diff").otherwise("log")
    rows = rows.withColumn("space", space)
    # a log of values that another space holds is never asked for
    work = F.when(F.col("space") == "cumlog", F.sum(F.log1p(F.when(F.col("space") == "cumlog", F.col("value")))).over(so_far())).when(F.col("space") == "diff", F.col("value")).otherwise(F.log(F.when(F.col("space") == "log", F.col("value"))))
    last = F.max_by("value", "date").over(asset_rows())
    return rows.select(*KEYS, "panel", "freq", "space", "date", "value", "gap", "typical", work.alias("work"), F.when(F.col("space") == "cumlog", 0.0).otherwise(last).alias("anchor"), F.max("date").over(asset_rows()).alias("last_date"), F.avg("value").over(asset_rows()).alias("mean_level"))


def increments(rows: DataFrame) -> DataFrame:
    """First differences x, without those over a hole: more than ten typical steps, five days at least."""
    rows = rows.withColumn("x", F.col("work") - F.lag("work").over(by_date()))
    return rows.where(F.col("x").isNotNull() & (F.col("gap") <= F.greatest(F.col("typical") * 10.0, F.lit(5.0)))).drop("gap", "typical", "work", "value")


def reference_moves(panels: DataFrame, units: DataFrame) -> DataFrame:
    """Log moves of every asset of quote panels (their name holds fx) with 100 positive values or more: unit_id, panel, asset, date, x, sd."""
    key = ["unit_id", "panel", "asset"]
    each = Window.partitionBy(*key)
    rows = panels.where("lower(panel) like '%fx%'").join(units.select("unit_id", "asof"), "unit_id").where("date <= asof")
    rows = keep_last(rows, [*key, "date"]).withColumn("n", F.count("*").over(each)).withColumn("low", F.min("value").over(each)).where("n >= 100 and low > 0")
    order = each.orderBy("date")
    rows = rows.withColumn("gap", F.datediff("date", F.lag("date").over(order))).withColumn("x", F.log("value") - F.lag(F.log("value")).over(order))
    rows = rows.withColumn("typical", F.expr("median(gap)").over(each)).where("x is not null and gap <= greatest(typical * 10.0, 5.0)")
    return rows.select(*key, "date", "x", F.stddev_samp("x").over(each).alias("sd"))


def peg_proxies(moves: DataFrame, references: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Assets that hardly move beside the other quotes of their unit: unit_id, asset, own, med, ref_panel, proxy, factor.

    The proxy's deviation is nearest the median of the others', ties to the first name. Distances count to ten decimals: of
    an even number of others two are equally near, which the order of addition must not decide.
    """
    own = moves.where("space = 'log' and freq = 'daily'").groupBy(*KEYS).agg(F.first("panel").alias("panel"), F.stddev_samp("x").alias("own"))
    spread = references.groupBy("unit_id", F.col("panel").alias("ref_panel"), F.col("asset").alias("other")).agg(F.first("sd").alias("sd"))
    first = spread.groupBy("unit_id").agg(F.min("ref_panel").alias("first_panel"))
    own = own.join(first, "unit_id").withColumn("ref_panel", F.when(F.lower("panel").contains("fx"), F.col("panel")).otherwise(F.col("first_panel")))
    pairs = own.join(spread, ["unit_id", "ref_panel"]).where("other != asset")
    pairs = pairs.withColumn("med", F.expr("median(sd)").over(asset_rows()))
    best = pairs.groupBy(*KEYS, "ref_panel", "own", "med").agg(F.min_by(F.struct("other", "sd"), F.struct(F.round(F.abs(F.col("sd") - F.col("med")), 10).alias("d"), F.col("other"))).alias("b"))
    return best.where(F.col("own") < config.peg_trigger * F.col("med")).select(*KEYS, "own", "med", "ref_panel", F.col("b.other").alias("proxy"), (config.peg_floor * F.col("med") / F.col("b.sd")).alias("factor"))


def with_proxies(moves: DataFrame, references: DataFrame, proxies: DataFrame) -> DataFrame:
    """Moves, where an asset that has a proxy takes the proxy's dates and scaled moves."""
    kept = moves.join(proxies.select(*KEYS), KEYS, "left_anti")
    facts = moves.groupBy(*KEYS, "panel", "freq", "space").agg(*[F.first(c).alias(c) for c in ("anchor", "last_date", "mean_level")])
    lent = references.select("unit_id", F.col("panel").alias("ref_panel"), F.col("asset").alias("proxy"), "date", "x")
    lent = lent.join(proxies, ["unit_id", "ref_panel", "proxy"]).withColumn("x", F.col("x") * F.col("factor")).select(*KEYS, "date", "x")
    return kept.unionByName(lent.join(facts, KEYS).select(*moves.columns))


#: Rows of a bucket of the decayed sums; its weights reach from 2^(-SCAN / 2 h) to 2^(SCAN / 2 h), h being the half-life.
SCAN = 4096


def scan_size(config: Config = DEFAULT) -> int:
    """Rows of a bucket within which weights 2^(row / half-life) stay far from the limits of doubles."""
    return max(8, min(SCAN, 1000 * min(config.halflife_daily, config.halflife_monthly)))


def scan_reach(config: Config = DEFAULT) -> int:
    """Buckets before which a row's weight is 0 in doubles (2^-1075), so that no more need be carried."""
    return int(1075 * max(config.halflife_daily, config.halflife_monthly) // scan_size(config)) + 2


def decayed(last: Column, carried: list[Column], place: Column, halflife: Column, size: int) -> Column:
    """A decayed sum up to a row: that of its bucket, and those of the buckets before at their ends, nearest first.

    place: the row's number in its bucket, from 0. The sums combine from left to right: a bucket's weighs 2^(-1 / half-life)
    for every row since.
    """
    for k, c in enumerate(carried):
        last = last + F.coalesce(c, F.lit(0.0)) * F.pow(F.lit(2.0), -(place + 1 + k * size) / halflife)
    return last


def decayed_count(rows: Column, halflife: Column) -> Column:
    """What so many rows weigh together, the last of them 1."""
    d = F.pow(F.lit(2.0), F.lit(-1.0) / halflife)
    return (F.lit(1.0) - F.pow(F.lit(2.0), -rows / halflife)) / (F.lit(1.0) - d)


def volatility(moves: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds vol (EWMA that holds the row, null in the first four), lagged, z, vol_full and vol0.

    The EWMA is a scan over buckets of rows: decayed sums within a bucket, plus the sums of the buckets before, decayed.
    Series of any length are exact to rounding. All of a series' rows are in one task here; see `buckets` for long ones.
    """
    size = scan_size(config)
    halflife = by_freq(config.halflife_daily, config.halflife_monthly)
    # windows of one order that need no other's result are one step of the task, with one store of rows
    every = by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = moves.withColumns({"rn": F.row_number().over(by_date()), "n": F.count("*").over(every), "dev": F.stddev_samp("x").over(every), "size": F.avg(F.abs("x")).over(every)})
    rows = rows.withColumn("bucket", F.floor((F.col("rn") - 1) / size)).withColumn("place", F.col("rn") - 1 - F.col("bucket") * size)
    # one order for all that follows: buckets follow dates, so a series is sorted once more and no further
    dated = Window.partitionBy(*KEYS).orderBy("bucket", "date")
    whole = dated.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = Window.partitionBy(*KEYS, "bucket").orderBy("date")
    weight = F.pow(F.lit(2.0), (F.col("place") - size / 2) / halflife)
    rows = rows.withColumn("weight", weight).withColumn("w", F.col("weight") * F.col("x") * F.col("x"))
    # a full bucket's sum at its end; rows one bucket on see it at the same place
    rows = rows.withColumn("total", F.sum("w").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / F.pow(F.lit(2.0), (F.lit(size - 1) - size / 2) / halflife))
    inside = F.sum("w").over(one.rowsBetween(Window.unboundedPreceding, 0)) / F.col("weight")
    rows = rows.withColumn("inside", inside)
    carried = [F.lag("total", (k + 1) * size).over(dated) for k in range(scan_reach(config))]
    square = decayed(F.col("inside"), carried, F.col("place"), halflife, size)
    rows = rows.withColumn("vol", F.when(F.col("rn") >= 5, F.sqrt(square / decayed_count(F.col("rn"), halflife))))
    rows = rows.withColumn("vol_full", F.when(F.col("n") > 2, F.col("dev")).otherwise(F.col("size")))
    # the first five rows have no volatility before them and take the first there is
    before = F.coalesce(F.lag("vol").over(dated), F.when(F.col("n") > 5, F.max(F.when(F.col("rn") == 5, F.col("vol"))).over(whole)))
    rows = rows.withColumns({"before": before, "final": F.max_by("vol", "date").over(whole)})
    rows = rows.withColumn("lagged", F.when(F.col("before").isNotNull(), F.greatest("before", config.z_floor * F.col("vol_full"))))
    rows = rows.withColumn("z", F.col("x") / F.nullif(F.col("lagged"), F.lit(0.0))).withColumn("vol0", F.when(F.col("final") > 0, F.col("final")).otherwise(F.col("vol_full")))
    return rows.drop("weight", "w", "bucket", "place", "total", "inside", "before", "final", "dev", "size")


def stress(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds roll (deviation of the rows before, three at least) and stress: it reaches its 85th percentile."""

    def before(n: int) -> Column:
        w = by_date().rowsBetween(-n, -1)
        return F.when(F.count("x").over(w) >= 3, F.stddev_samp("x").over(w))

    rows = rows.withColumn("roll", F.when(F.col("freq") == "monthly", before(config.stress_monthly)).otherwise(before(config.stress_daily)))
    limit = F.when(F.count("roll").over(asset_rows()) > 20, F.percentile("roll", config.stress_percentile).over(asset_rows()))
    return rows.withColumn("limit", limit).withColumn("stress", F.coalesce(F.col("roll") >= F.col("limit"), F.lit(False)))


def sound_assets(counted: DataFrame, units: DataFrame) -> DataFrame:
    """Every asked asset with n, its increments (null: none), and sound, whether its unit can be forecast.

    counted: unit_id, asset, n. A unit can be if each of its assets has five increments or more, and it asks for some asset,
    some horizon and a date.
    """
    asked = units.select("unit_id", F.explode_outer("assets").alias("asset"), (F.col("asof").isNotNull() & (F.size("horizons") > 0)).alias("whole"))
    rows = asked.join(counted.select(*KEYS, "n"), KEYS, "left")
    good = F.coalesce(F.col("n") >= 5, F.lit(False)) & F.coalesce("whole", F.lit(False))
    return rows.withColumn("sound", F.min(good).over(Window.partitionBy("unit_id"))).drop("whole")


def problems(panels: DataFrame, units: DataFrame, assets: DataFrame) -> DataFrame:
    """Why units can't be forecast: unit_id, asset, problem, known (the assets that the unit's panels do hold, in order).

    assets: what sound_assets gives. Only panels of units in trouble are read for `known`.
    """
    bad = assets.where("not sound").select("unit_id").distinct()
    rows = panels.join(bad, "unit_id", "left_semi").join(units.select("unit_id", "asof"), "unit_id").where("date <= asof")
    held = rows.groupBy("unit_id").agg(F.array_sort(F.collect_set("asset")).alias("known"))
    card = units.select("unit_id", F.col("asof").isNull().alias("undated"), (F.size("horizons") <= 0).alias("no_horizon"))
    out = assets.where("not sound").join(card, "unit_id").join(held, "unit_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    few = F.coalesce("n", F.lit(0)) < 5
    told = (
        F.when(F.col("undated"), "no as-of date")
        .when(F.coalesce("no_horizon", F.lit(True)), "no horizon")
        .when(F.col("asset").isNull(), "no asset")
        .when(few & ~F.array_contains("known", F.coalesce("asset", F.lit(""))), "not in any panel up to the as-of")
        .when(few, F.concat(F.lit("fewer than five increments: "), F.coalesce("n", F.lit(0)).cast("string")))
    )
    # what holds of the whole unit is said once
    whole = told.isin("no as-of date", "no horizon", "no asset")
    return out.withColumn("problem", told).where("problem is not null").select("unit_id", F.when(~whole, F.col("asset")).alias("asset"), "problem", "known").distinct()


def prepare(panels: DataFrame, units: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(a row for each increment of the units that can be forecast, every asked asset with n and sound)."""
    moves = settled(increments(working(frequency(series(panels, units)))), "moves")
    references = settled(reference_moves(panels, units), "reference-moves")
    # settled step by step, as every sort and window of a task holds pages until the task ends
    proxies = settled(peg_proxies(moves, references, config), "proxies")
    moves = settled(with_proxies(moves, references, proxies), "proxied-moves")
    moved = settled(volatility(moves, config), "volatility")
    rows = settled(stress(moved, config), "prepared")
    assets = settled(sound_assets(rows.where("rn = 1"), units), "asked-assets")
    return rows.join(assets.where("sound").select(*KEYS), KEYS, "left_semi"), assets


def prepared(panels: DataFrame, units: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The whole chain: a row for each increment of every unit that can be forecast (see problems for the others)."""
    return prepare(panels, units, config)[0]


def window_sums(rows: DataFrame) -> DataFrame:
    """Sums of an asset's last increments: month (21 rows, of a monthly series 1) and quarter (63, 3)."""
    back = F.row_number().over(asset_rows().orderBy(F.desc("date")))
    recent = rows.withColumn("back", back).where("back <= 63")
    return recent.groupBy(*KEYS).agg(
        F.sum(F.when(F.col("back") <= by_freq(21, 1), F.col("x"))).alias("month"), F.sum(F.when(F.col("back") <= by_freq(63, 3), F.col("x"))).alias("quarter")
    )


def asset_spec(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row for each asset: scale, level factor and prior drift."""
    back = F.row_number().over(asset_rows().orderBy(F.desc("date")))
    rows = rows.withColumn("back", back)
    facts = ["panel", "freq", "space", "anchor", "last_date", "mean_level", "vol_full", "vol0"]
    spec = rows.groupBy(*KEYS).agg(
        *[F.first(c).alias(c) for c in facts], F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
        F.avg(F.when(F.col("back") <= config.recent_monthly, F.col("x"))).alias("recent"),
    )
    spec = spec.withColumn("level_factor", F.when((F.col("space") == "diff") & (F.col("mean_level") > 0) & (F.col("anchor") > 0), F.least(F.lit(1.0), F.sqrt(F.abs(F.col("anchor") / F.nullif(F.col("mean_level"), F.lit(0.0)))))).otherwise(1.0))
    spec = spec.withColumn("vol_lr", F.col("vol_full") * F.col("level_factor")).withColumn("t_stat", F.col("mean") / (F.col("sd") / F.sqrt("n") + 1e-12))
    drift = F.when(F.col("n") < 30, 0.0).when(F.col("space") == "cumlog", config.cumlog_drift * F.col("mean"))
    drift = drift.when((F.col("space") == "log") & (F.col("freq") == "monthly") & (F.col("t_stat") > 3), 0.5 * (F.col("mean") + F.col("recent"))).otherwise(0.0)
    return spec.withColumn("prior_drift", drift)
