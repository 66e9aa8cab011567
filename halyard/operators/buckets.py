"""The series chain for series too long for one task: windows over buckets of a series, with halo rows and carries.

`series` keeps all rows of a series in one task. Here a series is dealt out by buckets of consecutive rows:

- rows get their number from slots of time: the number within the slot, plus the rows of the slots before (`number`);
- offsets and rolling frames need a few rows before a bucket, so each bucket gets those as well, its halo (`with_halo`);
- running and decayed sums need one number from all rows before, which is carried from bucket to bucket: sums of buckets are
  a small table, whose prefix is joined back (`running_sum`, `carries`);
- figures of a whole series are grouped sums, and its exact percentile is read from the one bin that holds it.

No task holds more than a bucket and its halo, or a slot, or a bin. `prepared` gives what series.prepared gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.config import DEFAULT, Config
from halyard.operators.series import KEYS, by_freq, decayed, decayed_count, peg_proxies, scan_reach, scan_size, sound_assets, with_proxies
from halyard.sources.shared import settled

#: Days of a slot: rows of a series that are numbered in one task.
SLOT_DAYS = 4096
#: Bins of a percentile for every doubling of a value.
BINS = 64


def number(rows: DataFrame, keys: list[str], slot_days: int = SLOT_DAYS) -> DataFrame:
    """Adds rn, a row's number by date from 1, and n, the rows of its series. keys and date name a row."""
    slot = F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / slot_days)
    rows = rows.withColumn("slot", slot)
    order = Window.partitionBy(*keys).orderBy("slot")
    sizes = rows.groupBy(*keys, "slot").agg(F.count("*").alias("size"))
    # a row for each slot of a series
    before = sizes.withColumn("before", F.sum("size").over(order) - F.col("size")).withColumn("n", F.sum("size").over(Window.partitionBy(*keys))).drop("size")
    out = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "slot").orderBy("date"))).join(before, [*keys, "slot"])
    return out.withColumn("rn", F.col("rn") + F.col("before")).drop("slot", "before")


def with_halo(rows: DataFrame, size: int, halo: int) -> DataFrame:
    """Numbered rows in buckets of `size`, and the `halo` rows before each bucket once more: adds bucket and own (not of the halo)."""
    bucket = F.floor((F.col("rn") - 1) / size)
    last = F.least(F.floor((F.col("rn") - 1 + halo) / size), F.floor((F.col("n") - 1) / size))
    rows = rows.withColumn("at", bucket).withColumn("bucket", F.explode(F.sequence(bucket, last)))
    return rows.withColumn("own", F.col("at") == F.col("bucket")).drop("at")


def running_sum(rows: DataFrame, keys: list[str], value: str, out: str, size: int = 4096) -> DataFrame:
    """Adds the sum of `value` up to each numbered row. Nulls add nothing."""
    rows = rows.withColumn("bucket", F.floor((F.col("rn") - 1) / size))
    sums = rows.groupBy(*keys, "bucket").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    before = sums.withColumn("before", F.sum("total").over(Window.partitionBy(*keys).orderBy("bucket")) - F.col("total")).drop("total")
    inside = F.sum(value).over(Window.partitionBy(*keys, "bucket").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, inside).join(before, [*keys, "bucket"]).withColumn(out, F.coalesce(out, F.lit(0.0)) + F.col("before")).drop("bucket", "before")


def carries(rows: DataFrame, keys: list[str], halflife: Column, size: int, reach: int) -> DataFrame:
    """keys, bucket, carried: the decayed sum of x squared over all rows before each bucket, at the end of the one before.

    Buckets farther back than `reach` weigh nothing in doubles.
    """
    place = F.col("rn") - 1 - F.floor((F.col("rn") - 1) / size) * size
    sums = rows.withColumn("bucket", F.floor((F.col("rn") - 1) / size)).withColumn("w", F.pow(F.lit(2.0), (place - (size - 1)) / halflife) * F.col("x") * F.col("x"))
    totals = sums.groupBy(*keys, "bucket", halflife.alias("halflife")).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("total"))
    # numbers of rows have no gap, so neither have buckets; each total decays by a bucket's rows before the next is added
    back = F.collect_list("total").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(-reach, -1))
    decay = F.pow(F.lit(2.0), F.lit(-float(size)) / F.col("halflife"))
    return totals.withColumn("back", back).select(*keys, "bucket", F.aggregate("back", F.lit(0.0), lambda done, t: done * decay + t).alias("carried"))


def percentile(rows: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """keys, out, count: the exact interpolated percentile of each group's values that are not null, and how many they are.

    Bins in order of value are counted, and only rows of the bins that hold the two ranks in question are put in order.
    """
    v = F.col(value)
    size = F.floor(F.log2(F.abs(v)) * BINS) + (1 << 20)
    rows = rows.where(v.isNotNull()).withColumn("bin", F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * size.cast("long")))
    bins = rows.groupBy(*keys, "bin").agg(F.count("*").alias("size"))
    order = Window.partitionBy(*keys).orderBy("bin")
    bins = bins.withColumn("before", F.sum("size").over(order) - F.col("size")).withColumn("count", F.sum("size").over(Window.partitionBy(*keys)))
    rank = (F.col("count") - 1) * p
    bins = bins.withColumn("low", F.floor(rank)).withColumn("part", rank - F.floor(rank))
    holds = ((F.col("low") >= F.col("before")) & (F.col("low") < F.col("before") + F.col("size"))) | ((F.col("low") + 1 >= F.col("before")) & (F.col("low") + 1 < F.col("before") + F.col("size")))
    found = rows.select(*keys, "bin", value).join(bins.where(holds), [*keys, "bin"])
    found = found.withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy(*keys, "bin").orderBy(value)) - 1)
    both = found.groupBy(*keys, "part", "count").agg(F.max(F.when(F.col("place") == F.col("low"), v)).alias("a"), F.max(F.when(F.col("place") == F.col("low") + 1, v)).alias("b"))
    return both.select(*keys, (F.col("a") + F.col("part") * (F.coalesce("b", "a") - F.col("a"))).alias(out), "count")


def chosen_panels(panels: DataFrame, units: DataFrame) -> DataFrame:
    """unit_id, asset, panel, target_type, declared, asof: the panel that serves an asset, as in series.series."""
    asked = units.select("unit_id", "asof", "target_type", F.explode("assets").alias("asset"))
    meta = units.select("unit_id", F.posexplode("panel_meta").alias("pos", "m")).select("unit_id", "pos", "m.*").withColumnRenamed("frequency", "declared")
    held = panels.join(asked, KEYS).where("date <= asof").select(*KEYS, "panel", "target_type", "asof").distinct().join(meta, ["unit_id", "panel"], "left")
    listed = F.coalesce(F.array_contains("asset_ids", F.col("asset")), F.lit(False))
    rank = F.struct((~listed).cast("int"), F.when(listed, F.col("pos")).otherwise(0), F.col("panel"))
    return held.groupBy(*KEYS).agg(F.min_by(F.struct("panel", "target_type", "declared", "asof"), rank).alias("b")).select(*KEYS, "b.*")


def _differences(rows: DataFrame, keys: list[str], size: int, slot_days: int) -> DataFrame:
    """Rows (keys, date, work) with x, their first differences, but for those over a hole (see series.increments)."""
    placed = with_halo(number(rows, keys, slot_days), size, 1)
    order = Window.partitionBy(*keys, "bucket").orderBy("rn")
    steps = placed.withColumn("gap", F.datediff("date", F.lag("date").over(order))).withColumn("x", F.col("work") - F.lag("work").over(order)).where("own").drop("own", "bucket")
    typical = steps.groupBy(*keys).agg(F.expr("median(gap)").alias("typical"))
    steps = steps.join(typical, keys)
    return steps.where(F.col("x").isNotNull() & (F.col("gap") <= F.greatest(F.col("typical") * 10.0, F.lit(5.0)))).drop("gap", "typical", "rn", "n", "work")


def moves(panels: DataFrame, units: DataFrame, size: int = 4096, slot_days: int = SLOT_DAYS) -> DataFrame:
    """First differences of every asked asset, as series.increments gives them."""
    rows = panels.join(chosen_panels(panels, units), [*KEYS, "panel"]).where("date <= asof")
    nan = F.nanvl("value", F.lit(None).cast("double"))
    rows = settled(rows.groupBy(*KEYS, "panel", "target_type", "declared", "date").agg(F.max_by(nan, "tie").alias("value")), "long-rows")
    gaps = with_halo(number(rows, KEYS, slot_days), size, 1)
    gaps = gaps.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy(*KEYS, "bucket").orderBy("rn")))).where("own")
    facts = gaps.groupBy(*KEYS, "panel", "target_type", "declared").agg(
        F.expr("median(gap)").alias("typical"), F.min("value").alias("least"), F.max_by("value", "date").alias("last"), F.max("date").alias("last_date"), F.avg("value").alias("mean_level")
    )
    word = F.coalesce(F.nullif(F.col("declared"), F.lit("")), F.when(F.col("typical") >= 20, "monthly").otherwise("business_daily"))
    space = F.when(F.col("target_type") == "log_return", "cumlog").when(F.lower("panel").contains("rate") | (F.col("least") <= 0), "diff").otherwise("log")
    facts = facts.select(*KEYS, "panel", F.when(F.lower(word).contains("month"), "monthly").otherwise("daily").alias("freq"), space.alias("space"), F.when(space == "cumlog", 0.0).otherwise(F.col("last")).alias("anchor"), "last_date", "mean_level")
    facts = settled(facts, "long-facts")
    own = rows.select(*KEYS, "date", "value").join(facts, KEYS)
    log = F.when(F.col("space") == "log", F.log(F.when(F.col("space") == "log", F.col("value")))).when(F.col("space") == "diff", F.col("value"))
    level = own.where("space <> 'cumlog'").withColumn("work", log)
    summed = running_sum(number(own.where("space = 'cumlog'"), KEYS, slot_days).withColumn("r", F.log1p("value")), KEYS, "r", "work", size).drop("r", "rn", "n")
    return _differences(level.unionByName(summed).drop("value"), KEYS, size, slot_days).select(*KEYS, "panel", "freq", "space", "date", "anchor", "last_date", "mean_level", "x")


def reference_moves(panels: DataFrame, units: DataFrame, size: int = 4096, slot_days: int = SLOT_DAYS) -> DataFrame:
    """Log moves of the assets of quote panels, as series.reference_moves gives them."""
    key = ["unit_id", "panel", "asset"]
    rows = panels.where("lower(panel) like '%fx%'").join(units.select("unit_id", "asof"), "unit_id").where("date <= asof")
    rows = settled(rows.groupBy(*key, "date").agg(F.max_by(F.nanvl("value", F.lit(None).cast("double")), "tie").alias("value")), "long-quotes")
    good = rows.groupBy(*key).agg(F.count("*").alias("many"), F.min("value").alias("low")).where("many >= 100 and low > 0").select(*key)
    found = _differences(rows.join(good, key).select(*key, "date", F.log("value").alias("work")), key, size, slot_days)
    return found.join(found.groupBy(*key).agg(F.stddev_samp("x").alias("sd")), key).select(*key, "date", "x", "sd")


def shocks(moved: DataFrame, config: Config = DEFAULT, size: int | None = None, slot_days: int = SLOT_DAYS) -> DataFrame:
    """Volatility, shocks and stress of increments: what series.volatility and series.stress add."""
    size = min(size or scan_size(config), scan_size(config))
    reach = -(-scan_reach(config) * scan_size(config) // size)
    halflife = by_freq(config.halflife_daily, config.halflife_monthly)
    rows = settled(number(moved, KEYS, slot_days), "long-moves")
    facts = rows.groupBy(*KEYS).agg(F.count("*").alias("many"), F.stddev_samp("x").alias("sd"), F.avg(F.abs("x")).alias("mean_abs"))
    facts = facts.select(*KEYS, F.when(F.col("many") > 2, F.col("sd")).otherwise(F.col("mean_abs")).alias("vol_full"))
    placed = with_halo(rows, size, max(config.stress_daily, config.stress_monthly)).join(carries(rows, KEYS, halflife, size, reach), [*KEYS, "bucket"])
    one = Window.partitionBy(*KEYS, "bucket")
    order = one.orderBy("rn")
    placed = placed.withColumn("place", F.col("rn") - 1 - F.col("bucket") * size)
    weight = F.pow(F.lit(2.0), (F.col("place") - size / 2) / halflife)
    inside = F.sum(F.when(F.col("own"), weight * F.col("x") * F.col("x"))).over(order.rowsBetween(Window.unboundedPreceding, 0)) / weight
    placed = placed.withColumn("square", decayed(inside, [F.col("carried")], F.col("place"), halflife, size))
    placed = placed.withColumn("vol", F.when(F.col("own") & (F.col("rn") >= 5), F.sqrt(F.col("square") / decayed_count(F.col("rn"), halflife))))
    # before a bucket's first row stands what was carried to it
    last = F.when(F.col("place") > 0, F.lag("vol").over(order)).when(F.col("rn") > 5, F.sqrt(F.col("carried") / decayed_count(F.col("rn") - 1, halflife)))
    fifth = F.max(F.when(F.col("rn") == 5, F.col("vol"))).over(one)
    placed = placed.withColumn("before", F.coalesce(last, F.when((F.col("n") > 5) & (F.col("rn") <= 5), fifth)))

    def spread(k: int) -> Column:
        w = order.rowsBetween(-k, -1)
        return F.when(F.count("x").over(w) >= 3, F.stddev_samp("x").over(w))

    placed = placed.withColumn("roll", F.when(F.col("freq") == "monthly", spread(config.stress_monthly)).otherwise(spread(config.stress_daily)))
    out = placed.where("own").drop("own", "bucket", "place", "square", "carried").join(facts, KEYS)
    out = out.withColumn("lagged", F.when(F.col("before").isNotNull(), F.greatest("before", config.z_floor * F.col("vol_full")))).withColumn("z", F.col("x") / F.nullif(F.col("lagged"), F.lit(0.0)))
    out = settled(out.drop("before"), "long-shocks")
    final = out.where("rn = n").select(*KEYS, F.col("vol").alias("final"))
    limits = percentile(out, KEYS, "roll", config.stress_percentile, "limit").select(*KEYS, F.when(F.col("count") > 20, F.col("limit")).alias("limit"))
    out = out.join(final, KEYS).join(limits, KEYS, "left")
    out = out.withColumn("vol0", F.when(F.col("final") > 0, F.col("final")).otherwise(F.col("vol_full"))).withColumn("stress", F.coalesce(F.col("roll") >= F.col("limit"), F.lit(False)))
    return out.drop("final")


def prepared(panels: DataFrame, units: DataFrame, config: Config = DEFAULT, size: int = 4096, slot_days: int = SLOT_DAYS) -> DataFrame:
    """What series.prepared gives, for series of any length."""
    own, references = settled(moves(panels, units, size, slot_days), "long-increments"), settled(reference_moves(panels, units, size, slot_days), "long-references")
    rows = settled(shocks(with_proxies(own, references, peg_proxies(own, references, config)), config, size, slot_days), "long-prepared")
    assets = sound_assets(rows.where("rn = n").select(*KEYS, "n"), units)
    return rows.join(assets.where("sound").select(*KEYS), KEYS, "left_semi")
