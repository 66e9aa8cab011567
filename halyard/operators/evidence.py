"""Signal cards of dated documents to scenario adjustments: aggregates, joins and guardrails as relational steps.

cards: unit_id, doc_id, asset, direction, strength, uncertainty, relevance, facts (boolean), event_exists, event_type,
event_words. Numbers are strings of a model's answer and are cast with defaults.
scenarios: unit_id, scenario, name, weight, asset, drift, vol_mult (strings); evidence: unit_id, scenario, doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from halyard.config import DEFAULT, Config
from halyard.functions.columns import clip, direction_hint, number, real_event, truthy
from halyard.sources.shared import settled

PAIR = ["unit_id", "asset"]


def mixture() -> WindowSpec:
    return Window.partitionBy(*PAIR)


def latest_docs(docs: DataFrame, keep: int, asof: str | None = None) -> DataFrame:
    """The last `keep` documents of each unit by date; those without a date come first and so go first. Later ones than asof don't count."""
    seen = docs if asof is None else docs.where((F.coalesce("day", F.lit("")) == "") | (F.col("day") <= F.lit(asof)))
    order = Window.partitionBy("unit_id").orderBy(F.desc(F.coalesce("day", F.lit(""))), F.desc("doc_id"))
    return seen.withColumn("back", F.row_number().over(order)).where(F.col("back") <= keep)


def indexed_docs(index: DataFrame, files: DataFrame) -> DataFrame:
    """Files of an index, the first entry of each file, then the files that it forgot, undated."""
    first = index.groupBy("unit_id", "file").agg(F.min_by(F.struct("doc_id", "day", "kind"), "pos").alias("e"))
    known = files.join(first, ["unit_id", "file"]).select("unit_id", "file", "e.*", "text")
    lost = files.join(first, ["unit_id", "file"], "left_anti").select("unit_id", "file", F.regexp_replace("file", r"\.[^.]*$", "").alias("doc_id"), F.lit("").alias("day"), F.lit("").alias("kind"), "text")
    return known.unionByName(lost)


def uncached(docs: DataFrame, cache: DataFrame) -> DataFrame:
    return docs.join(cache.select("unit_id", "doc_id").distinct(), ["unit_id", "doc_id"], "left_anti")


def card_stats(cards: DataFrame) -> DataFrame:
    """unit_id, asset, implied (drift in deviations), share (of relevance that says higher uncertainty), agree (documents of one sign)."""
    rel = clip(number(F.col("relevance"), 0.5), 0.0, 1.0)
    d, s = number(F.col("direction")), clip(number(F.col("strength"), 0.5), 0.0, 1.0)
    rows = cards.select(*PAIR, rel.alias("rel"), d.alias("d"), s.alias("s"), (F.lower("uncertainty") == "higher").alias("high"))
    total = F.nullif(F.sum("rel"), F.lit(0.0))
    implied = clip(0.5 * F.sum(F.col("rel") * clip(F.col("d"), -1.0, 1.0) * F.col("s")) / total, -0.5, 0.5)
    share = F.sum(F.when(F.col("high"), F.col("rel")).otherwise(0.0)) / total
    agree = F.greatest(F.count_if(F.col("d") > 0), F.count_if(F.col("d") < 0))
    return rows.groupBy(*PAIR).agg(F.coalesce(implied, F.lit(0.0)).alias("implied"), F.coalesce(share, F.lit(0.0)).alias("share"), agree.alias("agree"))


def events(cards: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """unit_id, flagged (some card flags an event) and binary (one that reads as binary)."""
    binary = real_event(F.col("event_exists"), F.col("event_type"), F.col("event_words"), config.event_strict)
    return cards.groupBy("unit_id").agg(F.bool_or(truthy(F.col("event_exists"))).alias("flagged"), F.bool_or(binary).alias("binary"))


def fallback(cards: DataFrame, stats: DataFrame, event: DataFrame) -> DataFrame:
    """One scenario from the cards alone, where no other can be had: unit_id, asset, drift, vol_mult, tail_df, stress_prob, evidence."""
    cited = cards.where(number(F.col("relevance")) >= 0.5).groupBy("unit_id").agg(F.array_sort(F.collect_set("doc_id")).alias("evidence"))
    rows = stats.join(event, "unit_id").join(cited, "unit_id", "left")
    vm = F.when(F.col("flagged"), 1.3).otherwise(1.0) * (1.0 + 0.2 * F.col("share"))
    hi = F.max("share").over(Window.partitionBy("unit_id"))
    return rows.select(
        *PAIR, F.when(F.abs("implied") > 0.02, F.col("implied")).alias("drift"), F.when(F.abs(vm - 1.0) > 0.02, F.bround(vm, 2)).alias("vol_mult"),
        F.when(F.col("flagged"), 6.0).alias("tail_df"), F.least(F.lit(0.6), 0.1 + F.when(F.col("flagged"), 0.15).otherwise(0.0) + 0.2 * hi).alias("stress_prob"),
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
    )


def cited(evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """The evidence that exists, each document once for a scenario: unit_id, scenario, doc_id."""
    return evidence.select("unit_id", "scenario", "doc_id").distinct().join(docs.select("unit_id", "doc_id").distinct(), ["unit_id", "doc_id"], "left_semi")


def cleaned(raw: DataFrame, evidence: DataFrame, cards: DataFrame, docs: DataFrame, config: Config = DEFAULT, assets: DataFrame | None = None) -> DataFrame:
    """Raw scenarios with numbers cast, shrunk and clipped, the count n_cited of evidence that exists, established by code, weights that sum to 1.

    assets: unit_id, asset; without it those that the unit's scenarios name. What a scenario does not say of one is drift 0
    and width 1. Units whose weights are all 0 have no rows. Established: every cited document states a fact and no drift is a bet. Others may not narrow.
    """
    facts = cards.groupBy("unit_id", "doc_id").agg(F.bool_or("facts").alias("facts"))
    few = raw.where(F.col("scenario") < config.max_scenarios)
    backed = cited(evidence, docs).join(facts, ["unit_id", "doc_id"], "left").groupBy("unit_id", "scenario").agg(F.count("*").cast("int").alias("cited"), F.bool_and(F.coalesce("facts", F.lit(False))).alias("all_facts"))
    drift = clip(config.drift_shrink * number(F.col("drift")), -config.drift_clamp, config.drift_clamp)
    vm = 1.0 + config.vol_shrink * (clip(number(F.col("vol_mult"), 1.0), config.vol_low, config.vol_high) - 1.0)
    # every scenario says something of every asset of its unit; weights are shares of the unit's scenarios
    unit = Window.partitionBy("unit_id")
    each = few.groupBy("unit_id", "scenario").agg(F.substring(F.min("name"), 1, 40).alias("name"), F.max(F.greatest(number(F.col("weight")), F.lit(0.0))).alias("weight"))
    each = each.withColumn("weight", F.col("weight") / F.nullif(F.sum("weight").over(unit), F.lit(0.0)))
    names = few.select(*PAIR).where("asset is not null").distinct() if assets is None else assets.select(*PAIR).distinct()
    rows = each.join(names, "unit_id").join(few.select("unit_id", "scenario", "asset", "drift", "vol_mult"), ["unit_id", "scenario", "asset"], "left")
    rows = rows.select("unit_id", "scenario", "name", "weight", "asset", drift.alias("drift"), vm.alias("vm"))
    rows = rows.join(backed, ["unit_id", "scenario"], "left")
    one = Window.partitionBy("unit_id", "scenario")
    rows = rows.withColumn("established", F.coalesce("all_facts", F.lit(False)) & (F.max(F.abs("drift")).over(one) <= 0.15))
    floor = F.when(F.col("established"), F.greatest("vm", F.lit(0.8))).otherwise(F.greatest("vm", F.lit(1.0)))
    return rows.where("weight is not null").select("unit_id", "scenario", "name", "weight", "asset", "drift", floor.alias("vol_mult"), "established", F.coalesce("cited", F.lit(0)).alias("n_cited"))


def guarded_drift(rows: DataFrame, stats: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The mixture's centre agrees with the cards' and moves only where enough of them agree."""
    rows = rows.join(stats, PAIR, "left").fillna(0, ["implied", "share", "agree"])
    rows = rows.withColumn("mix", F.sum(F.col("weight") * F.col("drift")).over(mixture()))
    far = F.abs("implied") + 0.3
    target = F.when((F.col("implied") * F.col("mix") < 0) & (F.abs("implied") > 0.05), 0.5 * F.col("implied")).when(F.abs("mix") > far, F.signum("mix") * far).otherwise(F.col("mix"))
    shift = target - F.col("mix")
    moved = F.when(F.abs(shift) > 1e-6, clip(F.col("drift") + shift, -config.drift_clamp, config.drift_clamp)).otherwise(F.col("drift"))
    weak = (F.abs("implied") < config.min_drift) | (F.col("agree") < config.min_agreeing)
    return rows.withColumn("drift", F.when(weak, 0.0).otherwise(moved)).drop("mix")


def guarded_width(rows: DataFrame, event: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Width moves only where documents corroborate it, up to a cap, and narrows only where established."""
    rows = rows.join(event.select("unit_id", "binary"), "unit_id", "left").fillna(False, ["binary"])
    rows = rows.withColumn("mix", F.sum(F.col("weight") * F.col("vol_mult")).over(mixture()))
    seen = (F.col("share") >= config.min_share) | (F.col("binary") & (F.col("share") > 0))
    floor = 1.0 + config.floor_scale * (F.when(F.col("binary"), 1.15).otherwise(1.0) * (1.0 + 0.10 * F.col("share")) - 1.0)
    most = F.when(F.col("binary"), config.vol_high).otherwise(config.max_width)
    cap = F.least(most, 1.0 + 0.6 * F.col("share") + F.when(F.col("binary"), 0.15).otherwise(0.0))
    target = F.least(F.greatest("mix", floor), F.greatest(cap, F.lit(1.0)))
    scaled = clip(F.col("vol_mult") * target / F.col("mix"), config.vol_low, config.vol_high)
    width = F.when(~seen, 1.0).when((F.col("mix") > 0) & (F.abs(target - F.col("mix")) > 1e-6), scaled).otherwise(F.col("vol_mult"))
    last = F.least(F.greatest(width, F.when(F.col("established"), 0.8).otherwise(1.0)), F.lit(config.vol_high))
    return rows.withColumn("vol_mult", last).drop("mix")


def without_noops(rows: DataFrame) -> DataFrame:
    return rows.where("abs(drift) > 1e-9 or abs(vol_mult - 1.0) > 1e-9")


def tail_and_stress(raw: DataFrame, stats: DataFrame, event: DataFrame, n_assets: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """unit_id, tail_df, stress_prob from a unit's raw answer (strings), both null unless enabled."""
    hi = stats.groupBy("unit_id").agg(F.max("share").alias("hi"))
    rows = raw.join(event, "unit_id", "left").join(hi, "unit_id", "left").join(n_assets, "unit_id", "left").fillna(False, ["binary"]).fillna(0.0, ["hi"])
    df = number(F.col("tail_df"))
    tail = F.when(df > 0, clip(df, 4.0, 8.0)).when(F.col("binary"), 6.0)
    tail = F.when((F.col("n_assets") > 1) & ~F.col("binary"), None).otherwise(tail) if config.tail_enabled else F.lit(None)
    low = F.least(F.lit(0.6), 0.10 + F.when(F.col("binary"), 0.15).otherwise(0.0) + 0.2 * F.col("hi"))
    p = F.greatest(clip(number(F.col("stress_prob"), 0.10), 0.0, 0.6), low)
    p = F.when((F.col("n_assets") > 1) & ~F.col("binary"), None).otherwise(p) if config.stress_enabled else F.lit(None)
    return rows.select("unit_id", tail.cast("double").alias("tail_df"), p.cast("double").alias("stress_prob"))


def adjustments(raw: DataFrame, evidence: DataFrame, cards: DataFrame, docs: DataFrame, config: Config = DEFAULT, assets: DataFrame | None = None) -> DataFrame:
    """The whole chain: unit_id, scenario, weight, asset, drift, vol_mult, established.

    Units with cards whose scenarios are missing, or all of weight 0, get the fallback from their cards instead.
    """
    stats, event = card_stats(cards), events(cards, config)
    names = ("unit_id", "scenario", "weight", "asset", "drift", "vol_mult", "established")
    rows = cleaned(raw, evidence, cards, docs, config, assets)
    lost = fallback(cards, stats, event).join(rows.select("unit_id").distinct(), "unit_id", "left_anti")
    lost = lost.select("unit_id", F.lit(0).alias("scenario"), F.lit(1.0).alias("weight"), "asset", F.coalesce("drift", F.lit(0.0)).alias("drift"), F.coalesce("vol_mult", F.lit(1.0)).alias("vol_mult"), F.lit(False).alias("established"))
    return guarded_width(guarded_drift(rows, stats, config), event, config).select(*names).unionByName(lost.select(*names))


@dataclass(frozen=True)
class Stage:
    """What documents say of units.

    scenarios: unit_id, scenario, name, weight, established, evidence (array of doc_id). overlays: unit_id, scenario, asset,
    drift, vol_mult. knobs: a row for each unit with unit_id, tail_df, stress_prob, source (text: the model's scenarios;
    cards: built from the cards; neutral) and note.
    """

    scenarios: DataFrame
    overlays: DataFrame
    knobs: DataFrame


def short_docs(docs: DataFrame, config: Config = DEFAULT, text: str = "text") -> DataFrame:
    """Documents as a model is to read them: their first characters."""
    return docs.withColumn(text, F.substring(text, 1, config.max_doc_chars))


def text_stage(units: DataFrame, docs: DataFrame, cards: DataFrame, raw: DataFrame, cited_docs: DataFrame, answers: DataFrame | None = None, config: Config = DEFAULT) -> Stage:
    """From cards and raw scenarios to what a simulation takes, for every unit, whatever is missing.

    A unit with raw scenarios of positive weight has them, cleaned and guarded. One with cards only has a scenario built from
    the cards, with their tail and stress where config.fallback_knobs. One without either is neutral. answers: unit_id,
    tail_df, stress_prob as the model gave them (strings). Nothing that a model answers stops a unit.
    """
    stats, event = card_stats(cards), events(cards, config)
    asked = units.select("unit_id", F.explode("assets").alias("asset"))
    # what cards say of assets that nobody asked for moves nothing; assets that no card names have no drift and no share
    stats = asked.join(stats, PAIR, "left").fillna(0.0, ["implied", "share"]).fillna(0, ["agree"])
    # units of which a card exists, though it may name none of their assets
    seen = cards.select("unit_id").distinct()
    clean = settled(cleaned(raw.join(seen, "unit_id", "left_semi"), cited_docs, cards, docs, config, asked), "clean-scenarios")
    guarded = guarded_width(guarded_drift(clean, stats, config), event, config)
    told = clean.select("unit_id").distinct()

    every = stats.join(seen.join(told, "unit_id", "left_anti"), "unit_id", "left_semi")
    lost = fallback(cards, every, event).withColumns({"drift": F.coalesce("drift", F.lit(0.0)), "vol_mult": F.coalesce("vol_mult", F.lit(1.0))})
    lost = settled(lost, "fallback-scenarios")

    base = F.array().cast("array<string>")
    proof = cited(cited_docs, docs).groupBy("unit_id", "scenario").agg(F.array_sort(F.collect_set("doc_id")).alias("evidence"))
    named = clean.groupBy("unit_id", "scenario").agg(F.min("name").alias("name"), F.max("weight").alias("weight"), F.bool_and("established").alias("established"))
    named = named.withColumn("name", F.coalesce("name", F.concat(F.lit("scenario-"), (F.col("scenario") + 1).cast("string")))).join(proof, ["unit_id", "scenario"], "left").withColumn("evidence", F.coalesce("evidence", base))
    by_cards = lost.select("unit_id", "evidence").distinct()
    one = (F.lit(0).alias("scenario"), F.lit(1.0).alias("weight"), F.lit(False).alias("established"))
    by_cards = by_cards.select("unit_id", F.lit("cards-consensus").alias("name"), *one, "evidence")
    bare = units.select("unit_id").join(seen, "unit_id", "left_anti").select("unit_id", F.lit("baseline").alias("name"), *one, base.alias("evidence"))
    scenarios = named.unionByName(by_cards).unionByName(bare)

    overlay = ("unit_id", "scenario", "asset", "drift", "vol_mult")
    overlays = without_noops(guarded.select(*overlay).unionByName(lost.withColumn("scenario", F.lit(0)).select(*overlay)))

    n_assets = units.select("unit_id", F.size("assets").alias("n_assets"))
    nothing = told.select("unit_id", F.lit(None).cast("string").alias("tail_df"), F.lit(None).cast("string").alias("stress_prob"))
    given = nothing if answers is None else told.join(answers.select("unit_id", "tail_df", "stress_prob"), "unit_id", "left")
    gates = tail_and_stress(given, stats, event, n_assets, config)
    dull = lost.select("unit_id", *[F.when(F.lit(config.fallback_knobs), F.col(c)).alias(c) for c in ("tail_df", "stress_prob")]).distinct()
    null = F.lit(None).cast("double")
    knobs = (
        gates.select("unit_id", "tail_df", "stress_prob", F.lit("text").alias("source"), F.lit(None).cast("string").alias("note"))
        .unionByName(dull.select("unit_id", "tail_df", "stress_prob", F.lit("cards").alias("source"), F.lit("no usable scenarios; one was built from the cards").alias("note")))
        .unionByName(bare.select("unit_id", null.alias("tail_df"), null.alias("stress_prob"), F.lit("neutral").alias("source"), F.lit("no card of any document; neutral").alias("note")))
    )
    return Stage(scenarios, overlays, knobs)


def violations(scenarios: DataFrame, units: DataFrame) -> DataFrame:
    """What an adjustment set breaks: unit_id, scenario, asset, problem. scenarios: drift, vol_mult (null: not given), established."""
    known = units.select("unit_id", F.explode("assets").alias("asset"), F.lit(True).alias("known"))
    rows = scenarios.join(known, PAIR, "left")
    tests = [
        ("unknown asset", F.col("known").isNull()),
        ("width not positive", F.col("vol_mult") <= 0),
        ("narrows without a fact", (F.col("vol_mult") < 1.0) & ~F.col("established")),
    ]
    problems = F.filter(F.array(*[F.when(t, F.lit(m)) for m, t in tests]), lambda x: x.isNotNull())
    found = rows.select("unit_id", "scenario", "asset", F.explode(problems).alias("problem"))
    odd = units.where("stress_prob is not null and not (stress_prob between 0.0 and 0.8)")
    return found.unionByName(odd.select("unit_id", F.lit(None).cast("int").alias("scenario"), F.lit(None).cast("string").alias("asset"), F.lit("stress probability").alias("problem")))


def asset_context(rows: DataFrame, spec: DataFrame, steps: DataFrame, vol: DataFrame, sums: DataFrame) -> DataFrame:
    """What a reader of documents needs of each asset: level, deviation at the shortest horizon in its units, recent moves, regime."""
    first = steps.groupBy(*PAIR).agg(F.min_by("step", "horizon").alias("step"))
    sd = vol.join(first, [*PAIR, "step"]).select(*PAIR, F.sqrt("cum_var").alias("first_sd"))
    out = spec.join(sd, PAIR).join(sums, PAIR)
    natural = F.when(F.col("space") == "log", F.col("anchor") * F.col("first_sd")).otherwise(F.col("first_sd"))

    def told(c: str):
        return F.when(F.col("space") == "diff", F.format_string("%+.3f", F.col(c))).otherwise(F.format_string("%+.2f%%", 100 * F.col(c)))

    return out.select(
        *PAIR, "panel", F.col("anchor").alias("level"), natural.alias("sd_in_units"), told("month").alias("change_month"), told("quarter").alias("change_quarter"),
        (F.col("vol0") / F.greatest("vol_lr", F.lit(1e-12))).alias("vol_ratio"), direction_hint(F.col("asset"), F.col("panel"), F.col("space")).alias("direction"),
    )
