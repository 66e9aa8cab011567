"""Many units in one call: error rows, sparse scenarios, the text stage, ledgers and reports."""

import json
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.config import DEFAULT, Config
from halyard.operators import batch, evidence, series, simulate
from halyard.sources.readers import UNIT_SCHEMA

PANEL = "unit_id string, panel string, asset string, date date, value double, tie int"
DAYS = [date(2020, 1, 1) + timedelta(days=k) for k in range(90)]
CARD = "unit_id string, doc_id string, asset string, direction string, strength string, uncertainty string, relevance string, facts boolean, event_exists string, event_type string, event_words string"
RAW = "unit_id string, scenario int, name string, asset string, weight string, drift string, vol_mult string"
CITED = "unit_id string, scenario int, doc_id string"


def unit(name, assets=("A", "B"), horizons=(1, 5), asof=DAYS[-1], kind="level"):
    return (name, "F1", kind, "", asof, 200, list(assets), list(horizons), [("px", ["A", "B"], "business_daily")], None, None)


def walk(seed):
    return 100 * np.exp(np.random.default_rng(seed).normal(0, 0.01, len(DAYS)).cumsum())


def panel_rows(name, assets=("A", "B"), seed=0):
    return [(name, "px", a, d, float(v), 1) for k, a in enumerate(assets) for d, v in zip(DAYS, walk(seed + k), strict=True)]


@pytest.fixture(scope="module")
def hundred(spark):
    """100 units, of which one asks for an asset that no panel holds."""
    names = [f"u{i:03}" for i in range(100)]
    rows = [r for i, n in enumerate(names) for r in panel_rows(n, seed=i)]
    units = [unit(n, ("A", "ghost") if n == "u042" else ("A", "B")) for n in names]
    return spark.createDataFrame(rows, PANEL), spark.createDataFrame(units, UNIT_SCHEMA)


def test_one_bad_asset_costs_one_unit(hundred):
    f = batch.forecast(*hundred, n_draws=200)
    assert f.draws.select("unit_id").distinct().count() == 99 and f.draws.count() == 99 * 200 * 2 * 2 == f.figures["rows"]
    assert [tuple(r) for r in f.problems.collect()] == [("u042", "ghost", "not in any panel up to the as-of", ["A", "B"])]
    # the others are forecast as they would be alone
    panels, units = hundred
    alone = batch.forecast(panels.where("unit_id = 'u007'"), units.where("unit_id = 'u007'"), n_draws=200)
    key = ["draw", "asset", "horizon"]
    a, b = (x.draws.where("unit_id = 'u007'").orderBy(*key).toPandas() for x in (f, alone))
    assert np.allclose(a["value"], b["value"])


def test_every_kind_of_trouble_is_a_row(spark):
    rows = panel_rows("ok") + panel_rows("short", ("A",)) + [("short", "px", "B", d, 1.0 + k, 1) for k, d in enumerate(DAYS[:4])]
    rows += panel_rows("late", ("A",)) + [("late", "px", "B", DAYS[-1] + timedelta(days=k), 2.0, 1) for k in range(1, 9)]
    rows += panel_rows("wild", ("A",)) + [("wild", "px", "B", d, 1e308 * (1 if k % 2 else -1), 1) for k, d in enumerate(DAYS)]
    rows += panel_rows("dateless") + panel_rows("aimless") + panel_rows("empty") + panel_rows("bad_file")
    units = [unit("ok"), unit("short"), unit("late"), unit("wild"), unit("dateless", asof=None), unit("aimless", horizons=()), unit("empty", ()), unit("gone"), unit("bad_file")]
    given = [("ok", 0, "s", 1.0, "A", 0.1, 1.2, False, None), ("bad_file", 0, "s", 1.0, "C", 0.1, 1.2, False, None), ("bad_file", 0, "s", 1.0, "A", None, 0.5, False, None)]
    files = spark.createDataFrame(given, "unit_id string, scenario int, name string, weight double, asset string, drift double, vol_mult double, established boolean, tail_df double")
    f = batch.forecast(spark.createDataFrame(rows, PANEL), spark.createDataFrame(units, UNIT_SCHEMA), n_draws=200, given=files)
    got = {(r.unit_id, r.asset, r.problem) for r in f.problems.collect()}
    assert got == {
        ("short", "B", "fewer than five increments: 3"), ("late", "B", "not in any panel up to the as-of"), ("wild", "B", "a draw is not finite"),
        ("dateless", None, "no as-of date"), ("aimless", None, "no horizon"), ("empty", None, "no asset"),
        ("gone", "A", "not in any panel up to the as-of"), ("gone", "B", "not in any panel up to the as-of"),
        ("bad_file", "C", "adjustments: scenario 0: unknown asset"), ("bad_file", "A", "adjustments: scenario 0: narrows without a fact"),
    }
    assert {r.unit_id for r in f.draws.select("unit_id").distinct().collect()} == {"ok"} and f.figures["bad"] > 0
    assert {r.unit_id for r in f.quantiles.collect()} == {"ok"}


def test_units_without_scenarios_keep_their_draws(spark):
    rows = spark.createDataFrame(panel_rows("a") + panel_rows("b", seed=5), PANEL)
    units = spark.createDataFrame([unit("a"), unit("b")], UNIT_SCHEMA)
    made = series.prepared(rows, units)
    some = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.2), ("a", 2, 0.7)], "unit_id string, scenario int, weight double")
    got = simulate.simulate(made, units, 200, some).groupBy("unit_id").count().collect()
    assert {r.unit_id: r["count"] for r in got} == {"a": 800, "b": 800}
    alone = simulate.simulate(made.where("unit_id = 'b'"), units.where("unit_id = 'b'"), 200)
    both = simulate.simulate(made, units, 200, some).where("unit_id = 'b'")
    key = ["draw", "asset", "horizon"]
    assert np.allclose(alone.orderBy(*key).toPandas()["value"], both.orderBy(*key).toPandas()["value"])


def test_scenario_ranges_leave_no_gap(spark):
    rng = np.random.default_rng(0)
    rows = [(f"u{u}", k, float(w)) for u in range(50) for k, w in enumerate(rng.random(7))]
    got = simulate.scenario_ranges(spark.createDataFrame(rows, "unit_id string, scenario int, weight double")).orderBy("unit_id", "scenario").collect()
    assert all(a.high == b.low for a, b in zip(got, got[1:], strict=False) if a.unit_id == b.unit_id)
    assert {(r.low, r.unit_id) for r in got if r.scenario == 0} == {(0.0, f"u{u}") for u in range(50)} and all(r.high == 1.0 for r in got if r.scenario == 6)


@pytest.fixture(scope="module")
def told(spark):
    """text: scenarios of the model. cards: all weights 0. noraw: cards only, with an event. bare: neither. other: cards of an asset not asked for."""
    names = ["text", "cards", "noraw", "bare", "other"]
    units = spark.createDataFrame([unit(n) for n in names], UNIT_SCHEMA)
    rows = spark.createDataFrame([r for n in names for r in panel_rows(n)], PANEL)
    cards = [(u, str(k), "A", "1", "1", "higher", "1", True, "no", "", "") for u in ("text", "cards") for k in range(4)]
    cards += [("noraw", "9", "A", "-1", "1", "same", "0.8", False, "yes", "binary", "vote"), ("other", "7", "Z", "1", "1", "higher", "0.2", False, "no", "", "")]
    raw = [("text", 0, "up", "A", "3", "0.5", "1.5"), ("text", 1, "calm", "B", "1", "0", "0.5"), ("cards", 0, "zero", "A", "0", "1", "1"), ("bare", 0, "x", "A", "1", "1", "1")]
    docs = spark.createDataFrame([("text", str(k)) for k in range(4)], "unit_id string, doc_id string")
    stage = evidence.text_stage(units, docs, spark.createDataFrame(cards, CARD), spark.createDataFrame(raw, RAW), spark.createDataFrame([("text", 1, "2"), ("text", 1, "99")], CITED))
    return rows, units, stage


def test_the_text_stage_answers_for_every_unit(told):
    _, _, stage = told
    knobs = {r.unit_id: (r.source, r.tail_df, None if r.stress_prob is None else round(r.stress_prob, 6)) for r in stage.knobs.collect()}
    assert knobs == {"text": ("text", None, None), "cards": ("cards", None, 0.3), "noraw": ("cards", 6.0, 0.25), "bare": ("neutral", None, None), "other": ("cards", None, 0.1)}
    got = {(r.unit_id, r.scenario): (r.name, round(r.weight, 4), r.established, r.evidence) for r in stage.scenarios.collect()}
    assert got == {
        ("text", 0): ("up", 0.75, False, []), ("text", 1): ("calm", 0.25, True, ["2"]), ("cards", 0): ("cards-consensus", 1.0, False, ["0", "1", "2", "3"]),
        ("noraw", 0): ("cards-consensus", 1.0, False, ["9"]), ("bare", 0): ("baseline", 1.0, False, []), ("other", 0): ("cards-consensus", 1.0, False, []),
    }
    moves = {(r.unit_id, r.asset): (round(r.drift, 6), r.vol_mult) for r in stage.overlays.where("unit_id in ('cards', 'noraw', 'other', 'bare')").collect()}
    assert moves == {("cards", "A"): (0.5, 1.2), ("noraw", "A"): (-0.5, 1.3), ("noraw", "B"): (0.0, 1.3)}


def test_knobs_of_the_cards_can_be_switched_off(spark, told):
    units = told[1].where("unit_id = 'noraw'")
    cards = spark.createDataFrame([("noraw", "9", "A", "-1", "1", "same", "0.8", False, "yes", "binary", "vote")], CARD)
    none = spark.createDataFrame([], RAW), spark.createDataFrame([], CITED)
    stage = evidence.text_stage(units, cards, cards, *none, config=Config(fallback_knobs=False))
    assert [(r.tail_df, r.stress_prob) for r in stage.knobs.collect()] == [(None, None)]


def test_ledger_and_meta(told):
    rows, units, stage = told
    f = batch.forecast(rows, units, n_draws=300, stage=stage)
    info = {r.unit_id: r.info for r in batch.ledger(f).collect()}
    assert set(info) == {"text", "cards", "noraw", "bare", "other"} and f.problems.count() == 0
    x = info["text"]
    assert [(s.name, s.weight) for s in x.scenarios] == [("up", 0.75), ("calm", 0.25)] and sum(s.n_draws for s in x.scenarios) == 300 == x.n_draws
    assert (x.mode, x.freq, x.aligned_rows, x.pool_full_rows, x.block_mean, x.path_steps, x.source) == ("joint-bootstrap", "daily", 89, 89, 7, 5, "text")
    assert x.stress_rows < DEFAULT.min_pool_rows and x.p_stress == 0.0 and list(x.assets) == ["A", "B"] and list(x.assets["A"].horizons) == [1, 5]
    cell = x.assets["A"].horizons[5]
    assert cell.steps == 5 and cell.q05 < cell.q50 < cell.q95 and x.assets["A"].n_increments == 89
    assert info["bare"].notes == ["no card of any document; neutral"] and info["noraw"].tail_df == 6.0
    told_draws = {(r.unit_id, r.scenario): r.n_draws for r in batch.scenario_draws(f).collect()}
    assert told_draws[("text", 0)] + told_draws[("text", 1)] == 300 and told_draws[("bare", 0)] == 300
    m = json.loads(batch.meta(f).where("unit_id = 'text'").first()["meta"])
    assert m["asset_ids"] == ["A", "B"] and m["horizons"] == [1, 5] and m["n_draws"] == 300 and m["asof"] == "2020-03-30" and m["agent"]["text_source"] == "text"


def test_a_file_goes_before_the_text(spark, told):
    rows, units, stage = told
    given = spark.createDataFrame([("text", 0, "mine", 1.0, None, None, None, False, 5.0)], "unit_id string, scenario int, name string, weight double, asset string, drift double, vol_mult double, established boolean, tail_df double")
    f = batch.forecast(rows, units, n_draws=200, given=given, stage=stage)
    got = {r.unit_id: (r.info.source, r.info.tail_df, [s.name for s in r.info.scenarios]) for r in batch.ledger(f).collect()}
    assert got["text"] == ("file", 5.0, ["mine"]) and got["noraw"] == ("cards", 6.0, ["cards-consensus"])


def test_documents_are_cut_for_the_model(spark):
    docs = spark.createDataFrame([("u", "x" * 20000), ("v", "short"), ("w", None)], "unit_id string, text string")
    assert [r.n for r in evidence.short_docs(docs).orderBy("unit_id").select(F.length("text").alias("n")).collect()] == [9000, 5, None]
