"""Paths as arrays against paths as rows, random numbers, and answers of a model."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.functions.columns import bound, chi_square
from halyard.operators import answers, series, simulate
from halyard.sources.readers import UNIT_SCHEMA

PANEL = "unit_id string, panel string, asset string, date date, value double, tie int"


def test_paths_as_arrays_are_paths_as_rows(spark):
    """Joint and independent units, an asset without shocks, scenarios and fat tails; no step is ever a row of the plan."""
    rng = np.random.default_rng(6)
    days = [date(2019, 1, 1) + timedelta(days=k) for k in range(400)]
    rows = [(u, "px", a, d, float(v), 1) for u in ("joint", "short") for a in "AB" for d, v in zip(days, 100 * np.exp(rng.normal(0, 0.01, 400).cumsum()), strict=True) if u == "joint" or a == "A" or d >= days[-7]]
    units = [(u, "F", "level", "", days[-1], 200, ["A", "B"], [1, 3, 10], [("px", ["A", "B"], "business_daily")], None, t) for u, t in (("joint", 4.5), ("short", None))]
    units = spark.createDataFrame(units, UNIT_SCHEMA)
    scenarios = spark.createDataFrame([("joint", 0, 0.5), ("joint", 1, 0.5)], "unit_id string, scenario int, weight double")
    overlays = spark.createDataFrame([("joint", 1, "B", 0.4, 1.5)], "unit_id string, scenario int, asset string, drift double, vol_mult double")
    made = series.prepared(spark.createDataFrame(rows, PANEL), units)
    s = simulate.run(made, units, 300, scenarios, overlays)
    assert {r.unit_id: r.joint for r in s.mode.collect()} == {"joint": True, "short": False}
    plain = simulate.samples(simulate.paths(simulate.block_index(s.plan, s.pool, s.spec, s.steps), s.pool, s.spec, s.vol, s.steps, overlays), s.spec, s.steps)
    key = ["unit_id", "draw", "asset", "horizon"]
    a, b = (df.orderBy(*key).toPandas() for df in (s.draws, plain))
    assert len(a) == len(b) == 2 * 300 * 2 * 3 and a[key].equals(b[key]) and np.allclose(a["value"], b["value"], rtol=1e-12)
    plan = s.draws._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "explode(sequence" not in plan


@pytest.mark.parametrize("df", [0.7, 1.5, 4.5, 12.0, 80.0])
def test_chi_square_numbers(spark, df):
    got = spark.range(20000).select(chi_square(3, F.lit(df), "id").alias("x")).toPandas()["x"]
    assert (got > 0).all() and abs(got.mean() - df) < 5 * np.sqrt(2 * df / 20000) and abs(got.var() / (2 * df) - 1) < 0.15
    again = spark.range(20000).repartition(7).select("id", chi_square(3, F.lit(df), "id").alias("x")).orderBy("id").toPandas()["x"]
    assert np.array_equal(np.sort(got), np.sort(again))


def test_bound_computes_once(spark):
    assert spark.range(3).select(bound(F.col("id") * 2, lambda x: x + x).alias("y")).toPandas()["y"].tolist() == [0, 4, 8]


def test_answers_of_a_model(spark):
    rows = [
        ("u", "1", 'Here:\n```json\n{"doc_id": "9", "date": "x", "per_asset": {"A": {"direction": true, "strength": "0.5"}, "B": 3}, "established_facts": [1, "b", "c", "d"]}\n```'),
        ("u", "2", '{"per_asset": ["A"]}'), ("u", "3", '{"per_asset": {}, "event_in_window": {"exists": 1, "description": "vote"}}'), ("u", "4", ""), ("u", "5", None), ("u", "6", "{broken"), ("u", "7", '{"per_asset": {}} {"per_asset": {}}'), ("u", "8", "[1]"),
    ]
    given = spark.createDataFrame([(u, d, "2024-01-01", a) for u, d, a in rows], "unit_id string, doc_id string, day string, answer string")
    got = {(r.doc_id, r.asset): r for r in answers.card_rows(given).collect()}
    assert set(got) == {("1", "A"), ("3", None)}
    one, three = got[("1", "A")], got[("3", None)]
    assert (one.day, one.direction, one.strength, one.facts, one.fact_list) == ("2024-01-01", "1", "0.5", True, ["1", "b", "c"])
    assert (three.event_exists, three.event_words, three.facts, three.relevance) == ("1", "vote", False, None)
    assert {r.doc_id: r.problem for r in answers.refused(given).collect()} == {"2": "per_asset is not an object", "4": "no answer", "5": "no answer", "6": "no JSON object", "7": "no JSON object", "8": "no JSON object"}
    b = spark.createDataFrame([("u", '{"scenarios": [{"name": "n", "weight": 1, "drift": {"A": 0.1}, "vol_mult": {"B": false}, "evidence": ["1", 2, null]}, 7, {}], "tail_df": 5}'), ("v", '{"scenarios": {}}'), ("w", "no")], "unit_id string, answer string")
    raw, proof, extra = answers.scenario_rows(b)
    assert sorted((r.scenario, r.asset, r.drift, r.vol_mult) for r in raw.where("scenario = 0").collect()) == [(0, "A", "0.1", None), (0, "B", None, "0")]
    assert [(r.scenario, r.asset) for r in raw.where("scenario > 0").collect()] == [(2, None)]
    assert [tuple(r) for r in proof.collect()] == [("u", 0, "1")] and [tuple(r) for r in extra.collect()] == [("u", "5", None, None)]
