"""Operators against pandas, and invariants of the simulation."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halyard.functions.columns import add_business_days, json_object, number, truthy
from halyard.operators import series, simulate
from halyard.sources.readers import UNIT_SCHEMA


def make(spark, n=150, hole=True, future=False):
    rng = np.random.default_rng(7)
    rows, day = [], date(2020, 1, 1)
    a, b = 100.0, 5.0
    for i in range(n):
        day += timedelta(days=120 if hole and i == 70 else 1)
        a, b = a * float(np.exp(rng.normal(0, 0.01))), b + float(rng.normal(0, 0.1))
        rows += [("u", "px", "A", day, a, 1), ("u", "rates", "B", day, b, 1)]
        if i == 30:
            rows.append(("u", "px", "A", day, -7.0, 0))  # replaced by the row of the larger tie
    asof = day
    if future:
        rows += [("u", "px", "A", day + timedelta(days=k), 1e9, 1) for k in range(1, 5)]
    units = spark.createDataFrame([("u", "F", "level", "", asof, 200, ["A", "B"], [1, 5], [("px", ["A"], ""), ("rates", ["B"], "")], None, None)], UNIT_SCHEMA)
    return spark.createDataFrame(rows, "unit_id string, panel string, asset string, date date, value double, tie int"), units


@pytest.fixture(scope="module")
def prepared(spark):
    return series.prepared(*make(spark)).cache()


def test_chain_agrees_with_pandas(spark, prepared):
    panels, _ = make(spark)
    raw = panels.where("asset = 'A' and tie = 1").toPandas().sort_values("date")
    s = pd.Series(raw["value"].to_numpy(), index=pd.to_datetime(raw["date"]))
    x = np.log(s).diff()
    step = s.index.to_series().diff().dt.days
    x = x.where(step <= max(10 * step.median(), 5)).dropna()
    vol = x.pow(2).ewm(halflife=20, min_periods=5).mean().pow(0.5)
    z = x / vol.shift(1).bfill().clip(lower=0.25 * x.std())
    roll = x.rolling(21, min_periods=3).std().shift(1)
    stress = (roll >= np.nanpercentile(roll.dropna(), 85)).fillna(False)
    got = prepared.where("asset = 'A'").orderBy("date").toPandas()
    assert len(got) == len(x) == 148
    assert np.allclose(got["x"], x) and np.allclose(got["z"], z) and np.allclose(got["vol"].dropna(), vol.dropna())
    assert got["stress"].tolist() == stress.tolist()
    assert set(prepared.where("asset = 'B'").select("space").distinct().toPandas()["space"]) == {"diff"}


def test_rows_after_the_cutoff_change_nothing(spark, prepared):
    panels, units = make(spark, future=True)
    units = units.withColumn("asof", F.lit(prepared.agg(F.max("last_date")).first()[0]))
    again = series.prepared(panels, units).orderBy("asset", "date").toPandas()
    pd.testing.assert_frame_equal(again, prepared.orderBy("asset", "date").toPandas())


def test_draws_do_not_depend_on_partitions(spark, prepared):
    _, units = make(spark)
    a = simulate.simulate(prepared.repartition(1), units).orderBy("draw", "asset", "horizon").toPandas()
    b = simulate.simulate(prepared.repartition(7, "date"), units).orderBy("draw", "asset", "horizon").toPandas()
    assert len(a) == 2000 * 2 * 2 and np.allclose(a["value"], b["value"])
    mid = a[a.asset == "B"].groupby("horizon")["value"].median()
    anchor = prepared.where("asset = 'B'").first()["anchor"]
    assert (mid - anchor).abs().max() < 0.2


def test_blocks_have_the_mean_length(spark, prepared):
    _, units = make(spark)
    spec = series.asset_spec(prepared)
    steps = simulate.horizon_steps(spec, units.withColumn("horizons", F.array(F.lit(60))))
    together = simulate.aligned(prepared, spec)
    pool = simulate.pools(together, simulate.modes(together, spec), spec)
    plan = simulate.draw_plan(units, simulate.neutral(units), pool, spec, 400)
    rows = simulate.block_index(plan, pool, spec, steps).toPandas()
    assert (rows["salt"] == "*").all()
    rows = rows.sort_values(["draw", "step"])
    goes_on = (rows["row_id"].diff() % rows["n"] == 1)[rows["step"] > 1]
    assert abs(goes_on.mean() - (1 - 1 / 7)) < 0.02
    share = plan.groupBy("pool").count().toPandas().set_index("pool")["count"] / 400
    assert abs(share["recent"] / (share["recent"] + share["full"]) - 0.6) < 0.08


def test_business_days(spark):
    rows = [(date(2024, 1, 1) + timedelta(days=d), h) for d in range(14) for h in range(1, 13)]
    got = spark.createDataFrame(rows, "d date, h int").select("d", "h", add_business_days(F.col("d"), F.col("h")).alias("x")).toPandas()
    assert all(pd.Timestamp(x) == pd.Timestamp(d) + pd.offsets.BDay(h) for d, h, x in got.itertuples(index=False))


def test_tolerant_casts(spark):
    rows = [("1.5",), ("NaN",), ("inf",), ("high",), ("",), (None,)]
    got = spark.createDataFrame(rows, "x string").select(number(F.col("x"), 0.5).alias("n"), truthy(F.col("x")).alias("t")).toPandas()
    assert got["n"].tolist() == [1.5, 0.5, 0.5, 0.5, 0.5, 0.5] and not got["t"].any()
    texts = spark.createDataFrame([('a ```{"k": {"j": 1}}``` b',), ("none",)], "x string").select(json_object(F.col("x")).alias("j")).toPandas()["j"].tolist()
    assert texts == ['{"k": {"j": 1}}', None]


def test_evidence_comes_as_rows(spark):
    from halyard.operators.evidence import cleaned

    raw = spark.createDataFrame([("u", 0, "a", "X", "1", "0", "0.5"), ("u", 1, "b", "X", "1", "0", "0.5")], "unit_id string, scenario int, name string, asset string, weight string, drift string, vol_mult string")
    given = spark.createDataFrame([("u", 0, "1"), ("u", 0, "1"), ("u", 0, "2"), ("u", 0, "gone"), ("u", 1, "3")], "unit_id string, scenario int, doc_id string")
    known = spark.createDataFrame([("u", str(i), i < 3) for i in range(5)], "unit_id string, doc_id string, facts boolean")
    got = {r.scenario: (r.n_cited, r.established) for r in cleaned(raw, given, known, known).collect()}
    assert got == {0: (2, True), 1: (1, False)}


def units_of(spark, *rows):
    return spark.createDataFrame([(u, "F", t, "", day, 200, a, h, p, None, None) for u, t, day, a, h, p in rows], UNIT_SCHEMA)


PANEL = "unit_id string, panel string, asset string, date date, value double, tie int"


def test_the_peg_proxy_does_not_depend_on_partitions(spark):
    """Four others: two are equally near their median, and the first name is taken."""
    from halyard.operators.series import peg_proxies

    rng = np.random.default_rng(1)
    moves = spark.createDataFrame([("u", "peg", "fx", "log", "daily", float(x)) for x in rng.normal(0, 1e-5, 50)], "unit_id string, asset string, panel string, space string, freq string, x double")
    refs = spark.createDataFrame([("u", "fx", a, sd, float(x) * sd) for a, sd in (("D", 0.01), ("C", 0.02), ("B", 0.03), ("A", 0.04)) for x in rng.normal(size=20)], "unit_id string, panel string, asset string, sd double, x double")
    got = {peg_proxies(moves.repartition(n), refs.repartition(n)).first()["proxy"] for n in (1, 2, 3, 7)}
    assert got == {"B"}


def test_an_asset_with_five_increments_walks_on_normal_shocks(spark):
    days = [date(2020, 1, 1) + timedelta(days=k) for k in range(150)]
    rng = np.random.default_rng(2)
    rows = [("u", "px", "A", d, 100 + float(v), 1) for d, v in zip(days, rng.normal(size=150).cumsum() * 0.1, strict=True)]
    rows += [("u", "px", "B", d, 50.0 + k % 3, 1) for k, d in enumerate(days[-6:])]
    units = units_of(spark, ("u", "level", days[-1], ["A", "B"], [1, 3], [("px", ["A", "B"], "business_daily")]))
    got = simulate.simulate(series.prepared(spark.createDataFrame(rows, PANEL), units), units, 200).groupBy("asset", "horizon").agg(F.count("*").alias("n"), F.stddev("value").alias("sd")).collect()
    assert {(r.asset, r.horizon): r.n for r in got} == {(a, h): 200 for a in "AB" for h in (1, 3)} and all(r.sd > 0 for r in got)


def test_outcomes_of_units_whose_card_lists_no_panel(spark):
    from halyard.operators.calibrate import realized

    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(10)]
    rows = [("u", "b", "A", d, 0.01, 1) for d in days] + [("v", "a", "A", d, 9.0, 1) for d in days]
    units = units_of(spark, ("u", "log_return", days[4], ["A"], [1, 3], []))
    got = {r.horizon: r.value for r in realized(spark.createDataFrame(rows, PANEL), units).collect()}
    assert np.allclose([got[1], got[3]], [np.log(1.01), 3 * np.log(1.01)])  # of the unit's own panel, not of another's


def test_sparse_scenarios_cover_all_assets_of_a_unit(spark):
    from halyard.operators.evidence import adjustments, cleaned

    raw = spark.createDataFrame([("u", 0, "a", "X", "3", "0.5", "1"), ("u", 1, "b", "Y", "1", "0", "2"), ("w", 0, "a", "X", "0", "1", "1")], "unit_id string, scenario int, name string, asset string, weight string, drift string, vol_mult string")
    none = spark.createDataFrame([], "unit_id string, scenario int, doc_id string")
    cards = spark.createDataFrame([("w", "1", "X", "1", "1", "higher", "1", True, "yes", "binary", "vote")], "unit_id string, doc_id string, asset string, direction string, strength string, uncertainty string, relevance string, facts boolean, event_exists string, event_type string, event_words string")
    assets = spark.createDataFrame([("u", "X"), ("u", "Y"), ("u", "Z"), ("w", "X")], "unit_id string, asset string")
    got = {(r.scenario, r.asset): (r.weight, round(r.drift, 6), r.vol_mult) for r in cleaned(raw, none, cards, cards, assets=assets).collect()}
    assert got == {(0, "X"): (0.75, 0.35, 1.0), (0, "Y"): (0.75, 0.0, 1.0), (0, "Z"): (0.75, 0.0, 1.0), (1, "X"): (0.25, 0.0, 1.0), (1, "Y"): (0.25, 0.0, 1.5), (1, "Z"): (0.25, 0.0, 1.0)}
    back = adjustments(raw, none, cards, cards, assets=assets).where("unit_id = 'w'").collect()
    assert [(r.scenario, r.weight, r.asset, r.drift) for r in back] == [(0, 1.0, "X", 0.5)]


def test_volatility_sorts_a_series_twice(spark):
    """Every sort and every window of a task holds pages until it ends, so there are few of them."""
    schema = "unit_id string, asset string, panel string, freq string, space string, date date, anchor double, last_date date, mean_level double, x double"
    plan = series.volatility(spark.createDataFrame([], schema).repartition(2))._jdf.queryExecution().sparkPlan().toString()
    executed = series.volatility(spark.createDataFrame([], schema).repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 4 and executed.count("Sort [") <= 2
