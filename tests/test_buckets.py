"""Bucketed windows against the plain ones and pandas."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from halyard.operators import buckets, series
from halyard.sources.readers import UNIT_SCHEMA

PANEL = "unit_id string, panel string, asset string, date date, value double, tie int"


def fixture(spark, n=700):
    """A level with holes and repeats, a rate, returns, a monthly series, and quotes of which one hardly moves."""
    rng = np.random.default_rng(3)
    day, rows, months = date(1990, 1, 1), [], []
    level, rate = 100.0, 1.0
    quotes = {"Q1": 5.0, "Q2": 7.0, "Q3": 2.0, "PEG": 1.0}
    for i in range(n):
        day += timedelta(days=200 if i in (150, 400) else 1)
        level, rate = level * float(np.exp(rng.normal(0, 0.01))), rate + float(rng.normal(0, 0.1))
        rows += [("u", "px", "A", day, level, 1), ("u", "rates", "B", day, rate, 1), ("r", "mom", "M", day, float(rng.normal(0, 0.01)), 1)]
        if i % 50 == 3:
            rows.append(("u", "px", "A", day, -1.0, 0))
        for k, q in enumerate(quotes):
            quotes[q] *= float(np.exp(rng.normal(0, 1e-5 if q == "PEG" else 0.01 * (k + 1))))
            rows.append(("q", "fx", q, day, quotes[q], 1))
    for i in range(90):
        months.append(("m", "cpi", "C", date(1990 + i // 12, 1 + i % 12, 1), 100 * 1.01**i + float(rng.normal(0, 0.1)), 1))
    units = [("u", "F", "level", "", day, 200, ["A", "B"], [1], [("px", ["A"], ""), ("rates", ["B"], "")], None, None), ("r", "F", "log_return", "", day, 200, ["M"], [1], [], None, None)]
    units += [("q", "F", "level", "", day, 200, ["PEG", "Q2"], [1], [("fx", ["PEG", "Q1", "Q2", "Q3"], "")], None, None), ("m", "F", "level", "", day, 200, ["C"], [21], [("cpi", ["C"], "monthly")], None, None)]
    return spark.createDataFrame(rows + months, PANEL), spark.createDataFrame(units, UNIT_SCHEMA)


@pytest.mark.parametrize(("size", "slot"), [(16, 20), (64, 90), (4096, 4096)])
def test_the_whole_chain_is_that_of_plain_windows(spark, size, slot):
    panels, units = fixture(spark)
    key = ["unit_id", "asset", "date"]
    want = series.prepared(panels, units).orderBy(*key).toPandas()
    got = buckets.prepared(panels, units, size=size, slot_days=slot).orderBy(*key).toPandas()
    assert set(want.columns) == set(got.columns) and len(want) == len(got)
    for c in want.columns:
        if want[c].dtype.kind == "f":
            assert np.allclose(want[c], got[c], rtol=1e-9, atol=1e-13, equal_nan=True), c
        else:
            assert want[c].tolist() == got[c].tolist(), c


def test_no_task_holds_a_whole_series(spark):
    """The rows of the largest bucket fall with the bucket's size; a series of 5,000 rows never meets in one."""
    rows = spark.range(5000).select(F.lit("u").alias("unit_id"), F.lit("A").alias("asset"), F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.sin("id").alias("x"))
    numbered = buckets.number(rows, ["unit_id", "asset"], 300)
    assert [tuple(r) for r in numbered.agg(F.min("rn"), F.max("rn"), F.count_distinct("rn"), F.max("n")).collect()] == [(1, 5000, 5000, 5000)]
    largest = [buckets.with_halo(numbered, size, 21).groupBy("unit_id", "asset", "bucket").count().agg(F.max("count")).first()[0] for size in (2048, 512, 128)]
    assert largest == [2048 + 21, 512 + 21, 128 + 21]


def test_running_sums_and_percentiles(spark):
    rng = np.random.default_rng(4)
    x = [None if i % 17 == 0 else float(v) for i, v in enumerate(rng.normal(size=3000))]
    x[5:9] = [0.0, -0.0, 1e300, -1e-300]
    rows = [("a", date(2000, 1, 1) + timedelta(days=i), v) for i, v in enumerate(x)] + [("b", date(2000, 1, 1), 1.0), ("c", date(2000, 1, 1), None)]
    df = buckets.number(spark.createDataFrame(rows, "k string, date date, x double"), ["k"], 100)
    plain = F.sum("x").over(Window.partitionBy("k").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    small = df.withColumn("x", F.when(F.abs("x") < 1e3, F.col("x")))
    both = buckets.running_sum(small, ["k"], "x", "s", 64).withColumn("p", plain).toPandas()
    assert np.allclose(both["s"], both["p"].fillna(0))
    for p in (0.0, 0.05, 0.5, 0.85, 1.0):
        got = {r.k: (r.q, r["count"]) for r in buckets.percentile(df, ["k"], "x", p, "q").collect()}
        some = [v for v in x if v is not None]
        assert np.isclose(got["a"][0], np.quantile(some, p), rtol=1e-12) and got["a"][1] == len(some) and got["b"] == (1.0, 1) and "c" not in got


def test_decayed_sums_of_long_series(spark):
    """200,000 rows, far past where one sum of weights overflows, against pandas; in one task and in buckets."""
    n = 200_000
    x = np.random.default_rng(5).normal(0, 0.01, n) * (1 + np.sin(np.arange(n) / 5000))
    day = pd.date_range("1700-01-01", periods=n, freq="D").date if n < 100_000 else [date(1, 1, 1) + timedelta(days=i) for i in range(n)]
    pdf = pd.DataFrame({"unit_id": "u", "asset": "A", "panel": "p", "freq": "daily", "space": "log", "date": day, "anchor": 1.0, "last_date": day[-1], "mean_level": 1.0, "x": x})
    rows = spark.createDataFrame(pdf, "unit_id string, asset string, panel string, freq string, space string, date date, anchor double, last_date date, mean_level double, x double").repartition(8)
    s = pd.Series(x)
    vol = s.pow(2).ewm(halflife=20, min_periods=5).mean().pow(0.5)
    z = (s / vol.shift(1).bfill().clip(lower=0.25 * s.std())).to_numpy()
    roll = s.rolling(21, min_periods=3).std().shift(1)
    flag = (roll >= np.nanpercentile(roll.dropna(), 85)).fillna(False)
    for got in (series.stress(series.volatility(rows)), buckets.shocks(rows)):
        got = got.select("date", "vol", "z", "stress").orderBy("date").toPandas()
        assert np.allclose(got["vol"][4:], vol[4:], rtol=1e-9) and got["vol"][:4].isna().all() and np.allclose(got["z"], z, rtol=1e-9)
        assert (got["stress"] != flag).sum() == 0
