"""The queries of the engine's operators on the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.config import Config
from halyard.functions.columns import DOLLARS_PER, PER_DOLLAR, direction_hint, json_object, number, truthy
from halyard.operators import answers, batch, buckets, calibrate, evidence, series, simulate
from halyard.plans import inputs
from halyard.sources import readers
from halyard.sources.shared import settled
from halyard.streaming.panels import daily_panel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, *parts: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"WITH {','.join(parts)}\n{sql}" if parts else sql).strip()
        return f

    return add


def rounded(df: DataFrame, places: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in cols})


def r(places: int, *cols: str) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in cols)


def significant(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Doubles to so many significant digits, by exact powers of ten. Below 1e-12 there is only the noise of sums that cancel."""

    def cut(c: str):
        e = F.floor(F.log10(F.abs(F.col(c)))) - (digits - 1)
        p = F.pow(F.lit(10.0), F.abs(e))
        return F.when(F.abs(F.col(c)) < 1e-12, 0.0).when(e <= 0, F.round(F.col(c) * p) / p).otherwise(F.round(F.col(c) / p) * p) + F.lit(0.0)

    return df.withColumns({c: cut(c) for c in cols})


def s(digits: int, *cols: str) -> str:
    e = f"floor(log10(abs({{c}}))) - {digits - 1}"
    cut = f"CASE WHEN abs({{c}}) < 1e-12 THEN 0.0 WHEN {e} <= 0 THEN round({{c}} * pow(10.0, abs({e}))) / pow(10.0, abs({e})) ELSE round({{c}} / pow(10.0, abs({e}))) * pow(10.0, abs({e})) END + 0.0 AS {{c}}"
    return ", ".join(cut.format(c=c) for c in cols)


IN, EV, NEUTRAL, ADJUSTED = inputs.INPUTS, inputs.EVIDENCE, inputs.NEUTRAL, inputs.ADJUSTED


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that many queries begin with, settled once for a session and a folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = settled(make(), name)
    return _TABLES[key]


def _panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "panels", lambda: inputs.panels(spark, sf_dir))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "prepared-rows", lambda: series.prepared(_panels(spark, sf_dir), inputs.units(spark)))


def _working(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.working(series.frequency(series.series(_panels(spark, sf_dir), inputs.units(spark))))


# ---- series ---------------------------------------------------------------------------------


@query("SELECT event_type AS asset, ts::DATE AS date, arg_max(value, (ts, event_id)) AS value, count(*)::BIGINT AS n FROM events WHERE ts::DATE <= DATE '2024-01-20' GROUP BY ALL")
def panel_asof_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts < '2024-01-21'")
    return daily_panel(e.select(F.col("event_type").alias("asset"), "ts", "value", F.col("event_id").alias("tie")))


@query("SELECT unit_id, asset, panel, count(*) AS n, min(date) AS first, max(date) AS last, round(sum(value), 3) AS total FROM series GROUP BY ALL", IN)
def panel_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.series(_panels(spark, sf_dir), inputs.units(spark))
    return rows.groupBy("unit_id", "asset", "panel").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT DISTINCT unit_id, asset, freq, typical FROM freqs", IN)
def freq_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.frequency(series.series(_panels(spark, sf_dir), inputs.units(spark))).select("unit_id", "asset", "freq", "typical").distinct()


@query("SELECT unit_id, asset, space, round(anchor, 6) AS anchor, last_date FROM works GROUP BY ALL", IN)
def space_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_working(spark, sf_dir).groupBy("unit_id", "asset", "space").agg(F.max("anchor").alias("anchor"), F.max("last_date").alias("last_date")), 6, "anchor")


@query("SELECT unit_id, asset, date, round(work, 8) AS work FROM works WHERE space = 'cumlog'", IN)
def cumlog_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_working(spark, sf_dir).where("space = 'cumlog'").select("unit_id", "asset", "date", "work"), 8, "work")


@query("SELECT unit_id, asset, date, round(x, 8) + 0.0 AS x FROM own_moves", IN)
def gap_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.increments(_working(spark, sf_dir)).select("unit_id", "asset", "date", "x"), 8, "x")


@query("SELECT unit_id, asset, round(own, 8) AS own, round(med, 8) AS med, ref_panel, proxy, round(factor, 8) AS factor FROM proxies", IN)
def peg_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    panels, units = _panels(spark, sf_dir), inputs.units(spark)
    return rounded(series.peg_proxies(series.increments(_working(spark, sf_dir)), series.reference_moves(panels, units)), 8, "own", "med", "factor")


@query(f"SELECT unit_id, asset, date, {r(7, 'vol')} FROM zs", IN)
def ewma_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rows(spark, sf_dir).select("unit_id", "asset", "date", "vol"), 7, "vol")


@query(f"SELECT unit_id, asset, date, {r(6, 'z', 'lagged')} FROM zs", IN)
def standardized_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rows(spark, sf_dir).select("unit_id", "asset", "date", "z", "lagged"), 6, "z", "lagged")


@query("SELECT unit_id, asset, date, round(roll, 6) AS roll, stress FROM prepared", IN)
def rolling_stress_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rows(spark, sf_dir).select("unit_id", "asset", "date", "roll", "stress"), 6, "roll")


SUMS = "SELECT unit_id, asset, round(sum(x) FILTER (back <= CASE WHEN freq = 'monthly' THEN 1 ELSE 21 END), 6) AS month, round(sum(x) FILTER (back <= CASE WHEN freq = 'monthly' THEN 3 ELSE 63 END), 6) AS quarter FROM prepared GROUP BY ALL"


@query(SUMS, IN)
def recent_window_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.window_sums(_rows(spark, sf_dir)), 6, "month", "quarter")


@query(f"SELECT unit_id, asset, n, {r(8, 'mean', 'sd')}, round(t_stat, 4) AS t_stat, round(prior_drift, 8) + 0.0 AS prior_drift FROM spec", IN)
def prior_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = series.asset_spec(_rows(spark, sf_dir)).select("unit_id", "asset", "n", "mean", "sd", "t_stat", "prior_drift")
    return rounded(rounded(spec, 8, "mean", "sd", "prior_drift"), 4, "t_stat")


@query(f"SELECT unit_id, asset, {r(6, 'mean_level', 'level_factor', 'vol_full', 'vol_lr', 'vol0')} FROM spec", IN)
def level_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("mean_level", "level_factor", "vol_full", "vol_lr", "vol0")
    return rounded(series.asset_spec(_rows(spark, sf_dir)).select("unit_id", "asset", *cols), 6, *cols)


# ---- simulation -----------------------------------------------------------------------------


@query("SELECT * FROM modes", IN)
def joint_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    spec = series.asset_spec(rows)
    return simulate.modes(simulate.aligned(rows, spec), spec).select("unit_id", "n_assets", "n_freq", "aligned_rows", "joint")


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _rows(spark, sf_dir)
    spec = settled(series.asset_spec(rows), "spec")
    together = simulate.aligned(rows, spec)
    return simulate.pools(together, simulate.modes(together, spec), spec), spec, simulate.horizon_steps(spec, inputs.units(spark))


@query("SELECT unit_id, pool, salt, asset, row_id, n, round(shock, 6) + 0.0 AS shock FROM pools", IN)
def pool_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pool(spark, sf_dir)[0].select("unit_id", "pool", "salt", "asset", F.col("row_id").cast("long").alias("row_id"), "n", "shock"), 6, "shock")


@query("SELECT unit_id, asset, horizon, step FROM steps", IN)
def horizon_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir)[2]


@query(f"SELECT unit_id, asset, step, {r(6, 'sigma', 'cum_var')} FROM vol", IN)
def vol_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, spec, steps = _pool(spark, sf_dir)
    return rounded(simulate.vol_path(spec, steps), 6, "sigma", "cum_var")


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    pool, spec, steps = _pool(spark, sf_dir)
    pool, steps = settled(pool, "pools"), settled(steps, "steps")
    plan = simulate.draw_plan(inputs.adjusted_units(spark), inputs.scenario_rows(spark)[0], pool, spec, inputs.N_DRAWS)
    return plan, pool, spec, steps


@query("SELECT unit_id, draw, scenario, pool, round(vol_factor, 8) AS vol_factor FROM plans", IN, ADJUSTED)
def scenario_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_plan(spark, sf_dir)[0].drop("tail"), 8, "vol_factor")


@query("SELECT unit_id, draw, salt, step, pool, n, row_id FROM blocks", IN, ADJUSTED)
def block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.block_index(*_plan(spark, sf_dir)).select("unit_id", "draw", "salt", "step", "pool", "n", "row_id")


@query("SELECT unit_id, asset, step, count(*) AS n, round(avg(cum), 4) AS mean, round(stddev_samp(cum), 4) AS sd FROM walked GROUP BY ALL", IN, ADJUSTED)
def path_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, pool, spec, steps = _plan(spark, sf_dir)
    walked = simulate.paths(simulate.block_index(plan, pool, spec, steps), pool, spec, simulate.vol_path(spec, steps), steps, inputs.scenario_rows(spark)[1])
    return walked.groupBy("unit_id", "asset", "step").agg(F.count("*").alias("n"), F.round(F.avg("cum"), 4).alias("mean"), F.round(F.stddev_samp("cum"), 4).alias("sd"))


def _neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.simulate(_rows(spark, sf_dir), inputs.units(spark), inputs.N_DRAWS)


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenarios, overlays = inputs.scenario_rows(spark)
    return simulate.simulate(_rows(spark, sf_dir), inputs.adjusted_units(spark), inputs.N_DRAWS, scenarios, overlays)


@query(f"SELECT unit_id, draw, asset, horizon, {s(6, 'value')} FROM samples", IN, NEUTRAL)
def forecast_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significant(_neutral(spark, sf_dir), 6, "value")


@query(f"SELECT unit_id, draw, asset, horizon, {s(6, 'value')} FROM samples", IN, ADJUSTED)
def forecast_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significant(_adjusted(spark, sf_dir), 6, "value")


@query(f"SELECT unit_id, asset, horizon, n, {s(6, 'q05', 'q50', 'q95')} FROM quants", IN, NEUTRAL)
def forecast_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significant(simulate.quantiles(_neutral(spark, sf_dir)), 6, "q05", "q50", "q95")


@query(f"SELECT unit_id, asset, horizon, n, {s(6, 'q05', 'q50', 'q95')} FROM quants", IN, inputs.STUDENT_T)
def forecast_student_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of freedom that are no integer, below 2, or more than 8."""
    u = F.col("unit_id")
    units = inputs.units(spark).withColumn("tail_df", F.when(u.startswith("o"), 4.5).when(u.startswith("r"), 1.5).otherwise(12.0))
    return significant(simulate.quantiles(simulate.simulate(_rows(spark, sf_dir), units, inputs.N_DRAWS)), 6, "q05", "q50", "q95")


# ---- evidence -------------------------------------------------------------------------------


@query("""SELECT unit_id, doc_id, day, back FROM (SELECT lang AS unit_id, doc_id::VARCHAR AS doc_id, day, row_number() OVER (PARTITION BY lang ORDER BY day DESC, doc_id::VARCHAR DESC) AS back
FROM (SELECT *, CASE WHEN doc_id % 17 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + (doc_id % 30)::INTEGER, '%Y-%m-%d') END AS day FROM documents) WHERE day <= '2024-01-20') WHERE back <= 16""")
def top_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.latest_docs(inputs.docs(spark, sf_dir), 16, "2024-01-20").select("unit_id", "doc_id", "day", "back")


@query("""WITH d AS (SELECT lang AS unit_id, doc_id, concat('f', doc_id, '.txt') AS file FROM documents),
i AS (SELECT unit_id, file, concat('doc-', doc_id) AS doc_id, 0 AS pos FROM d WHERE doc_id % 3 > 0 UNION ALL SELECT unit_id, file, 'again', 1 FROM d WHERE doc_id % 2 = 0)
SELECT d.unit_id, d.file, coalesce(e.doc_id, concat('f', d.doc_id)) AS doc_id FROM d LEFT JOIN (SELECT unit_id, file, arg_min(doc_id, pos) AS doc_id FROM i GROUP BY ALL) e ON e.unit_id = d.unit_id AND e.file = d.file""")
def index_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("unit_id"), "doc_id", F.concat(F.lit("f"), "doc_id", F.lit(".txt")).alias("file"), "text")
    first = d.where("doc_id % 3 > 0").select("unit_id", "file", F.concat(F.lit("doc-"), "doc_id").alias("doc_id"), F.lit("2024-01-01").alias("day"), F.lit("note").alias("kind"), F.lit(0).alias("pos"))
    again = d.where("doc_id % 2 = 0").select("unit_id", "file", F.lit("again").alias("doc_id"), F.lit("").alias("day"), F.lit("").alias("kind"), F.lit(1).alias("pos"))
    return evidence.indexed_docs(first.unionByName(again), d.select("unit_id", "file", "text")).select("unit_id", "file", "doc_id")


@query("SELECT lang AS unit_id, doc_id::VARCHAR AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncached_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("unit_id"), F.col("doc_id").cast("string").alias("doc_id"))
    return evidence.uncached(d, inputs.cards(spark, sf_dir))


@query(f"SELECT unit_id, asset, {r(8, 'implied', 'share')}, agree FROM stats", EV)
def evidence_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evidence.card_stats(inputs.cards(spark, sf_dir)), 8, "implied", "share")


@query("SELECT unit_id, flagged, bin AS binary FROM evs", EV)
def real_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.events(inputs.cards(spark, sf_dir))


@query("""SELECT s.unit_id, s.asset, round(CASE WHEN abs(implied) > 0.02 THEN implied END, 8) AS drift,
round(CASE WHEN abs(CASE WHEN flagged THEN 1.3 ELSE 1.0 END * (1.0 + 0.2 * share) - 1.0) > 0.02 THEN round_even(CASE WHEN flagged THEN 1.3 ELSE 1.0 END * (1.0 + 0.2 * share), 2) END, 8) AS vol_mult, CASE WHEN flagged THEN 6.0::DOUBLE END AS tail_df,
round(least(0.6, 0.1 + CASE WHEN flagged THEN 0.15 ELSE 0.0 END + 0.2 * max(share) OVER (PARTITION BY s.unit_id)), 8) AS stress_prob,
(SELECT count(DISTINCT doc_id) FROM cards c WHERE c.unit_id = s.unit_id AND try_cast(relevance AS DOUBLE) >= 0.5)::INTEGER AS cited FROM stats s JOIN evs e ON e.unit_id = s.unit_id""", EV)
def fallback_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = inputs.cards(spark, sf_dir)
    out = evidence.fallback(cards, evidence.card_stats(cards), evidence.events(cards))
    return rounded(out.withColumn("cited", F.size("evidence")).drop("evidence"), 8, "drift", "vol_mult", "stress_prob")


def _clean(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cards = inputs.cards(spark, sf_dir)
    return evidence.cleaned(inputs.raw_scenarios(spark, sf_dir), inputs.citations(spark, sf_dir), cards, inputs.docs(spark, sf_dir)), cards


@query(f"SELECT unit_id, scenario, name, asset, {r(8, 'weight', 'drift', 'vol_mult')}, established, n_cited::INTEGER AS n_cited FROM cleaned", EV)
def clean_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir)[0]
    return rounded(rows, 8, "weight", "drift", "vol_mult")


@query("SELECT unit_id, scenario, asset, round(drift, 8) AS drift FROM drifted", EV)
def guardrail_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cards = _clean(spark, sf_dir)
    return rounded(evidence.guarded_drift(rows, evidence.card_stats(cards)).select("unit_id", "scenario", "asset", "drift"), 8, "drift")


@query("SELECT unit_id, scenario, asset, round(drift, 8) AS drift, round(vol_mult, 8) AS vol_mult FROM adjusted WHERE abs(drift) > 1e-9 OR abs(vol_mult - 1.0) > 1e-9", EV)
def guardrail_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.adjustments(inputs.raw_scenarios(spark, sf_dir), inputs.citations(spark, sf_dir), inputs.cards(spark, sf_dir), inputs.docs(spark, sf_dir))
    return rounded(evidence.without_noops(out).select("unit_id", "scenario", "asset", "drift", "vol_mult"), 8, "drift", "vol_mult")


@query("""SELECT unit_id, scenario, asset, problem FROM (SELECT unit_id, scenario, asset, unnest(list_filter([CASE WHEN asset = 'Y' AND unit_id = 'en' THEN 'unknown asset' END,
CASE WHEN try_cast(vol_mult AS DOUBLE) - 0.5 <= 0 THEN 'width not positive' END, CASE WHEN try_cast(vol_mult AS DOUBLE) - 0.5 < 1 AND scenario <> 1 THEN 'narrows without a fact' END], lambda x: x IS NOT NULL)) AS problem FROM raw)
UNION ALL SELECT unit_id, NULL, NULL, 'stress probability' FROM langs WHERE unit_id = 'de'""", EV)
def adjustments_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.raw_scenarios(spark, sf_dir)
    units = raw.select("unit_id").distinct().withColumn("assets", F.when(F.col("unit_id") == "en", F.array(F.lit("X"))).otherwise(F.array(F.lit("X"), F.lit("Y"))))
    units = units.withColumn("stress_prob", F.when(F.col("unit_id") == "de", 0.9))
    given = raw.select("unit_id", "scenario", "asset", (F.expr("try_cast(vol_mult as double)") - 0.5).alias("vol_mult"), (F.col("scenario") == 1).alias("established"))
    return evidence.violations(given, units)


TOLD = "CASE WHEN space = 'diff' THEN printf('%+.3f', {c}) ELSE printf('%+.2f%%', 100 * {c}) END AS change_{c}"


@query(f"""SELECT unit_id, asset, panel, {r(6, 'level')}, round(CASE WHEN space = 'log' THEN level * sd0 ELSE sd0 END, 4) AS sd_in_units, {TOLD.format(c='month')}, {TOLD.format(c='quarter')}, round(vol0 / greatest(vol_lr, 1e-12), 6) AS vol_ratio,
CASE WHEN space = 'cumlog' THEN '+1: positive return of ' || asset WHEN space = 'diff' THEN '+1: higher rate of ' || asset ELSE '+1: higher value of ' || asset END AS direction
FROM (SELECT s.*, anchor AS level, first_sd AS sd0, month, quarter FROM spec s JOIN firststep f ON f.unit_id = s.unit_id AND f.asset = s.asset
JOIN (SELECT unit_id, asset, sum(x) FILTER (back <= CASE WHEN freq = 'monthly' THEN 1 ELSE 21 END) AS month, sum(x) FILTER (back <= CASE WHEN freq = 'monthly' THEN 3 ELSE 63 END) AS quarter FROM prepared GROUP BY ALL) q ON q.unit_id = s.unit_id AND q.asset = s.asset)""", IN, NEUTRAL)
def asset_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    spec = series.asset_spec(rows)
    steps = simulate.horizon_steps(spec, inputs.units(spark))
    out = evidence.asset_context(rows, spec, steps, simulate.vol_path(spec, steps), series.window_sums(rows))
    return rounded(rounded(out, 6, "level", "vol_ratio"), 4, "sd_in_units")


@query("""SELECT event_id, (props::JSON->>'$.k')::DOUBLE AS k, event_type IN ('view') AS yes FROM events""")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))
    k = number(F.get_json_object(json_object(fenced), "$.k"), None)
    return e.select("event_id", k.alias("k"), truthy(F.when(F.col("event_type") == "view", " YES ").otherwise(F.col("event_type"))).alias("yes"))


CURRENCIES = (*DOLLARS_PER, *PER_DOLLAR)
_CURRENCY_LIST = ", ".join(f"'{c}'" for c in CURRENCIES)
_ASSET = "concat(lower(substr(n_name, 1, 2)), '-', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE {pick} END, CASE WHEN s_acctbal > 4000 THEN '_usd' ELSE '.idx' END)"


@query(f"""WITH a AS (SELECT s_suppkey, {_ASSET.format(pick=f"[{_CURRENCY_LIST}][1 + s_suppkey % {len(CURRENCIES)}]")} AS asset, CASE WHEN s_acctbal < 0 THEN 'FX_spot' ELSE r_name END AS panel, CASE n_regionkey WHEN 0 THEN 'cumlog' WHEN 1 THEN 'diff' ELSE 'log' END AS space
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT *, regexp_replace(upper(asset), '[^A-Z]', '', 'g') AS token FROM a),
q AS (SELECT *, regexp_matches(lower(panel), 'fx|transfer') OR substr(token, 1, 3) IN ({_CURRENCY_LIST}) AS quoted, regexp_extract(token, '{'|'.join(DOLLARS_PER)}') AS base, regexp_extract(token, '{'|'.join(PER_DOLLAR)}') AS quote FROM t)
SELECT s_suppkey, CASE WHEN space = 'cumlog' THEN '+1: positive return of ' || asset WHEN quoted AND base <> '' THEN 'dollars per ' || base || ', +1: ' || base || ' gains' WHEN quoted AND quote <> '' THEN quote || ' per dollar, +1: ' || quote || ' loses'
  WHEN space = 'diff' THEN '+1: higher rate of ' || asset ELSE '+1: higher value of ' || asset END AS direction FROM q""")
def direction_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The convention of an asset's name, panel and space, made up from suppliers and their nations."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("supplier", "nation", "region")}
    rows = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    asset = F.expr(_ASSET.format(pick=f"element_at(array({_CURRENCY_LIST}), cast(1 + s_suppkey % {len(CURRENCIES)} as int))"))
    rows = rows.select("s_suppkey", asset.alias("asset"), F.when(F.col("s_acctbal") < 0, "FX_spot").otherwise(F.col("r_name")).alias("panel"), F.expr("CASE n_regionkey WHEN 0 THEN 'cumlog' WHEN 1 THEN 'diff' ELSE 'log' END").alias("space"))
    return rows.select("s_suppkey", direction_hint(F.col("asset"), F.col("panel"), F.col("space")).alias("direction"))


GATES = Config(tail_enabled=True, stress_enabled=True)


@query("""SELECT l.unit_id, CASE WHEN n > 1 AND NOT coalesce(bin, false) THEN NULL WHEN k % 3 = 0 THEN 5.0 WHEN k % 3 = 1 THEN 8.0 WHEN coalesce(bin, false) THEN 6.0 END::DOUBLE AS tail_df,
round(CASE WHEN n > 1 AND NOT coalesce(bin, false) THEN NULL ELSE greatest(CASE k % 3 WHEN 0 THEN 0.05 WHEN 1 THEN 0.6 ELSE 0.1 END, least(0.6, 0.1 + CASE WHEN coalesce(bin, false) THEN 0.15 ELSE 0.0 END + 0.2 * coalesce(hi, 0.0))) END::DOUBLE, 8) AS stress_prob
FROM (SELECT DISTINCT lang AS unit_id, length(lang) + ascii(lang) AS k, 1 + ascii(lang) % 2 AS n FROM documents) l LEFT JOIN evs e ON e.unit_id = l.unit_id LEFT JOIN (SELECT unit_id, max(share) AS hi FROM stats GROUP BY ALL) h ON h.unit_id = l.unit_id""", EV)
def tail_and_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both gates open: answers of degrees of freedom and stress, floored by what the cards say."""
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("unit_id")).distinct().withColumn("k", F.length("unit_id") + F.ascii("unit_id"))
    third = F.col("k") % 3
    raw = langs.select("unit_id", F.when(third == 0, "5").when(third == 1, "20").otherwise("none").alias("tail_df"), F.when(third == 0, "0.05").when(third == 1, "7").alias("stress_prob"))
    cards = inputs.cards(spark, sf_dir)
    out = evidence.tail_and_stress(raw, evidence.card_stats(cards), evidence.events(cards), langs.select("unit_id", (1 + F.ascii("unit_id") % 2).alias("n_assets")), GATES)
    return rounded(out, 8, "stress_prob")


JSON_OF = "CASE WHEN json_valid(regexp_extract(answer, '\\{.*\\}', 0, 's')) THEN regexp_extract(answer, '\\{.*\\}', 0, 's')::JSON END"


@query(f"""WITH a AS (SELECT lang AS unit_id, doc_id::VARCHAR AS doc_id, {inputs.answer_sql('card')} AS answer FROM documents),
j AS (SELECT *, {JSON_OF} AS v FROM a)
SELECT unit_id, doc_id, '2024-01-05' AS day, CASE WHEN json_type(v, '$.per_asset.X') = 'OBJECT' THEN 'X' END AS asset, v->>'$.per_asset.X.direction' AS direction, v->>'$.per_asset.X.strength' AS strength, coalesce(v->>'$.per_asset.X.uncertainty', '') AS uncertainty,
  CASE WHEN json_type(v, '$.relevance') = 'BOOLEAN' THEN '1' ELSE v->>'$.relevance' END AS relevance, coalesce(json_array_length(v, '$.established_facts') > 0, false) AS facts, array_to_string(coalesce(list_slice((v->>'$.established_facts[*]')::VARCHAR[], 1, 3), []), ',') AS fact_list,
  v->>'$.event_in_window.exists' AS event_exists, v->>'$.event_in_window.type' AS event_type, v->>'$.event_in_window.what' AS event_words FROM j WHERE json_type(v, '$.per_asset') = 'OBJECT'""")
def model_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards out of answers with talk around them, broken JSON, fields of wrong types, and an id and date of their own."""
    return answers.card_rows(inputs.answers(spark, sf_dir, "card")).drop("tone", "summary").withColumn("fact_list", F.array_join("fact_list", ","))


@query(f"""WITH a AS (SELECT lang AS unit_id, doc_id::VARCHAR AS doc_id, {inputs.answer_sql('card')} AS answer FROM documents),
j AS (SELECT *, {JSON_OF} AS v FROM a)
SELECT unit_id, doc_id, CASE WHEN v IS NULL THEN 'no JSON object' ELSE 'per_asset is not an object' END AS problem FROM j WHERE v IS NULL OR json_type(v, '$.per_asset') <> 'OBJECT'""")
def model_cards_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.refused(inputs.answers(spark, sf_dir, "card"))


@query(f"""WITH a AS (SELECT doc_id::VARCHAR AS unit_id, {inputs.answer_sql('raw')} AS answer FROM documents),
j AS (SELECT unit_id, {JSON_OF} AS v FROM a),
s AS (SELECT unit_id, unnest(range(4))::INTEGER AS scenario, v FROM j WHERE json_array_length(v, '$.scenarios') > 0),
x AS (SELECT unit_id, scenario, json_extract(v, '$.scenarios[' || scenario || ']') AS x FROM s),
m AS (SELECT *, CASE scenario WHEN 0 THEN 'X' WHEN 3 THEN 'Y' END AS asset FROM x WHERE json_type(x) = 'OBJECT')
SELECT unit_id, scenario, x->>'$.name' AS name, asset, x->>'$.weight' AS weight, CASE scenario WHEN 0 THEN x->>'$.drift.X' WHEN 3 THEN x->>'$.drift.Y' END AS drift,
  CASE WHEN scenario = 0 THEN CASE WHEN json_type(x, '$.vol_mult.X') = 'BOOLEAN' THEN '1' ELSE x->>'$.vol_mult.X' END END AS vol_mult FROM m""")
def model_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw scenarios out of answers; of five entries the first four count, and one of them is no object."""
    given = inputs.answers(spark, sf_dir, "raw").select(F.col("doc_id").alias("unit_id"), "answer")
    return answers.scenario_rows(given)[0]


# ---- calibration ----------------------------------------------------------------------------

POOLED = "SELECT panel, asset, date, median(value) AS value FROM panels GROUP BY ALL"
OUTCOMES = """outcomes AS (SELECT unit_id, asset, horizon, value FROM (SELECT *, bool_and(value IS NOT NULL) OVER (PARTITION BY unit_id) AS whole FROM (
SELECT c.unit_id, c.asset, c.horizon, coalesce(d.value, m.value) AS value FROM (SELECT unit_id, asset, unnest(horizons) AS horizon FROM (SELECT unit_id, horizons, unnest(assets) AS asset FROM units)) c
LEFT JOIN daily_out d ON d.unit_id = c.unit_id AND d.asset = c.asset AND d.horizon = c.horizon
LEFT JOIN month_out m ON m.unit_id = c.unit_id AND m.asset = c.asset AND m.horizon = c.horizon)) WHERE whole)"""
REALIZED = f"""
pooled AS ({POOLED}),
stems AS (SELECT a.*, m.panel, m.pos, m.declared FROM asked a JOIN meta m ON m.unit_id = a.unit_id AND list_contains(m.asset_ids, a.asset)
  UNION ALL SELECT a.*, o.panel, 0, coalesce(m.declared, '') FROM asked a JOIN (SELECT DISTINCT unit_id, panel FROM panels) o ON o.unit_id = a.unit_id LEFT JOIN meta m ON m.unit_id = o.unit_id AND m.panel = o.panel
  WHERE NOT EXISTS (SELECT 1 FROM meta x WHERE x.unit_id = a.unit_id AND list_contains(x.asset_ids, a.asset))),
outrank AS (SELECT a.unit_id, a.cutoff, a.target_type, p.*, a.declared, rank() OVER (PARTITION BY a.unit_id, a.asset ORDER BY a.pos, a.panel) AS rk FROM stems a JOIN pooled p ON p.panel = a.panel AND p.asset = a.asset),
outrows AS (SELECT * FROM outrank WHERE rk = 1),
daily_out AS (SELECT unit_id, asset, row_number() OVER (PARTITION BY unit_id, asset ORDER BY date) AS horizon, CASE WHEN target_type = 'log_return' THEN sum(CASE WHEN target_type = 'log_return' THEN ln(1 + value) END) OVER (PARTITION BY unit_id, asset ORDER BY date) ELSE value END AS value FROM outrows WHERE declared NOT LIKE '%month%' AND date > cutoff),
month_out AS (SELECT o.unit_id, o.asset, d.horizon, o.value FROM outrows o JOIN dues d ON d.unit_id = o.unit_id AND date_trunc('month', d.due)::DATE = o.date WHERE declared LIKE '%month%'),
{OUTCOMES}"""


@query(f"SELECT panel, asset, date, round(value, 6) AS value FROM ({POOLED})", IN)
def pooled_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.pooled(_panels(spark, sf_dir)), 6, "value")


@query("SELECT unit_id, asset, horizon, round(value, 6) AS value FROM outcomes", IN, REALIZED)
def realized_forward_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.realized(_panels(spark, sf_dir), inputs.units(spark)), 6, "value")


@query("""SELECT unit_id, count(*) AS n_cells, round_even(avg(pit), 3) AS pit_mean, round_even(avg((pit BETWEEN 0.25 AND 0.75)::INTEGER), 3) AS in50, round_even(avg((pit BETWEEN 0.05 AND 0.95)::INTEGER), 3) AS in90,
round_even(avg(below01::INTEGER), 3) AS below01, round_even(avg(below05::INTEGER), 3) AS below05, round_even(avg(above95::INTEGER), 3) AS above95, round_even(avg(above99::INTEGER), 3) AS above99, round_even(avg(z), 3) AS z_mean, round_even(max(abs(z)), 2) AS z_absmax
FROM (SELECT s.unit_id, avg((s.value < o.value)::INTEGER) AS pit, (any_value(o.value) - avg(s.value)) / coalesce(nullif(stddev_pop(s.value), 0), 1e-12) AS z, any_value(o.value) < quantile_cont(s.value, 0.01) AS below01, any_value(o.value) < quantile_cont(s.value, 0.05) AS below05,
any_value(o.value) > quantile_cont(s.value, 0.95) AS above95, any_value(o.value) > quantile_cont(s.value, 0.99) AS above99 FROM samples s JOIN outcomes o ON o.unit_id = s.unit_id AND o.asset = s.asset AND o.horizon = s.horizon GROUP BY s.unit_id, s.asset, s.horizon) GROUP BY ALL""", IN, NEUTRAL, REALIZED)
def pit_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = calibrate.realized(_panels(spark, sf_dir), inputs.units(spark))
    return calibrate.pit_stats(calibrate.pit_cells(_neutral(spark, sf_dir), outcomes))


RUNS = """runs AS (SELECT c_name AS unit_id, c_mktsegment AS family, CASE WHEN c_nationkey % 2 = 0 THEN 'level' ELSE 'log_return' END AS target, CASE WHEN c_custkey % 10 > 0 THEN abs(c_acctbal) / 1000 END AS score, greatest(c_acctbal, 0.0) / 2000 AS base FROM customer),
ratios AS (SELECT unit_id, family, target, least(score / base, 4.0) AS ratio FROM runs WHERE base > 0 AND score IS NOT NULL)"""


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    bal = F.col("c_acctbal")
    run = c.select(F.col("c_name").alias("unit_id"), F.col("c_mktsegment").alias("family"), F.when(F.col("c_nationkey") % 2 == 0, "level").otherwise("log_return").alias("target"), F.when(F.col("c_custkey") % 10 > 0, F.abs(bal) / 1000).alias("composite_score"))
    return run, c.select(F.col("c_name").alias("unit_id"), (F.greatest(bal, F.lit(0.0)) / 2000).alias("composite_score"))


@query("""SELECT CASE grouping(family, target) WHEN 3 THEN 'all' WHEN 1 THEN 'family' ELSE 'target' END AS level, CASE grouping(family, target) WHEN 3 THEN '' WHEN 1 THEN family ELSE target END AS name,
count(*) AS n, round(avg(ratio), 6) AS mean, round(median(ratio), 6) AS median, count(*) FILTER (ratio < 1) AS better, round(max(ratio), 6) AS worst FROM ratios GROUP BY GROUPING SETS ((), (family), (target))""", RUNS)
def ratio_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.summary(calibrate.ratios(*_runs(spark, sf_dir))), 6, "mean", "median", "worst")


@query("SELECT unit_id, round(ratio, 6) AS ratio FROM ratios ORDER BY ratios.ratio DESC, unit_id DESC LIMIT 6", RUNS)
def worst_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.worst_units(calibrate.ratios(*_runs(spark, sf_dir))), 6, "ratio")


@query("SELECT " + ", ".join(f"round(avg(CASE WHEN c_custkey % {k + 3} > 0 THEN c_acctbal / 10000 END), 8) AS {c}" for k, c in enumerate(calibrate.CALIBRATION)) + " FROM customer")
def calibration_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = c.select(*[F.when(F.col("c_custkey") % (k + 3) > 0, F.col("c_acctbal") / 10000).otherwise(float("nan")).alias(n) for k, n in enumerate(calibrate.CALIBRATION)])
    return rounded(calibrate.calibration_means(rows), 8, *calibrate.CALIBRATION)


@query(f"""SELECT a.unit_id, a.asset, a.horizon, round((a.q50 - b.q50) / ((b.q95 - b.q05) / 3.29), 6) AS shift, round((a.q95 - a.q05) / nullif(b.q95 - b.q05, 0), 6) AS width
FROM ({f'WITH {IN},{ADJUSTED} SELECT * FROM quants'}) a JOIN ({f'WITH {IN},{NEUTRAL} SELECT * FROM quants'}) b ON a.unit_id = b.unit_id AND a.asset = b.asset AND a.horizon = b.horizon""")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = simulate.quantiles(_adjusted(spark, sf_dir)), simulate.quantiles(_neutral(spark, sf_dir))
    return rounded(calibrate.run_diff(a, b.withColumn("horizon", F.col("horizon").cast("string"))), 6, "shift", "width")


@query("""SELECT c_mktsegment AS family, count(*) AS units, count(*) FILTER (c_custkey % 5 > 0 AND c_custkey % 3 > 0) AS admissible, round(avg(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal / 100 END), 6) AS mean_elapsed FROM customer GROUP BY ALL""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed("c_name", "unit_id")
    units = c.select("unit_id", F.col("c_mktsegment").alias("family"), F.lit("level").alias("target_type"), F.array(F.lit("a")).alias("assets"), F.array(F.lit(1)).alias("horizons"), F.lit("2024-01-01").cast("date").alias("asof"))
    verdicts = c.where("c_custkey % 5 > 0").select("unit_id", (F.col("c_custkey") % 3 > 0).alias("admissible"))
    usage = c.where("c_custkey % 2 = 0").select("unit_id", (F.col("c_acctbal") / 100).alias("elapsed_s"))
    rows = calibrate.run_rows(units, verdicts, usage, c.select("unit_id", F.col("c_acctbal").alias("composite_score")))
    return rounded(rows.groupBy("family").agg(F.count("*").alias("units"), F.count_if("admissible").alias("admissible"), F.avg("elapsed_s").alias("mean_elapsed")), 6, "mean_elapsed")


@query(f"""SELECT count(*) AS cells, round(avg(abs(shift)), 6) AS mean_shift, round(median(width), 6) AS median_width FROM (SELECT (a.q50 - b.q50) / ((b.q95 - b.q05) / 3.29) AS shift, (a.q95 - a.q05) / nullif(b.q95 - b.q05, 0) AS width
FROM ({f'WITH {IN},{ADJUSTED} SELECT * FROM quants'}) a JOIN ({f'WITH {IN},{NEUTRAL} SELECT * FROM quants'}) b ON a.unit_id = b.unit_id AND a.asset = b.asset AND a.horizon = b.horizon)""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = calibrate.run_diff(simulate.quantiles(_adjusted(spark, sf_dir)), simulate.quantiles(_neutral(spark, sf_dir)))
    return rounded(calibrate.diff_summary(diff), 6, "mean_shift", "median_width")


# ---- many units in one call -----------------------------------------------------------------

BATCH_IN, BATCH_DRAWS = inputs.BATCH_INPUTS, inputs.BATCH_DRAWS


_FORECASTS: dict[tuple[str, str], batch.Forecasts] = {}


def _batch(spark: SparkSession, sf_dir: str) -> batch.Forecasts:
    """Its tables are settled, so one run serves several queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FORECASTS:
        panels = _once(spark, sf_dir, "batch-panels", lambda: inputs.panels(spark, sf_dir, batch=True))
        _FORECASTS[key] = batch.forecast(panels, inputs.units(spark, inputs.BATCH), inputs.N_DRAWS, given=spark.createDataFrame(inputs.FILES, inputs.FILE_SCHEMA))
    return _FORECASTS[key]


@query(f"SELECT unit_id, asset, horizon, n, {s(6, 'q05', 'q50', 'q95')} FROM quants", BATCH_IN, BATCH_DRAWS)
def batch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven units at once: four in trouble, one of two frequencies, adjustments for some."""
    return significant(_batch(spark, sf_dir).quantiles, 6, "q05", "q50", "q95")


@query("""SELECT * FROM (VALUES ('brief', 'B', 'fewer than five increments: 3', 'B'), ('aimless', NULL, 'no horizon', ''), ('undated', NULL, 'no as-of date', '')) t(unit_id, asset, problem, known)
UNION ALL SELECT 'ghost', '9-NONE', 'not in any panel up to the as-of', (SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders WHERE o_orderdate::DATE <= DATE '2001-06-29')""")
def batch_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why units could not be forecast, with the assets that their panels do hold."""
    return _batch(spark, sf_dir).problems.withColumn("known", F.array_join("known", ","))


@query("SELECT s.unit_id, s.scenario, count(p.draw) AS n_draws FROM scen s LEFT JOIN plans p ON p.unit_id = s.unit_id AND p.scenario = s.scenario GROUP BY ALL", BATCH_IN, BATCH_DRAWS)
def scenario_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.scenario_draws(_batch(spark, sf_dir))


@query("SELECT unit_id, asset, horizon, round(value, 6) AS value FROM outcomes", BATCH_IN, REALIZED)
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of daily and of monthly series."""
    panels = _once(spark, sf_dir, "batch-panels", lambda: inputs.panels(spark, sf_dir, batch=True))
    return rounded(calibrate.realized(panels.where("unit_id not in ('ghost', 'brief')"), inputs.units(spark, inputs.SOUND)), 6, "value")


@query(f"SELECT p.unit_id, p.asset, p.date, {r(6, 'p.x', 'p.z', 'p.lagged', 'p.roll').replace('AS p.', 'AS ')}, p.stress FROM prepared p", IN)
def bucketed_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of series, dealt out by buckets of 512 rows."""
    rows = buckets.prepared(_panels(spark, sf_dir), inputs.units(spark), size=512, slot_days=730)
    return rounded(rows.select("unit_id", "asset", "date", "x", "z", "lagged", "roll", "stress"), 6, "x", "z", "lagged", "roll")


@query("SELECT unit_id, max(date) AS asof FROM panels GROUP BY ALL UNION ALL SELECT 'none', NULL", IN)
def asof_or_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The as-of of cards without one is the last day of the unit's panels."""
    units = inputs.units(spark).select("unit_id").withColumn("asof", F.lit(None).cast("date"))
    none = units.limit(1).withColumn("unit_id", F.lit("none"))
    return readers.asof_or_latest(units.unionByName(none), _panels(spark, sf_dir))
