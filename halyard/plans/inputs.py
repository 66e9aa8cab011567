"""Units, panels, cards and scenarios over the driver's tables, in Spark and as the SQL of the oracle."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.columns import BINARY, GAMMA_TRIES, SCHEDULED
from halyard.sources.readers import UNIT_SCHEMA

ASOF = date(2001, 6, 29)
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FLAGS = ["AF", "AO", "NF", "NO", "RF", "RO"]
#: unit, family, target type, assets, horizons, panels as (name, declared assets, declared frequency)
UNITS = [
    ("orders_d", "F1", "level", PRIORITIES, [1, 5, 21], [("orders_daily", PRIORITIES, "business_daily"), ("a_decoy", [], "")]),
    ("orders_m", "F2", "level", PRIORITIES[:3], [21, 63], [("orders_monthly", PRIORITIES, "monthly")]),
    ("factors", "F3", "log_return", FLAGS[:3], [1, 10], []),
    ("rates", "F4", "level", FLAGS[2:5], [2, 10], [("rates_daily", FLAGS, "")]),
    ("quotes", "F2", "level", ["PEG", "NO"], [5], [("fx_daily", ["PEG", *FLAGS], "business_daily")]),
]
#: Further units of a batch: series of two frequencies, months with outcomes.
SOUND = [
    *UNITS,
    ("mixed", "F1", "level", ["1-URGENT", "NF"], [5, 21], [("orders_monthly", PRIORITIES, "monthly"), ("rates_daily", FLAGS, "")]),
    ("months", "F2", "level", PRIORITIES[1:3], [21, 42], [("orders_monthly", PRIORITIES, "monthly")]),
]
#: Units in trouble: an asset that no panel holds, three increments, no horizon, no date.
BATCH = [
    *SOUND,
    ("ghost", "F1", "level", ["1-URGENT", "9-NONE"], [5], [("orders_daily", PRIORITIES, "")]),
    ("brief", "F1", "level", ["B"], [5], [("brief", ["B"], "")]),
    ("aimless", "F1", "level", ["1-URGENT"], [], []),
    ("undated", "F1", "level", ["1-URGENT"], [5], []),
]
N_DRAWS = 200


def units(spark: SparkSession, of: list | None = None) -> DataFrame:
    rows = [(u, f, t, "", None if u == "undated" else ASOF, N_DRAWS, a, h, p, None, None) for u, f, t, a, h, p in of or UNITS]
    return spark.createDataFrame(rows, UNIT_SCHEMA)


def _cents(col: str):
    """A mean of amounts that does not depend on the order of addition."""
    return F.sum(F.round(F.col(col) * 100).cast("long")) / (100.0 * F.count("*"))


def panels(spark: SparkSession, sf_dir: str, batch: bool = False) -> DataFrame:
    """Panels of UNITS, and of the units of BATCH."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("date"), "o_totalprice")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("asset"), F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_discount")
    daily = orders.groupBy("asset", "date").agg(_cents("o_totalprice").alias("value"))
    monthly = orders.groupBy("asset", F.trunc("date", "month").cast("date").alias("date")).agg(_cents("o_totalprice").alias("value"))
    shipped = items.groupBy("asset", "date").agg(_cents("l_extendedprice").alias("price"), _cents("l_discount").alias("discount"))
    hole = F.col("date").between("1998-03-01", "1998-06-30")
    peg = F.lit(100.0) + F.dayofmonth("date") / 10000.0

    def rows(df: DataFrame, unit: str, panel: str, value, tie: int = 0, asset=F.col("asset")) -> DataFrame:
        return df.select(F.lit(unit).alias("unit_id"), F.lit(panel).alias("panel"), asset.alias("asset"), "date", value.cast("double").alias("value"), F.lit(tie).alias("tie"))

    parts = [
        rows(daily, "orders_d", "orders_daily", F.col("value")),
        rows(daily.where(F.dayofmonth("date") == 15), "orders_d", "orders_daily", F.lit(-1.0), -1),  # what a later row replaces
        rows(monthly.where("asset = '1-URGENT'"), "orders_d", "a_decoy", F.lit(1.0)),
        rows(monthly, "orders_m", "orders_monthly", F.col("value")),
        rows(shipped, "factors", "factors", F.col("discount") - 0.05),
        rows(shipped.where(~hole), "rates", "rates_daily", F.col("price") / 997 - 30),
        rows(shipped, "quotes", "fx_daily", F.col("price")),
        rows(shipped.where("asset = 'RF'"), "quotes", "fx_daily", peg, asset=F.lit("PEG")),
    ]
    if batch:
        parts += [
            rows(monthly, "mixed", "orders_monthly", F.col("value")), rows(shipped.where(~hole), "mixed", "rates_daily", F.col("price") / 997 - 30), rows(monthly, "months", "orders_monthly", F.col("value")),
            rows(daily, "ghost", "orders_daily", F.col("value")), rows(monthly.where("asset = '1-URGENT' and date < '1995-05-01'"), "brief", "brief", F.col("value"), asset=F.lit("B")),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _list(xs: list) -> str:
    return "[" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in xs) + "]" + ("::VARCHAR[]" if not xs else "")


def _unit_rows(of: list) -> str:
    return ", ".join(f"('{u}', '{f}', '{t}', DATE '{ASOF}', {N_DRAWS}, {_list(a)}, {_list(h)})" for u, f, t, a, h, _ in of)


def _meta_rows(of: list) -> str:
    return ", ".join(f"('{u}', {i}, '{n}', {_list(a)}, '{f}')" for u, *_, p in of for i, (n, a, f) in enumerate(p))


def _cents_sql(c: str) -> str:
    return f"sum(round({c} * 100)::BIGINT) / (100.0 * count(*))"


def u_sql(stream: str, *keys: str) -> str:
    """The oracle's hashed uniform."""
    return f"(('0x' || substr(md5(concat_ws('|', '0', '{stream}', {', '.join(keys)})), 1, 13))::BIGINT / 4503599627370496.0)"


def n_sql(stream: str, *keys: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {u_sql(stream + '.r', *keys)})) * cos(2 * pi() * {u_sql(stream + '.a', *keys)}))"


def chi_sql(*keys: str) -> str:
    """The oracle's chi-square number of tail_df degrees of freedom."""
    up = "(CASE WHEN tail_df / 2 < 1 THEN tail_df / 2 + 1 ELSE tail_df / 2 END - 1.0 / 3.0)"
    tries = []
    for k in range(GAMMA_TRIES):
        x = n_sql(f"gamma{k}", *keys)
        v = f"pow(1.0 + {x} / sqrt({up} * 9), 3)"
        tries.append(f"CASE WHEN {v} > 0 AND ln(1.0 - {u_sql(f'gamma{k}.u', *keys)}) < {x} * {x} * 0.5 + {up} - {up} * {v} + {up} * ln(CASE WHEN {v} > 0 THEN {v} END) THEN {up} * {v} END")
    low = f"CASE WHEN tail_df / 2 < 1 THEN pow(1.0 - {u_sql('gamma.low', *keys)}, 1.0 / (tail_df / 2)) ELSE 1.0 END"
    return f"(coalesce({', '.join(tries)}, {up}) * {low} * 2)"


_MORE_PANELS = """
  UNION ALL SELECT 'mixed', 'orders_monthly', asset, date, value, 0 FROM monthly
  UNION ALL SELECT 'mixed', 'rates_daily', asset, date, price / 997 - 30, 0 FROM shipped WHERE NOT date BETWEEN DATE '1998-03-01' AND DATE '1998-06-30'
  UNION ALL SELECT 'months', 'orders_monthly', asset, date, value, 0 FROM monthly"""


def inputs_sql(of: list, more: str = "") -> str:
    """The CTEs of series, scales and pools of some units."""
    return f"""
units AS (SELECT * FROM (VALUES {_unit_rows(of)}) t(unit_id, family, target_type, cutoff, n_draws_min, assets, horizons)),
meta AS (SELECT * FROM (VALUES {_meta_rows(of)}) t(unit_id, pos, panel, asset_ids, declared)),
daily AS (SELECT o_orderpriority AS asset, o_orderdate::DATE AS date, {_cents_sql('o_totalprice')} AS value FROM orders GROUP BY 1, 2),
monthly AS (SELECT o_orderpriority AS asset, date_trunc('month', o_orderdate)::DATE AS date, {_cents_sql('o_totalprice')} AS value FROM orders GROUP BY 1, 2),
shipped AS (SELECT l_returnflag || l_linestatus AS asset, l_shipdate::DATE AS date, {_cents_sql('l_extendedprice')} AS price, {_cents_sql('l_discount')} AS discount FROM lineitem GROUP BY 1, 2),
panels AS (
  SELECT 'orders_d' AS unit_id, 'orders_daily' AS panel, asset, date, value::DOUBLE AS value, 0 AS tie FROM daily
  UNION ALL SELECT 'orders_d', 'orders_daily', asset, date, -1.0, -1 FROM daily WHERE day(date) = 15
  UNION ALL SELECT 'orders_d', 'a_decoy', asset, date, 1.0, 0 FROM monthly WHERE asset = '1-URGENT'
  UNION ALL SELECT 'orders_m', 'orders_monthly', asset, date, value, 0 FROM monthly
  UNION ALL SELECT 'factors', 'factors', asset, date, discount - 0.05, 0 FROM shipped
  UNION ALL SELECT 'rates', 'rates_daily', asset, date, price / 997 - 30, 0 FROM shipped WHERE NOT date BETWEEN DATE '1998-03-01' AND DATE '1998-06-30'
  UNION ALL SELECT 'quotes', 'fx_daily', asset, date, price, 0 FROM shipped
  UNION ALL SELECT 'quotes', 'fx_daily', 'PEG', date, 100.0 + day(date) / 10000.0, 0 FROM shipped WHERE asset = 'RF'{more}),
asked AS (SELECT unit_id, cutoff, target_type, unnest(assets) AS asset FROM units),
ranked AS (
  SELECT p.*, a.target_type, m.declared, rank() OVER (PARTITION BY p.unit_id, p.asset ORDER BY
    CASE WHEN list_contains(m.asset_ids, p.asset) THEN 0 ELSE 1 END, CASE WHEN list_contains(m.asset_ids, p.asset) THEN m.pos ELSE 0 END, p.panel) AS rk
  FROM panels p JOIN asked a ON p.unit_id = a.unit_id AND p.asset = a.asset AND p.date <= a.cutoff LEFT JOIN meta m ON p.unit_id = m.unit_id AND p.panel = m.panel),
series AS (SELECT unit_id, asset, panel, target_type, declared, date, arg_max(value, tie) AS value FROM ranked WHERE rk = 1 GROUP BY ALL),
gapped AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY unit_id, asset ORDER BY date), date) AS gap FROM series),
typed AS (SELECT *, median(gap) OVER (PARTITION BY unit_id, asset) AS typical FROM gapped),
freqs AS (SELECT *, CASE WHEN lower(coalesce(nullif(declared, ''), CASE WHEN typical >= 20 THEN 'monthly' ELSE 'business_daily' END)) LIKE '%month%' THEN 'monthly' ELSE 'daily' END AS freq,
  CASE WHEN target_type = 'log_return' THEN 'cumlog' WHEN lower(panel) LIKE '%rate%' OR min(value) OVER (PARTITION BY unit_id, asset) <= 0 THEN 'diff' ELSE 'log' END AS space FROM typed),
works AS (SELECT *, CASE space WHEN 'cumlog' THEN sum(CASE WHEN space = 'cumlog' THEN ln(1 + value) END) OVER (PARTITION BY unit_id, asset ORDER BY date) WHEN 'diff' THEN value ELSE ln(CASE WHEN space = 'log' THEN value END) END AS work,
  CASE WHEN space = 'cumlog' THEN 0.0 ELSE last_value(value) OVER (PARTITION BY unit_id, asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS anchor,
  max(date) OVER (PARTITION BY unit_id, asset) AS last_date, avg(value) OVER (PARTITION BY unit_id, asset) AS mean_level FROM freqs),
diffs AS (SELECT *, work - lag(work) OVER (PARTITION BY unit_id, asset ORDER BY date) AS x FROM works),
own_moves AS (SELECT unit_id, asset, panel, freq, space, date, anchor, last_date, mean_level, x FROM diffs WHERE x IS NOT NULL AND gap <= greatest(typical * 10.0, 5.0)),
ref_rows AS (SELECT p.unit_id, p.panel, p.asset, p.date, arg_max(p.value, p.tie) AS value FROM panels p JOIN units u USING (unit_id) WHERE p.date <= u.cutoff AND lower(p.panel) LIKE '%fx%' GROUP BY ALL),
ref_ok AS (SELECT * FROM ref_rows QUALIFY count(*) OVER (PARTITION BY unit_id, panel, asset) >= 100 AND min(value) OVER (PARTITION BY unit_id, panel, asset) > 0),
ref_diff AS (SELECT *, date_diff('day', lag(date) OVER w, date) AS gap, ln(value) - lag(ln(value)) OVER w AS x FROM ref_ok WINDOW w AS (PARTITION BY unit_id, panel, asset ORDER BY date)),
ref_typ AS (SELECT *, median(gap) OVER (PARTITION BY unit_id, panel, asset) AS typical FROM ref_diff),
refs AS (SELECT unit_id, panel, asset, date, x, stddev_samp(x) OVER (PARTITION BY unit_id, panel, asset) AS sd FROM ref_typ WHERE x IS NOT NULL AND gap <= greatest(typical * 10.0, 5.0)),
spreads AS (SELECT unit_id, panel AS ref_panel, asset AS other, any_value(sd) AS sd FROM refs GROUP BY ALL),
owns AS (SELECT unit_id, asset, any_value(panel) AS panel, stddev_samp(x) AS own FROM own_moves WHERE space = 'log' AND freq = 'daily' GROUP BY ALL),
firsts AS (SELECT unit_id, min(ref_panel) AS first_panel FROM spreads GROUP BY ALL),
pairs AS (SELECT o.unit_id, o.asset, o.own, s.ref_panel, s.other, s.sd, median(s.sd) OVER (PARTITION BY o.unit_id, o.asset) AS med
  FROM owns o JOIN firsts f USING (unit_id) JOIN spreads s ON s.unit_id = o.unit_id AND s.ref_panel = CASE WHEN lower(o.panel) LIKE '%fx%' THEN o.panel ELSE f.first_panel END WHERE s.other <> o.asset),
nearest AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY unit_id, asset ORDER BY round(abs(sd - med), 10), other) = 1),
proxies AS (SELECT unit_id, asset, own, med, ref_panel, other AS proxy, 0.5 * med / sd AS factor FROM nearest WHERE own < 0.25 * med),
facts AS (SELECT unit_id, asset, any_value(panel) AS panel, any_value(freq) AS freq, any_value(space) AS space, any_value(anchor) AS anchor, any_value(last_date) AS last_date, any_value(mean_level) AS mean_level FROM own_moves GROUP BY ALL),
moves AS (
  SELECT * FROM own_moves WHERE (unit_id, asset) NOT IN (SELECT unit_id, asset FROM proxies)
  UNION ALL SELECT p.unit_id, p.asset, f.panel, f.freq, f.space, r.date, f.anchor, f.last_date, f.mean_level, r.x * p.factor
  FROM proxies p JOIN refs r ON r.unit_id = p.unit_id AND r.panel = p.ref_panel AND r.asset = p.proxy JOIN facts f ON f.unit_id = p.unit_id AND f.asset = p.asset),
numbered AS (SELECT *, row_number() OVER (PARTITION BY unit_id, asset ORDER BY date) AS rn, count(*) OVER (PARTITION BY unit_id, asset) AS n,
  CASE WHEN freq = 'monthly' THEN 6 ELSE 20 END AS halflife FROM moves),
weighted AS (SELECT *, pow(2.0, (rn - n / 2.0) / halflife) AS weight FROM numbered),
vols AS (SELECT *, CASE WHEN rn >= 5 THEN sqrt(sum(weight * x * x) OVER w / sum(weight) OVER w) END AS vol,
  CASE WHEN n > 2 THEN stddev_samp(x) OVER (PARTITION BY unit_id, asset) ELSE avg(abs(x)) OVER (PARTITION BY unit_id, asset) END AS vol_full
  FROM weighted WINDOW w AS (PARTITION BY unit_id, asset ORDER BY date)),
lags AS (SELECT *, lag(vol) OVER (PARTITION BY unit_id, asset ORDER BY date) AS before FROM vols),
fills AS (SELECT *, first_value(before IGNORE NULLS) OVER (PARTITION BY unit_id, asset ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled,
  last_value(vol) OVER (PARTITION BY unit_id, asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM lags),
zs AS (SELECT *, CASE WHEN filled IS NOT NULL THEN greatest(filled, 0.25 * vol_full) END AS lagged, x / nullif(CASE WHEN filled IS NOT NULL THEN greatest(filled, 0.25 * vol_full) END, 0) AS z,
  CASE WHEN final > 0 THEN final ELSE vol_full END AS vol0 FROM fills),
rolls AS (SELECT *, CASE WHEN freq = 'monthly' THEN CASE WHEN count(x) OVER m >= 3 THEN stddev_samp(x) OVER m END ELSE CASE WHEN count(x) OVER d >= 3 THEN stddev_samp(x) OVER d END END AS roll FROM zs
  WINDOW m AS (PARTITION BY unit_id, asset ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), d AS (PARTITION BY unit_id, asset ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)),
limits AS (SELECT *, CASE WHEN count(roll) OVER (PARTITION BY unit_id, asset) > 20 THEN quantile_cont(roll, 0.85) OVER (PARTITION BY unit_id, asset) END AS limit_ FROM rolls),
prepared AS (SELECT *, coalesce(roll >= limit_, false) AS stress, row_number() OVER (PARTITION BY unit_id, asset ORDER BY date DESC) AS back FROM limits),
spec0 AS (SELECT unit_id, asset, any_value(panel) AS panel, any_value(freq) AS freq, any_value(space) AS space, any_value(anchor) AS anchor, any_value(last_date) AS last_date, any_value(mean_level) AS mean_level,
  any_value(vol_full) AS vol_full, any_value(vol0) AS vol0, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, avg(x) FILTER (back <= 36) AS recent FROM prepared GROUP BY ALL),
spec1 AS (SELECT *, CASE WHEN space = 'diff' AND mean_level > 0 AND anchor > 0 THEN least(1.0, sqrt(abs(anchor / mean_level))) ELSE 1.0 END AS level_factor, mean / (sd / sqrt(n) + 1e-12) AS t_stat FROM spec0),
spec AS (SELECT *, vol_full * level_factor AS vol_lr, CASE WHEN n < 30 THEN 0.0 WHEN space = 'cumlog' THEN 0.0 * mean WHEN space = 'log' AND freq = 'monthly' AND t_stat > 3 THEN 0.5 * (mean + recent) ELSE 0.0 END AS prior_drift FROM spec1),
cells AS (SELECT unit_id, cutoff, unnest(horizons) AS horizon FROM units),
dues AS (SELECT *, (cutoff - greatest(isodow(cutoff) - 5, 0)::INTEGER + (((least(isodow(cutoff) - 1, 4) + horizon) // 5) * 7 + ((least(isodow(cutoff) - 1, 4) + horizon) % 5) - least(isodow(cutoff) - 1, 4))::INTEGER - 45)::DATE AS due FROM cells),
steps AS (SELECT s.unit_id, s.asset, d.horizon, (CASE WHEN s.freq = 'daily' THEN d.horizon ELSE greatest(1, round_even((year(due) - year(last_date)) * 12 + (month(due) - month(last_date)) + (day(due) - day(last_date)) / 30.0, 0)) END)::INTEGER AS step FROM spec s JOIN dues d USING (unit_id)),
longest AS (SELECT unit_id, max(step) AS longest FROM steps GROUP BY ALL),
volrows AS (SELECT unit_id, asset, vol_lr, greatest(vol0, 1.5 * vol_lr) AS start, CASE WHEN freq = 'monthly' THEN 6.0 ELSE 60.0 END AS tau, unnest(range(1, longest + 1))::INTEGER AS step FROM spec JOIN longest USING (unit_id)),
sigmas AS (SELECT unit_id, asset, step, sqrt(greatest(vol_lr * vol_lr + (start * start - vol_lr * vol_lr) * exp(-step / tau), 1e-18)) AS sigma FROM volrows),
vol AS (SELECT *, sum(sigma * sigma) OVER (PARTITION BY unit_id, asset ORDER BY step) AS cum_var FROM sigmas),
sizes AS (SELECT unit_id, count(*) AS n_assets, count(DISTINCT freq) AS n_freq FROM spec GROUP BY ALL),
together AS (SELECT p.*, n_assets, count(*) OVER (PARTITION BY unit_id, date) = n_assets AS complete, max(stress) OVER (PARTITION BY unit_id, date) AS shaken FROM prepared p JOIN sizes USING (unit_id) WHERE z IS NOT NULL),
modes AS (SELECT s.*, coalesce(aligned_rows, 0) AS aligned_rows, n_assets = 1 OR (n_freq = 1 AND coalesce(aligned_rows, 0) >= 60) AS joint FROM sizes s LEFT JOIN (SELECT unit_id, count(DISTINCT date) FILTER (complete) AS aligned_rows FROM together GROUP BY ALL) USING (unit_id)),
poolbase AS (SELECT t.unit_id, t.asset, t.date, t.z, t.x * level_factor AS hard, CASE WHEN joint THEN '*' ELSE t.asset END AS salt, CASE WHEN joint THEN shaken ELSE stress END AS shaken, t.freq,
  row_number() OVER (PARTITION BY t.unit_id, t.asset ORDER BY date DESC) AS back FROM together t JOIN modes m USING (unit_id) JOIN spec s ON s.unit_id = t.unit_id AND s.asset = t.asset WHERE complete OR NOT joint),
poolraw AS (SELECT unit_id, asset, salt, date, 'full' AS pool, z AS raw FROM poolbase UNION ALL SELECT unit_id, asset, salt, date, 'recent', z FROM poolbase WHERE back <= CASE WHEN freq = 'monthly' THEN 36 ELSE 252 END
  UNION ALL SELECT unit_id, asset, salt, date, 'stress', hard FROM poolbase WHERE shaken),
pooln AS (SELECT *, count(*) OVER (PARTITION BY unit_id, asset, pool) AS n, row_number() OVER (PARTITION BY unit_id, asset, pool ORDER BY date) - 1 AS row_id, avg(raw) OVER (PARTITION BY unit_id, asset, pool) AS mean, stddev_samp(raw) OVER (PARTITION BY unit_id, asset, pool) AS sd FROM poolraw),
pools AS (SELECT unit_id, pool, salt, asset, row_id, n, CASE WHEN pool = 'stress' THEN raw ELSE (raw - mean) / coalesce(CASE WHEN n > 2 THEN nullif(sd, 0) END, 1.0) END AS shock FROM pooln)"""


INPUTS = inputs_sql(UNITS)
BATCH_INPUTS = inputs_sql(SOUND, _MORE_PANELS)


def simulation_sql(scenarios: str, overlays: str, tails: str) -> str:
    """The CTEs of draws; scenarios (unit_id, scenario, weight), overlays (unit_id, scenario, asset, drift, vol_mult) and tails (unit_id, tail_df) are queries."""
    path = ("unit_id", "draw", "salt", "step")
    sums = " + ".join(f"CASE WHEN tail_df > {k} THEN pow({n_sql(f'chi{k}', 'd.unit_id', 'd.draw')}, 2) ELSE 0.0 END" for k in range(8))
    chi = f"CASE WHEN tail_df <= 8 AND tail_df = floor(tail_df) THEN {sums} ELSE {chi_sql('d.unit_id', 'd.draw')} END"
    return f"""
scen AS ({scenarios}),
overlays AS ({overlays}),
tails AS ({tails}),
shares AS (SELECT unit_id, scenario, weight / sum(weight) OVER (PARTITION BY unit_id) AS w, max(scenario) OVER (PARTITION BY unit_id) = scenario AS is_last FROM scen),
ends AS (SELECT unit_id, scenario, CASE WHEN is_last THEN 1.0 ELSE sum(w) OVER s END AS high FROM shares WINDOW s AS (PARTITION BY unit_id ORDER BY scenario)),
ranges AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY unit_id ORDER BY scenario), 0.0) AS low FROM ends),
readies AS (SELECT s.unit_id, min(coalesce(c, 0)) >= 30 AS ready FROM spec s LEFT JOIN (SELECT unit_id, asset, count(*) AS c FROM pools WHERE pool = 'stress' GROUP BY ALL) q ON q.unit_id = s.unit_id AND q.asset = s.asset GROUP BY ALL),
drawn AS (SELECT unit_id, unnest(range({N_DRAWS}))::INTEGER AS draw FROM units),
us AS (SELECT d.*, ready, {u_sql('scenario', 'unit_id', 'draw')} AS us, {u_sql('regime', 'unit_id', 'draw')} AS ur, {u_sql('recent', 'unit_id', 'draw')} AS uc, exp(0.25 * {n_sql('vol', 'unit_id', 'draw')} - 0.03125) AS vol_factor FROM drawn d JOIN readies USING (unit_id)),
plans AS (SELECT u.unit_id, draw, scenario, CASE WHEN ur < CASE WHEN ready THEN 0.12 ELSE 0.0 END THEN 'stress' WHEN uc < 0.6 THEN 'recent' ELSE 'full' END AS pool, vol_factor FROM us u JOIN ranges r ON u.unit_id = r.unit_id AND us >= low AND us < high),
poolsize AS (SELECT p.unit_id, p.salt, p.pool, max(p.n) AS n, any_value(s.freq) AS freq FROM pools p JOIN spec s ON s.unit_id = p.unit_id AND s.asset = p.asset GROUP BY ALL),
walk AS (SELECT p.*, z.salt, z.n, z.freq, unnest(range(1, longest + 1))::INTEGER AS step FROM plans p JOIN poolsize z ON p.unit_id = z.unit_id AND p.pool = z.pool JOIN longest l ON l.unit_id = p.unit_id),
jumps AS (SELECT *, step = 1 OR {u_sql('jump', *path)} < 1.0 / CASE WHEN freq = 'monthly' THEN 3 ELSE 7 END AS begins, floor({u_sql('start', *path)} * n)::BIGINT AS start FROM walk),
blocks AS (SELECT *, (last_value(CASE WHEN begins THEN start END IGNORE NULLS) OVER b + step - last_value(CASE WHEN begins THEN step END IGNORE NULLS) OVER b) % n AS row_id FROM jumps
  WINDOW b AS (PARTITION BY unit_id, draw, salt ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tailed AS (SELECT d.unit_id, d.draw, CASE WHEN tail_df IS NULL THEN 1.0 ELSE sqrt(tail_df / ({chi})) END AS tail FROM drawn d LEFT JOIN tails t ON t.unit_id = d.unit_id),
firststep AS (SELECT s.unit_id, s.asset, s.step AS first_step, sqrt(v.cum_var) AS first_sd FROM (SELECT unit_id, asset, arg_min(step, horizon) AS step FROM steps GROUP BY ALL) s JOIN vol v USING (unit_id, asset, step)),
shocked AS (SELECT b.unit_id, b.draw, b.scenario, b.pool, b.vol_factor, b.step, b.n, p.asset, p.shock, v.sigma, s.prior_drift, f.first_step, f.first_sd, t.tail
  FROM blocks b JOIN pools p ON p.unit_id = b.unit_id AND p.pool = b.pool AND p.salt = b.salt AND p.row_id = b.row_id JOIN vol v ON v.unit_id = p.unit_id AND v.asset = p.asset AND v.step = b.step
  JOIN spec s ON s.unit_id = p.unit_id AND s.asset = p.asset JOIN firststep f ON f.unit_id = p.unit_id AND f.asset = p.asset JOIN tailed t ON t.unit_id = b.unit_id AND t.draw = b.draw),
based AS (SELECT *, CASE WHEN pool = 'stress' THEN shock ELSE CASE WHEN n >= 30 THEN shock ELSE {n_sql('gauss', 'unit_id', 'draw', 'asset', 'step')} END * tail * sigma * vol_factor END AS base FROM shocked),
incs AS (SELECT b.unit_id, b.draw, b.asset, b.step, base * coalesce(o.vol_mult, 1.0) + prior_drift + coalesce(o.drift, 0.0) * first_sd / first_step AS inc FROM based b LEFT JOIN overlays o ON o.unit_id = b.unit_id AND o.scenario = b.scenario AND o.asset = b.asset),
walked AS (SELECT *, sum(inc) OVER (PARTITION BY unit_id, draw, asset ORDER BY step) AS cum FROM incs),
samples AS (SELECT w.unit_id, w.draw, w.asset, t.horizon, CASE s.space WHEN 'log' THEN anchor * exp(cum) WHEN 'diff' THEN anchor + cum ELSE cum END AS value
  FROM walked w JOIN steps t ON t.unit_id = w.unit_id AND t.asset = w.asset AND t.step = w.step JOIN spec s ON s.unit_id = w.unit_id AND s.asset = w.asset),
quants AS (SELECT unit_id, asset, horizon, count(*) AS n, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.95) AS q95 FROM samples GROUP BY ALL)"""


NEUTRAL = simulation_sql("SELECT unit_id, 0 AS scenario, 1.0 AS weight FROM units", "SELECT '' AS unit_id, 0 AS scenario, '' AS asset, 0.0 AS drift, 1.0 AS vol_mult WHERE false", "SELECT unit_id, NULL::DOUBLE AS tail_df FROM units")

STUDENT_T = simulation_sql("SELECT unit_id, 0 AS scenario, 1.0 AS weight FROM units", "SELECT '' AS unit_id, 0 AS scenario, '' AS asset, 0.0 AS drift, 1.0 AS vol_mult WHERE false", "SELECT unit_id, CASE WHEN unit_id LIKE 'o%' THEN 4.5 WHEN unit_id LIKE 'r%' THEN 1.5 ELSE 12.0 END AS tail_df FROM units")

SCENARIOS = [("orders_d", 0, 0.6), ("orders_d", 1, 0.4), ("orders_m", 0, 1.0), ("factors", 0, 1.0), ("rates", 0, 2.0), ("rates", 1, -1.0), ("rates", 2, 1.0), ("quotes", 0, 1.0)]
OVERLAYS = [("orders_d", 1, "2-HIGH", 0.4, 1.5), ("orders_d", 0, "5-LOW", -0.2, 1.0), ("rates", 2, "NF", 0.0, 2.0), ("quotes", 0, "PEG", 0.3, 1.2)]
TAILS = {"orders_d": 5.0, "factors": 4.0}


def _values(rows: list, names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in rows)}) t({names})"


#: Adjustment files of some units of a batch: unit, scenario, name, weight, asset, drift, vol_mult, established, tail_df; the others are neutral.
FILES = [
    ("orders_d", 0, "calm", 0.6, "5-LOW", -0.2, 1.0, False, 5.0), ("orders_d", 1, "storm", 0.4, "2-HIGH", 0.4, 1.5, False, 5.0), ("rates", 0, "hold", 2.0, "NF", 0.0, 0.9, True, None),
    ("rates", 1, "void", -1.0, "NF", 0.5, 2.0, False, None), ("rates", 2, "cut", 1.0, "NF", -0.3, 2.0, False, None), ("mixed", 0, "one", 1.0, "NF", 0.1, 1.1, False, None),
]
FILE_SCHEMA = "unit_id string, scenario int, name string, weight double, asset string, drift double, vol_mult double, established boolean, tail_df double"
BATCH_DRAWS = simulation_sql(
    f"SELECT unit_id, scenario, greatest(weight, 0.0) AS weight FROM ({_values([r[:2] + r[3:4] for r in FILES], 'unit_id, scenario, weight')}) UNION ALL SELECT unit_id, 0, 1.0 FROM units WHERE unit_id NOT IN ('orders_d', 'rates', 'mixed')",
    _values([r[:2] + r[4:7] for r in FILES], "unit_id, scenario, asset, drift, vol_mult"), "SELECT unit_id, CASE WHEN unit_id = 'orders_d' THEN 5.0 END AS tail_df FROM units",
)


def adjusted_units(spark: SparkSession) -> DataFrame:
    df = F.lit(None).cast("double")
    for u, v in TAILS.items():
        df = F.when(F.col("unit_id") == u, v).otherwise(df)
    return units(spark).withColumn("tail_df", df)


def scenario_rows(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(SCENARIOS, "unit_id string, scenario int, weight double"), spark.createDataFrame(OVERLAYS, "unit_id string, scenario int, asset string, drift double, vol_mult double")


ADJUSTED = simulation_sql(f"SELECT unit_id, scenario, greatest(weight, 0.0) AS weight FROM ({_values(SCENARIOS, 'unit_id, scenario, weight')})", _values(OVERLAYS, "unit_id, scenario, asset, drift, vol_mult"), f"SELECT unit_id, CASE unit_id {' '.join(f'WHEN {u!r} THEN {v}' for u, v in TAILS.items())} END AS tail_df FROM units")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated documents of a unit for each language."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    day = F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd"))
    return rows.select(F.col("lang").alias("unit_id"), F.col("doc_id").cast("string").alias("doc_id"), day.alias("day"), F.col("doc_id").alias("n"), "n_chars")


CARD_COLUMNS = (
    "lang AS unit_id", "cast(doc_id AS {s}) AS doc_id", "asset",
    "CASE WHEN doc_id % 23 = 0 THEN 'up' WHEN asset = 'X' THEN cast(2 * quality - 1 AS {s}) WHEN doc_id % 3 = 0 THEN '1' ELSE '-1' END AS direction",
    "CASE doc_id % 11 WHEN 0 THEN 'NaN' WHEN 1 THEN NULL WHEN 2 THEN 'high' WHEN 3 THEN '1.5' ELSE '0.8' END AS strength",
    "CASE WHEN toxic = 1 THEN 'Higher' WHEN doc_id % 5 = 0 THEN 'lower' ELSE 'same' END AS uncertainty",
    "CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '2' WHEN 2 THEN '0' WHEN 3 THEN '0.25' ELSE '0.75' END AS relevance",
    "quality = 1 AS facts",
    "CASE WHEN doc_id % 13 = 0 THEN ' True' WHEN doc_id % 13 = 1 THEN 'yes' ELSE 'false' END AS event_exists",
    "CASE WHEN doc_id % 4 = 0 THEN 'Scheduled release' WHEN doc_id % 12 = 1 THEN 'binary' ELSE '' END AS event_type",
    "CASE WHEN doc_id % 2 = 0 THEN 'rate decision' WHEN lang = 'en' THEN 'Referendum on the peg' ELSE 'budget' END AS event_words",
)


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for what a model says of each labelled document, with the blemishes of its answers."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    rows = rows.withColumn("asset", F.explode(F.array(F.lit("X"), F.lit("Y"))))
    return rows.selectExpr(*[c.format(s="string") for c in CARD_COLUMNS])


RAW_COLUMNS = (
    "unit_id", "scenario", "concat('case ', cast(scenario AS {s})) AS name", "asset",
    "CASE scenario WHEN 0 THEN '2' WHEN 1 THEN '1.0' WHEN 2 THEN '0.5' WHEN 3 THEN '-3' ELSE 'x' END AS weight",
    "CASE WHEN scenario = 0 AND asset = 'X' THEN '0.9' WHEN scenario = 1 THEN '-0.4' WHEN scenario = 0 THEN '0.1' ELSE NULL END AS drift",
    "CASE scenario WHEN 0 THEN '1.8' WHEN 1 THEN '0.5' WHEN 2 THEN '0.2' WHEN 3 THEN 'wide' ELSE '9' END AS vol_mult",
)

EVIDENCE = f"""
cards AS (SELECT {', '.join(CARD_COLUMNS).format(s='VARCHAR')} FROM (SELECT d.doc_id, d.lang, l.quality, l.toxic, unnest(['X', 'Y']) AS asset FROM documents d JOIN labels l ON l.doc_id = d.doc_id)),
nums AS (SELECT unit_id, doc_id, asset, lower(uncertainty) = 'higher' AS high, greatest(0.0, least(1.0, coalesce(CASE WHEN isfinite(try_cast(relevance AS DOUBLE)) THEN try_cast(relevance AS DOUBLE) END, 0.5))) AS rel,
  coalesce(CASE WHEN isfinite(try_cast(direction AS DOUBLE)) THEN try_cast(direction AS DOUBLE) END, 0.0) AS d,
  greatest(0.0, least(1.0, coalesce(CASE WHEN isfinite(try_cast(strength AS DOUBLE)) THEN try_cast(strength AS DOUBLE) END, 0.5))) AS s FROM cards),
stats AS (SELECT unit_id, asset, coalesce(greatest(-0.5, least(0.5, 0.5 * sum(rel * greatest(-1.0, least(1.0, d)) * s) / nullif(sum(rel), 0))), 0.0) AS implied, coalesce(sum(CASE WHEN high THEN rel ELSE 0.0 END) / nullif(sum(rel), 0), 0.0) AS share,
  greatest(count(*) FILTER (d > 0), count(*) FILTER (d < 0)) AS agree FROM nums GROUP BY ALL),
flags AS (SELECT unit_id, lower(trim(event_exists)) IN ('true', '1', 'yes') AS flagged, lower(trim(event_type)) AS kind, event_words AS words FROM cards),
evs AS (SELECT unit_id, bool_or(flagged) AS flagged, bool_or(flagged AND CASE WHEN kind LIKE 'binary%' THEN true WHEN kind LIKE 'scheduled%' THEN false
  ELSE regexp_matches(words, '(?i)(@BINARY@)') AND NOT regexp_matches(words, '(?i)(@SCHEDULED@)') END) AS bin FROM flags GROUP BY ALL),
langs AS (SELECT DISTINCT lang AS unit_id FROM documents),
rawbase AS (SELECT unit_id, unnest([0, 1, 2, 3, 4]) AS scenario FROM langs),
raw AS (SELECT {', '.join(RAW_COLUMNS).format(s='VARCHAR')} FROM (SELECT *, unnest(['X', 'Y']) AS asset FROM rawbase)),
cites AS (SELECT lang AS unit_id, CASE WHEN d.doc_id % 5 = 2 AND coalesce(quality, 0) <> 1 THEN 3 ELSE d.doc_id % 5 END AS scenario, d.doc_id::VARCHAR AS doc_id, coalesce(quality = 1, false) AS facts FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
cited AS (SELECT unit_id, scenario, list(doc_id ORDER BY doc_id) AS cited, bool_and(facts) AS all_facts FROM cites GROUP BY ALL),
clean0 AS (SELECT r.unit_id, r.scenario, r.name, r.asset, greatest(coalesce(try_cast(weight AS DOUBLE), 0.0), 0.0) AS weight, greatest(-0.75, least(0.75, 0.7 * coalesce(try_cast(drift AS DOUBLE), 0.0))) AS drift,
  1.0 + 0.5 * (greatest(0.6, least(3.0, coalesce(try_cast(vol_mult AS DOUBLE), 1.0))) - 1.0) AS vm, cited, coalesce(all_facts, false) AS all_facts FROM raw r LEFT JOIN cited c ON c.unit_id = r.unit_id AND c.scenario = r.scenario WHERE r.scenario < 4),
clean1 AS (SELECT *, all_facts AND max(abs(drift)) OVER (PARTITION BY unit_id, scenario) <= 0.15 AS established, weight / nullif(sum(weight) OVER (PARTITION BY unit_id, asset), 0) AS w FROM clean0),
cleaned AS (SELECT unit_id, scenario, name, w AS weight, asset, drift, greatest(vm, CASE WHEN established THEN 0.8 ELSE 1.0 END) AS vol_mult, established, coalesce(len(cited), 0) AS n_cited FROM clean1 WHERE w IS NOT NULL),
mixed AS (SELECT c.*, coalesce(implied, 0.0) AS implied, coalesce(share, 0.0) AS share, coalesce(agree, 0) AS agree, sum(weight * drift) OVER (PARTITION BY c.unit_id, c.asset) AS mix FROM cleaned c LEFT JOIN stats s ON s.unit_id = c.unit_id AND s.asset = c.asset),
aimed AS (SELECT *, CASE WHEN implied * mix < 0 AND abs(implied) > 0.05 THEN 0.5 * implied WHEN abs(mix) > abs(implied) + 0.3 THEN sign(mix) * (abs(implied) + 0.3) ELSE mix END - mix AS shift FROM mixed),
drifted AS (SELECT * EXCLUDE (mix, shift, drift), CASE WHEN abs(implied) < 0.20 OR agree < 3 THEN 0.0 WHEN abs(shift) > 1e-6 THEN greatest(-0.75, least(0.75, drift + shift)) ELSE drift END AS drift FROM aimed),
widths AS (SELECT d.*, coalesce(bin, false) AS bin, sum(weight * vol_mult) OVER (PARTITION BY d.unit_id, d.asset) AS mix FROM drifted d LEFT JOIN evs e ON e.unit_id = d.unit_id),
caps AS (SELECT *, share >= 0.25 OR (bin AND share > 0) AS seen, least(CASE WHEN bin THEN 3.0 ELSE 1.6 END, 1.0 + 0.6 * share + CASE WHEN bin THEN 0.15 ELSE 0.0 END) AS cap FROM widths),
goals AS (SELECT *, least(greatest(mix, 1.0), greatest(cap, 1.0)) AS goal FROM caps),
adjusted AS (SELECT unit_id, scenario, weight, asset, drift, established, least(greatest(CASE WHEN NOT seen THEN 1.0 WHEN mix > 0 AND abs(goal - mix) > 1e-6 THEN greatest(0.6, least(3.0, vol_mult * goal / mix)) ELSE vol_mult END, CASE WHEN established THEN 0.8 ELSE 1.0 END), 3.0) AS vol_mult FROM goals)""".replace("@BINARY@", BINARY).replace("@SCHEDULED@", SCHEDULED)


#: What a model might answer about a document, with the blemishes of such answers; SQL of both engines.
_CARD_JSON = (
    """concat('{"doc_id": "made up", "date": "1999-01-01", "relevance": ', CASE doc_id % 5 WHEN 0 THEN '"high"' WHEN 1 THEN 'true' WHEN 2 THEN '0.75' WHEN 3 THEN '"0.25"' ELSE 'null' END, """
    """', "established_facts": ', CASE doc_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["a", "b", "c", "d"]' WHEN 2 THEN '["one"]' ELSE 'null' END, """
    """', "event_in_window": {"exists": ', CASE doc_id % 3 WHEN 0 THEN '"Yes"' WHEN 1 THEN 'true' ELSE 'false' END, ', "type": "binary", "what": "vote"}', """
    """', "per_asset": ', CASE WHEN doc_id % 7 = 0 THEN '["X"]' ELSE concat('{"X": {"direction": ', CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '"-1"' END, ', "strength": 0.5, "uncertainty": "higher"}, "Y": "up"}') END, '}')"""
)
_RAW_JSON = (
    """concat('{"scenarios": ', CASE WHEN doc_id % 7 = 0 THEN '[]' ELSE concat('[{"name": "one", "weight": "0.5", "drift": {"X": 0.4}, "vol_mult": {"X": ', CASE doc_id % 3 WHEN 0 THEN '"1.5"' WHEN 1 THEN 'true' ELSE 'null' END, '}, "evidence": ["', doc_id, '", 7, null]}, "two", {"weight": ', """
    """CASE WHEN doc_id % 2 = 0 THEN '2' ELSE '"lots"' END, '}, {"name": "four", "drift": {"Y": -1}}, {"name": "five"}]') END, ', "tail_df": ', CASE WHEN doc_id % 5 = 0 THEN '"5"' ELSE 'null' END, ', "stress_prob": 0.25}')"""
)
_WRAP = "CASE doc_id % 6 WHEN 0 THEN concat('Sure: ', {j}, ' I hope this helps.') WHEN 1 THEN concat('```json', {nl}, {j}, {nl}, '```') WHEN 2 THEN {j} WHEN 3 THEN concat({j}, '}}') WHEN 4 THEN 'I cannot say.' ELSE concat(' ', {j}) END"


def answer_sql(kind: str, newline: str = "chr(10)") -> str:
    return _WRAP.format(j={"card": _CARD_JSON, "raw": _RAW_JSON}[kind], nl=newline)


def answers(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """unit_id, doc_id, day, answer: an answer about every document."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return rows.select(F.col("lang").alias("unit_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("2024-01-05").alias("day"), F.expr(answer_sql(kind)).alias("answer"))


def raw_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for the scenarios that a model gives for each language; citations has their evidence."""
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("unit_id")).distinct()
    base = langs.withColumn("scenario", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    rows = base.withColumn("asset", F.explode(F.array(F.lit("X"), F.lit("Y"))))
    return rows.selectExpr(*[c.format(s="string") for c in RAW_COLUMNS])


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that back each scenario, a row for each: the scenario is a document's id modulo 5, but what states no fact backs 3, not 2."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").join(labels, "doc_id", "left")
    number = (F.col("doc_id") % 5).cast("int")
    plain = F.coalesce("quality", F.lit(0)) != 1
    return rows.select(F.col("lang").alias("unit_id"), F.when((number == 2) & plain, 3).otherwise(number).alias("scenario"), F.col("doc_id").cast("string").alias("doc_id"))
