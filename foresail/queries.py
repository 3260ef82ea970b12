"""Queries over the business tables, one or more for each operator, and the SQL that another engine runs for the same rows.

Doubles are rounded at the end, as sums differ in the last digits from engine to engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.special import NORMAL, norm_sf_sql, z_value
from .operators import calibration as cal
from .operators import folds, scoring, series
from .operators.folds import tag
from .plans import panels
from .plans.panels import DAILY, LEVELS, MONTHLY, QUARTERLY
from .sources.scratch import kept_once, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Added before rounding: many results are exact halves of the last digit kept, and would go either way.
NUDGE = 3.7e-10


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and a negative zero made a plain one."""
    return df.select(*[(F.round(F.col(c) + NUDGE, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL of an oracle if there is one."""
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- SQL of the panels

def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + {NUDGE!r}, 6) + 0.0 AS {name}"


M_RAW = """m0 AS (SELECT o_orderpriority AS unique_id, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS period, round(sum(o_totalprice) / 1e6, 8) AS y FROM orders GROUP BY ALL),
m1 AS (SELECT * FROM m0 WHERE period < (SELECT max(period) FROM m0)),
m2 AS (SELECT unique_id, unnest(range(min(period), max(period) + 1)) AS period FROM m1 GROUP BY unique_id),
s AS (SELECT unique_id, row_number() OVER (PARTITION BY unique_id ORDER BY period) - 1 AS pos, CAST(period AS BIGINT) AS period, y FROM m2 LEFT JOIN m1 USING (unique_id, period))"""
D_RAW = """d0 AS (SELECT l_returnflag AS unique_id, CAST(l_shipdate AS DATE) AS d, round(sum(l_extendedprice) / 1e6, 8) AS y FROM lineitem WHERE isodow(l_shipdate) < 6 GROUP BY ALL),
s AS (SELECT unique_id, row_number() OVER (PARTITION BY unique_id ORDER BY d) - 1 AS pos, CAST(d - DATE '1970-01-05' AS BIGINT) AS period, y FROM d0)"""
FILL = """f0 AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, last_value(y IGNORE NULLS) OVER b AS y0,
  first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1, first_value(y IGNORE NULLS) OVER a AS y1 FROM s
  WINDOW b AS (PARTITION BY unique_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY unique_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fill AS (SELECT unique_id, pos, y, coalesce(y, y0 + (y1 - y0) * (pos - p0) / nullif(p1 - p0, 0)) AS z FROM f0)"""
RET = """fill AS (SELECT unique_id, pos, y, ln(CASE WHEN y > 0 THEN y END) - ln(CASE WHEN lag(y) OVER (PARTITION BY unique_id ORDER BY pos) > 0 THEN lag(y) OVER (PARTITION BY unique_id ORDER BY pos) END) AS z FROM s)"""

#: Returns of prices on straight lines between those seen.
RETURNS = FILL.replace("fill AS (", "fill0 AS (") + """,
fill AS (SELECT unique_id, pos, y, ln(CASE WHEN z > 0 THEN z END) - ln(CASE WHEN lag(z) OVER w > 0 THEN lag(z) OVER w END) AS z FROM fill0 WINDOW w AS (PARTITION BY unique_id ORDER BY pos))"""


def origins_sql(c) -> str:
    need = c.n_dev + c.n_test

    def count(first: str) -> str:
        return f"CASE WHEN n - 1 - {c.H} - ({first} - 1 + {c.offset}) < 0 THEN 0 ELSE (n - 1 - {c.H} - ({first} - 1 + {c.offset})) // {c.origin_step} + 1 END"

    return f"""o0 AS (SELECT unique_id, count(*) AS n FROM s GROUP BY unique_id),
o1 AS (SELECT *, {count(str(c.initial_window))} < {need} AS reduced FROM o0),
o2 AS (SELECT *, CASE WHEN reduced THEN least(greatest({c.floor_initial}, n - {c.offset} - {c.H} - {c.origin_step} * {need - 1}), {c.initial_window}) ELSE {c.initial_window} END AS initial FROM o1),
o3 AS (SELECT *, {count("initial")} AS c FROM o2),
o4 AS (SELECT *, CASE WHEN c < {need} THEN greatest(1, CAST(round_even(CAST(c AS DOUBLE) * {c.n_test} / {need}, 0) AS BIGINT)) ELSE {c.n_test} END AS t FROM o3 WHERE c >= 2),
o5 AS (SELECT *, CASE WHEN c < {need} THEN c - t ELSE {c.n_dev} END AS dv FROM o4),
o6 AS (SELECT unique_id, n, reduced, CASE WHEN dv < 1 THEN c - 1 ELSE t END AS t, greatest(dv, 1) AS dv, unnest(range(0, c)) AS j FROM o5),
plan AS (SELECT unique_id, CAST(n - 1 - {c.H} - {c.origin_step} * j AS BIGINT) AS origin_t, CASE WHEN j < t THEN 'test' WHEN j < t + dv THEN 'dev' ELSE 'warmup' END AS role, reduced FROM o6)"""


def truth_sql(c) -> str:
    pos = lambda e: f"ln(CASE WHEN {e} > 0 THEN {e} END)"
    value = {"level": "b.y", "returns": f"{pos('b.y')} - {pos('p.y')}", "cumulative_returns": f"{pos('b.y')} - {pos('a.y')}"}[c.target]
    label = (lambda e: f"printf('%04d-%02d', {e} // 12, {e} % 12 + 1)") if c.freq == "monthly" else (lambda e: f"CAST(DATE '1970-01-05' + CAST({e} AS INTEGER) AS VARCHAR)")
    return f"""truth AS (SELECT a.unique_id, a.pos AS origin_t, CAST(h AS BIGINT) AS h, {value} AS y_true, b.y AS level_true, {label("a.period")} AS origin_period, CASE WHEN b.period IS NOT NULL THEN {label("b.period")} END AS target_period
  FROM s a CROSS JOIN (SELECT unnest(range(1, {c.H + 1})) AS h) LEFT JOIN s b ON a.unique_id = b.unique_id AND b.pos = a.pos + h LEFT JOIN s p ON a.unique_id = p.unique_id AND p.pos = a.pos + h - 1)"""


def store_sql(c) -> str:
    """CTEs from ``s`` and ``fill`` to ``store``. Rolling slices are written out row by row, from the first value seen in each on."""
    off, parts = c.offset, []
    sma = "".join(f", CASE WHEN count(z) OVER k{k} = {k} THEN avg(z) OVER k{k} END AS sma_{k}" for k in c.sma_windows)
    frames = "".join(f", k{k} AS (PARTITION BY unique_id ORDER BY pos ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in c.sma_windows)
    names = "".join(f", sma_{k}" for k in c.sma_windows)
    slices = "ewma" in c.models
    for w in c.windows:
        if w == "expanding":
            parts.append(f"""SELECT unique_id, 'expanding' AS "window", pos AS origin_t, y, z AS z_t, count(z) OVER a AS n, first_value(z IGNORE NULLS) OVER a AS z_1, avg(z) OVER a AS mean_z, avg(z * z) OVER a AS mean_z2,
  stddev_samp(z) OVER a AS sd_z, sum(d * d) OVER a AS sum_d2, count(d) OVER a AS n_d, sum(sd * sd) OVER a AS sum_s2, count(sd) OVER a AS n_s, avg(abs(sd)) OVER a AS mase_scale, pos + 1 AS raw{sma}{", list(z) FILTER (z IS NOT NULL) OVER a AS slice" if slices else ""}
  FROM g0 WINDOW a AS (PARTITION BY unique_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW){frames}""")
        else:
            parts.append(f"""SELECT unique_id, 'rolling' AS "window", origin_t, y, z_t, coalesce(n, 0) AS n, z_1, mean_z, mean_z2, sd_z, sum_d2, n_d, sum_s2, n_s, mase_scale, least(origin_t + 1, {c.rolling_length + off}) AS raw{names}{", slice" if slices else ""} FROM
  (SELECT p.unique_id, p.origin_t, g.y, g.z AS z_t{names} FROM plan p JOIN (SELECT unique_id, pos, y, z{sma} FROM g0 WINDOW a AS (PARTITION BY unique_id ORDER BY pos){frames}) g ON g.unique_id = p.unique_id AND g.pos = p.origin_t) LEFT JOIN rolled USING (unique_id, origin_t)""")
    rolling = f"""fs AS (SELECT p.unique_id, p.origin_t, min(g.pos) AS f FROM plan p JOIN s g ON g.unique_id = p.unique_id AND g.pos BETWEEN p.origin_t - {c.rolling_length - 1 + off} AND p.origin_t AND g.y IS NOT NULL GROUP BY ALL),
rr AS (SELECT fs.unique_id, fs.origin_t, g.pos, g.z, CASE WHEN g.pos - 1 >= f + {off} THEN d END AS d, CASE WHEN g.pos - {c.m} >= f + {off} THEN sd END AS sd FROM fs JOIN g0 g ON g.unique_id = fs.unique_id AND g.pos BETWEEN f + {off} AND fs.origin_t),
rolled AS (SELECT unique_id, origin_t, count(z) AS n, arg_min(z, pos) AS z_1, avg(z) AS mean_z, avg(z * z) AS mean_z2, stddev_samp(z) AS sd_z, sum(d * d) AS sum_d2, count(d) AS n_d, sum(sd * sd) AS sum_s2, count(sd) AS n_s, avg(abs(sd)) AS mase_scale
  {", list(z ORDER BY pos) AS slice" if slices else ""} FROM rr GROUP BY ALL),
"""
    k = f"((h - 1) // {c.m})"
    slope = "((z_t - z_1) / nullif(n - 1, 0))"
    known = {
        "naive": ("z_t", "sqrt(sum_d2 / nullif(n_d, 0)) * sqrt(h)", 2), "last_return": ("z_t", "sqrt(sum_d2 / nullif(n_d, 0)) * sqrt(h)", 2),
        "seasonal_naive": ("seas.z", f"sqrt(sum_s2 / nullif(n_s, 0)) * sqrt({k} + 1)", c.m + 1),
        "drift": (f"z_t + h * {slope}", f"sqrt(greatest(sum_d2 - (n - 1) * {slope} * {slope}, 0) / nullif(n_d - 1, 0)) * sqrt(h * (1 + h / CAST(n - 1 AS DOUBLE)))", 3),
        "zero_return": ("CAST(0 AS DOUBLE)", "sqrt(mean_z2)", 1), "mean_return": ("mean_z", "sd_z * sqrt(1 + 1 / CAST(n AS DOUBLE))", 3),
        "ewma": ("CAST(0 AS DOUBLE)", "sqrt(list_reduce(slice, lambda acc, x: CAST(0.94 AS DOUBLE) * acc + CAST(0.06 AS DOUBLE) * x * x, list_sum(list_transform(slice, lambda x: x * x)) / len(slice)))", 2),
    }
    rows = [(m, *known[m]) for m in c.models if m in known] + [(f"sma_{w}", f"sma_{w}", "CAST(NULL AS DOUBLE)", w) for w in (c.sma_windows if "sma" in c.models else ())]
    each = " UNION ALL ".join(f"SELECT cells.*, '{m}' AS model, CASE WHEN n >= {least} THEN {mean} END AS mean, CASE WHEN n >= {least} THEN {sd} END AS sd FROM cells" + (
        f" LEFT JOIN fill seas ON seas.unique_id = cells.unique_id AND seas.pos = origin_t + h - {c.m} * ({k} + 1)" if m == "seasonal_naive" else "") for m, mean, sd, least in rows)
    bounds = ", ".join(f"CASE WHEN ok THEN mean - {z_value(x)!r} * sd END AS lo_{tag(x)}, CASE WHEN ok THEN mean + {z_value(x)!r} * sd END AS hi_{tag(x)}" for x in LEVELS)
    return f"""g0 AS (SELECT *, z - lag(z) OVER v AS d, z - lag(z, {c.m}) OVER v AS sd FROM fill WINDOW v AS (PARTITION BY unique_id ORDER BY pos)),
{rolling}facts AS ({" UNION ALL ".join(parts)}),
cells AS (SELECT facts.*, role, CAST(h AS BIGINT) AS h FROM facts JOIN plan USING (unique_id, origin_t) CROSS JOIN (SELECT unnest(range(1, {c.H + 1})) AS h)),
each_ AS ({each}),
st0 AS (SELECT *, y IS NOT NULL AND z_t IS NOT NULL AS seen FROM each_),
st1 AS (SELECT *, seen AND mean IS NOT NULL AS ok FROM st0),
store AS MATERIALIZED (SELECT unique_id, model, "window", origin_t, role AS origin_role, h, y_true, y_true IS NULL AS y_true_missing, CASE WHEN ok THEN mean END AS y_pred, {bounds}, CASE WHEN seen THEN mase_scale END AS mase_scale, CAST(CASE WHEN seen THEN n ELSE raw END AS BIGINT) AS n_train,
  CASE WHEN NOT seen THEN 'skipped' WHEN mean IS NULL THEN 'failed' ELSE 'ok' END AS status FROM st1 JOIN truth USING (unique_id, origin_t, h)),
sc AS (SELECT * FROM store WHERE origin_role = 'test' AND status = 'ok' AND y_true IS NOT NULL AND y_pred IS NOT NULL)"""


M_STORE = ",\n".join([M_RAW, FILL, origins_sql(MONTHLY), truth_sql(MONTHLY), store_sql(MONTHLY)])
D_STORE = ",\n".join([D_RAW, RETURNS, origins_sql(DAILY), truth_sql(DAILY), store_sql(DAILY)])
SELECTION = """dm0 AS (SELECT unique_id, "window", model, avg(abs(y_true - y_pred) / mase_scale) AS dev_mase FROM store WHERE origin_role = 'dev' AND status = 'ok' AND y_true IS NOT NULL AND mase_scale > 0 GROUP BY ALL),
sma0 AS (SELECT unique_id, "window", arg_min(model, (dev_mase, CAST(substr(model, 5) AS INTEGER))) AS sma FROM dm0 WHERE model LIKE 'sma!_%' ESCAPE '!' GROUP BY ALL),
ref AS (SELECT unique_id, "window", any_value(sma) AS sma, arg_min(model, (dev_mase, model)) AS reference, min(dev_mase) AS reference_mase FROM dm0 LEFT JOIN sma0 USING (unique_id, "window")
  WHERE model NOT LIKE 'sma!_%' ESCAPE '!' OR model = sma GROUP BY ALL)"""
PAIRS = """own AS (SELECT unique_id, "window", origin_t, h, abs(y_true - y_pred) AS d_b FROM sc JOIN ref USING (unique_id, "window") WHERE model = reference),
pairs AS (SELECT sc.*, reference, d_b, abs(y_true - y_pred) AS d_a FROM sc JOIN ref USING (unique_id, "window") JOIN own USING (unique_id, "window", origin_t, h))"""
T_CDF = """CASE WHEN {t} = CAST('inf' AS DOUBLE) THEN 1.0 WHEN {t} = CAST('-inf' AS DOUBLE) THEN 0.0 WHEN {t} IS NULL THEN NULL ELSE 0.5 + 0.5 * (CASE WHEN {n} % 2 = 1
  THEN 2 / pi() * (atan({t} / sqrt({n})) + CASE WHEN {n} < 2 THEN 0 ELSE sin(atan({t} / sqrt({n}))) * list_sum(list_transform(range(0, ({n} - 1) // 2), lambda k:
    CASE WHEN k = 0 THEN 1.0 ELSE list_product(list_transform(range(1, k + 1), lambda i: 2.0 * i / (2 * i + 1))) END * pow(cos(atan({t} / sqrt({n}))), 2 * k + 1))) END)
  ELSE sin(atan({t} / sqrt({n}))) * list_sum(list_transform(range(0, {n} // 2), lambda k:
    CASE WHEN k = 0 THEN 1.0 ELSE list_product(list_transform(range(1, k + 1), lambda i: (2.0 * i - 1) / (2 * i))) END * pow(cos(atan({t} / sqrt({n}))), 2 * k))) END) END"""


def dm_sql(key: str, max_h: int, source: str = "pairs") -> str:
    lags = "".join(f", lag(cc, {k}) OVER (PARTITION BY {key} ORDER BY origin_t) AS l{k}" for k in range(1, max_h))
    sums = "".join(f", sum(CASE WHEN {k} < h THEN cc * l{k} END) AS g{k}" for k in range(1, max_h))
    total = " + ".join([f"coalesce(g{k}, 0)" for k in range(1, max_h)] or ["0"])
    cdf = T_CDF.format(t="dm_stat", n="(n - 1)")
    return f"""dA AS (SELECT *, d_a - d_b AS d, d_a - d_b - avg(d_a - d_b) OVER (PARTITION BY {key}) AS cc FROM {source}),
dB AS (SELECT *{lags} FROM dA),
dC AS (SELECT {key}, count(*) AS n, avg(d) AS mean_d, sum(cc * cc) AS g0{sums}, avg(d_a) / nullif(avg(d_b), 0) AS rel_mae, min(d) AS lo, max(d) AS hi FROM dB GROUP BY {key}),
dD AS (SELECT *, g0 / n / n AS zero, (g0 + 2 * ({total})) / n / n AS long FROM dC),
dE AS (SELECT *, CASE WHEN long <= 0 AND h > 1 THEN zero ELSE long END AS var, CASE WHEN long <= 0 AND h > 1 THEN 1 ELSE h END AS lg FROM dD),
dF AS (SELECT *, CASE WHEN n < 5 * h THEN NULL WHEN lo = hi OR var <= 0 THEN CASE WHEN mean_d = 0 THEN 0.0 ELSE sign(mean_d) * CAST('inf' AS DOUBLE) END
  ELSE mean_d / sqrt(CASE WHEN var > 0 THEN var END) * sqrt((n + 1 - 2 * lg + lg * (lg - 1) / CAST(n AS DOUBLE)) / n) END AS dm_stat FROM dE),
dG AS (SELECT *, {cdf} AS dm_p_better FROM dF),
dm AS (SELECT *, least(1.0, 2 * least(dm_p_better, 1 - dm_p_better)) AS dm_p FROM dG)"""


def holm_sql(source: str, p: str, family: str, out: str, name: str) -> str:
    return f"""{name}0 AS (SELECT *, (count(*) OVER (PARTITION BY {family}, {p} IS NULL) - row_number() OVER (PARTITION BY {family}, {p} IS NULL ORDER BY {p}) + 1) * {p} AS adj FROM {source}),
{name} AS (SELECT * EXCLUDE (adj), CASE WHEN {p} IS NOT NULL THEN least(1.0, max(adj) OVER (PARTITION BY {family}, {p} IS NULL ORDER BY {p} ROWS UNBOUNDED PRECEDING)) END AS {out} FROM {name}0)"""


def xlog(count: str, share: str) -> str:
    return f"(CASE WHEN {count} = 0 THEN 0 ELSE {count} * ln(CASE WHEN {share} > 0 THEN {share} END) END)"


def kupiec_sql(x: str, n: str, p: str) -> str:
    return f"greatest(0.0, -2 * ({xlog(f'({n} - {x})', f'(1 - {p})')} + {xlog(x, p)} - {xlog(f'({n} - {x})', f'(1 - {x} / {n})')} - {xlog(x, f'({x} / {n})')}))"


def chi1_sql(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 1.0 ELSE 2 * {norm_sf_sql(f'sqrt({x})')} END)"


IV = "iv AS (" + " UNION ALL ".join(
    f"SELECT unique_id, \"window\", model, origin_t, h, y_true, CAST({x!r} AS DOUBLE) AS level, lo_{tag(x)} AS lo, hi_{tag(x)} AS hi, CAST(y_true < lo_{tag(x)} OR y_true > hi_{tag(x)} AS INTEGER) AS miss FROM sc WHERE lo_{tag(x)} IS NOT NULL" for x in LEVELS) + ")"


# ---------------------------------------------------------------- panels and folds

def monthly_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel's store, written once an application: all score tables read the same rows, and nothing is forecast again."""
    return kept_once(spark, ("monthly-store", sf_dir), lambda: folds.forecasts(panels.monthly(spark, sf_dir), MONTHLY, LEVELS))


def daily_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_once(spark, ("daily-store", sf_dir), lambda: folds.forecasts(panels.daily(spark, sf_dir), DAILY, LEVELS))


@query(f"WITH {M_RAW} SELECT unique_id, pos, period, {r('y', 'y')} FROM s")
def canonical_monthly(spark, sf_dir):
    return panels.monthly(spark, sf_dir)


@query(f"WITH {D_RAW} SELECT unique_id, pos, period, {r('y', 'y')} FROM s")
def canonical_daily(spark, sf_dir):
    return panels.daily(spark, sf_dir)


@query("""WITH e AS (SELECT event_type AS unique_id, CAST(date_diff('hour', TIMESTAMP '1970-01-01', ts) AS BIGINT) AS period, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT unique_id, unnest(range(min(period), max(period) + 1)) AS period FROM e GROUP BY unique_id),
f AS (SELECT c.unique_id, c.period, n FROM c LEFT JOIN e USING (unique_id, period)),
g AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY period) - row_number() OVER (PARTITION BY unique_id, n IS NULL ORDER BY period) AS k FROM f)
SELECT unique_id, CAST(min(period) AS BIGINT) AS first, count(*) AS length FROM g WHERE n IS NULL GROUP BY unique_id, k""")
def gap_islands(spark, sf_dir):
    e = panels.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("unique_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long").alias("pos")).count()
    span = e.groupBy("unique_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    full = span.select("unique_id", F.explode(F.sequence("lo", "hi")).alias("pos")).join(e, ["unique_id", "pos"], "left")
    return series.islands(full, F.col("count").isNull())


@query(f"SELECT o_orderstatus AS unique_id, CAST(o_orderdate AS TIMESTAMP) AS ds, {r('sum(o_totalprice) / 1e6', 'y')} FROM orders GROUP BY ALL")
def duplicates_sum(spark, sf_dir):
    rows = panels.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("unique_id"), F.col("o_orderdate").alias("ds"), (F.col("o_totalprice") / 1e6).alias("y"))
    return series.merged(rows, "sum")


@query(f"SELECT o_orderstatus AS unique_id, CAST(o_orderdate AS TIMESTAMP) AS ds, {r('avg(o_totalprice) / 1e6', 'y')} FROM orders GROUP BY ALL")
def duplicates_mean(spark, sf_dir):
    rows = panels.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("unique_id"), F.col("o_orderdate").alias("ds"), (F.col("o_totalprice") / 1e6).alias("y"))
    return series.merged(rows, "mean")


@query("""WITH p AS (SELECT DISTINCT o_custkey AS k, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS period FROM orders),
d AS (SELECT k, period - lag(period) OVER (PARTITION BY k ORDER BY period) AS step FROM p),
c AS (SELECT k, step, count(*) AS n FROM d WHERE step IS NOT NULL GROUP BY ALL)
SELECT CAST(k AS VARCHAR) AS unique_id, CAST(arg_min(step, (-n, step)) AS BIGINT) AS step FROM c GROUP BY k""")
def frequency_modal_step(spark, sf_dir):
    rows = panels.read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("unique_id"), F.col("o_orderdate").alias("ds"))
    return series.step_counts(rows, "quarterly")


@query(f"""WITH {M_RAW}, a AS (SELECT *, CASE WHEN y IS NOT NULL THEN pos END AS seen, y - lag(y) OVER w AS d, y - avg(y) OVER (PARTITION BY unique_id) AS c FROM s WINDOW w AS (PARTITION BY unique_id ORDER BY pos)),
b AS (SELECT *, seen - coalesce(max(seen) OVER (PARTITION BY unique_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS blank FROM a)
SELECT unique_id, count(*) AS n_rows, count(y) AS n_seen, count(*) - count(y) AS n_missing, min(period) AS first_period, max(period) AS last_period, count(*) FILTER (y = 0) AS n_zero,
count(*) FILTER (y < 0) AS n_negative, {r('min(y)', 'y_min')}, {r('max(y)', 'y_max')}, {r('avg(y)', 'y_mean')}, {r('stddev_samp(y)', 'y_sd')}, {r('median(y)', 'y_median')},
{r('(count(*) - count(y)) / CAST(count(*) AS DOUBLE)', 'missing_share')}, coalesce(greatest(max(blank), count(*) - 1 - max(seen)), count(*)) AS longest_gap, {r('count(*) FILTER (y = 0) / CAST(count(y) AS DOUBLE)', 'zero_share')},
count(*) FILTER (y > 0) AS n_positive, {r('avg(c ** 3) / avg(c ** 2) ** 1.5', 'y_skewness')}, {r('avg(c ** 4) / avg(c ** 2) ** 2 - 3', 'y_kurtosis')}, {r('quantile_cont(y, 0.25)', 'y_q25')}, {r('quantile_cont(y, 0.75)', 'y_q75')},
{r('arg_min(y, seen)', 'y_first')}, {r('arg_max(y, seen)', 'y_last')}, {r('avg(abs(d))', 'mean_step')} FROM b GROUP BY unique_id""")
def validation_profile(spark, sf_dir):
    return series.profile(panels.monthly(spark, sf_dir))


@query("""WITH p AS (SELECT o_custkey AS k, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS period, count(*) AS n FROM orders GROUP BY ALL),
c AS (SELECT k, unnest(range(min(period), max(period) + 1)) AS period FROM p GROUP BY k), f AS (SELECT c.k, c.period, n FROM c LEFT JOIN p USING (k, period)),
g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY period) - row_number() OVER (PARTITION BY k, n IS NULL ORDER BY period) AS i FROM f),
run AS (SELECT k, max(c) AS longest FROM (SELECT k, i, count(*) AS c FROM g WHERE n IS NULL GROUP BY ALL) GROUP BY k),
t AS (SELECT k, count(*) AS rows_, count(n) AS seen FROM f GROUP BY k),
st AS (SELECT k, arg_min(step, (-n, step)) AS step FROM (SELECT k, step, count(*) AS n FROM (SELECT k, period - lag(period) OVER (PARTITION BY k ORDER BY period) AS step FROM p) WHERE step IS NOT NULL GROUP BY ALL) GROUP BY k),
v AS (SELECT t.k, CASE WHEN step <> 1 AND seen >= 3 THEN 'irregular_frequency' WHEN longest > 2 THEN 'long_gap' WHEN rows_ - seen > 0.05 * rows_ THEN 'missing_share' WHEN rows_ < 34 THEN 'too_short' END AS rule
  FROM t LEFT JOIN run USING (k) LEFT JOIN st USING (k))
SELECT CAST(k AS VARCHAR) AS unique_id, rule FROM v WHERE rule IS NOT NULL""")
def validation_rules(spark, sf_dir):
    rows = panels.read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("unique_id"), F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("ds"), F.col("o_totalprice").alias("y"))
    from dataclasses import replace

    config = replace(QUARTERLY, duplicates="sum", H=2, initial_window=12)
    return series.violations(rows, config).select("unique_id", "rule")


@query(f"WITH {M_RAW}, {origins_sql(MONTHLY)} SELECT unique_id, origin_t, role, reduced FROM plan")
def origins_roles(spark, sf_dir):
    return folds.origins(panels.monthly(spark, sf_dir), MONTHLY)


@query(f"WITH {D_RAW}, {origins_sql(DAILY)} SELECT unique_id, origin_t, role, reduced FROM plan")
def origins_trading(spark, sf_dir):
    return folds.origins(panels.daily(spark, sf_dir), DAILY)


for _name, _panel, _raw, _target in (("truth_level", "monthly", M_RAW, "level"), ("truth_returns", "daily", D_RAW, "returns"), ("truth_cumulative", "daily", D_RAW, "cumulative_returns")):
    from dataclasses import replace as _replace

    _config = _replace(MONTHLY if _panel == "monthly" else DAILY, target=_target)

    def _truth(spark, sf_dir, panel=_panel, config=_config):
        return folds.truth(getattr(panels, panel)(spark, sf_dir), config)

    _truth.__name__ = _name
    query(f"WITH {_raw}, {truth_sql(_config)} SELECT unique_id, origin_t, h, {r('y_true', 'y_true')}, {r('level_true', 'level_true')}, origin_period, target_period FROM truth")(_truth)


@query(f"WITH {D_RAW}, {RET} SELECT unique_id, pos, {r('z', 'r')} FROM fill")
def log_returns(spark, sf_dir):
    return series.log_returns(panels.daily(spark, sf_dir)).select("unique_id", "pos", "r")


@query(f"WITH {M_RAW}, {FILL} SELECT unique_id, pos, {r('y', 'y')}, {r('z', 'filled')} FROM fill")
def interpolate(spark, sf_dir):
    return series.interpolated(panels.monthly(spark, sf_dir)).select("unique_id", "pos", "y", "filled")


@query(f"""WITH {M_RAW}, a AS (SELECT *, list(y) FILTER (y IS NOT NULL) OVER w AS v, row_number() OVER (PARTITION BY unique_id ORDER BY pos) AS n FROM s WINDOW w AS (PARTITION BY unique_id ORDER BY pos ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, list_median(v) AS med FROM a), c AS (SELECT *, 1.4826 * list_median(list_transform(v, lambda x: abs(x - med))) AS mad FROM b)
SELECT unique_id, pos, coalesce(n > 24 AND mad > 0 AND abs(y - med) > 4 * mad, false) AS outlier FROM c""")
def outlier_flags(spark, sf_dir):
    return series.outliers(panels.monthly(spark, sf_dir), 12).select("unique_id", "pos", "outlier")


@query(f"""WITH {M_RAW}, a AS (SELECT *, (max(pos) OVER (PARTITION BY unique_id) - pos) // 12 AS b FROM s), c AS (SELECT *, y - lag(y) OVER (PARTITION BY unique_id, b ORDER BY pos) AS d FROM a),
g AS (SELECT unique_id, b, avg(y) AS mean, stddev_samp(d) AS sd, count(y) AS n, min(y) AS low FROM c GROUP BY ALL),
u AS (SELECT unique_id, regr_slope(ln(CASE WHEN n = 12 AND sd > 0 AND mean > 0 THEN sd END), ln(CASE WHEN n = 12 AND sd > 0 AND mean > 0 THEN mean END)) AS slope, count(*) FILTER (n = 12 AND sd > 0 AND mean > 0) AS n_blocks, min(low) AS low FROM g GROUP BY unique_id)
SELECT unique_id, {r('slope', 'slope')}, n_blocks, CASE WHEN low > 0 AND n_blocks >= 3 AND slope > 0.5 THEN 'log' ELSE 'none' END AS transform FROM u""")
def auto_transform_slope(spark, sf_dir):
    return series.auto_transform(panels.monthly(spark, sf_dir), 12)


_FC = ", ".join(r(c, c) for c in ("y_true", "y_pred", "lo_80", "hi_80", "lo_95", "hi_95", "mase_scale"))
_FC_COLUMNS = ["unique_id", "model", "window", "origin_t", "origin_role", "h", "y_true", "y_pred", "lo_80", "hi_80", "lo_95", "hi_95", "mase_scale", "n_train", "status"]
for _model, _which in (("naive", "M"), ("seasonal_naive", "M"), ("drift", "M"), ("sma", "M"), ("zero_return", "D"), ("last_return", "D"), ("mean_return", "D"), ("ewma", "D")):
    def _fc(spark, sf_dir, model=_model, which=_which):
        from dataclasses import replace

        config = replace(MONTHLY if which == "M" else DAILY, models=(model,))
        return folds.forecasts((panels.monthly if which == "M" else panels.daily)(spark, sf_dir), config, LEVELS).select(*_FC_COLUMNS)

    _fc.__name__ = f"fc_{_model}"
    query(f"WITH {M_STORE if _which == 'M' else D_STORE} SELECT unique_id, model, \"window\", origin_t, origin_role, h, {_FC}, n_train, status FROM store WHERE model LIKE '{_model}%'")(_fc)


@query(f'WITH {M_STORE} SELECT unique_id, "window", model, origin_role, status, count(*) AS n, {r("avg(y_pred)", "mean_pred")}, {r("avg(mase_scale)", "mean_scale")} FROM store GROUP BY ALL')
def store_rows(spark, sf_dir):
    return monthly_store(spark, sf_dir).groupBy("unique_id", "window", "model", "origin_role", "status").agg(F.count(F.lit(1)).alias("n"), F.avg("y_pred").alias("mean_pred"), F.avg("mase_scale").alias("mean_scale"))


# ---------------------------------------------------------------- scores

_POINT = f"""count(*) AS n, {r('count(*) / CAST(h AS DOUBLE)', 'n_eff')}, {r('avg(abs(y_true - y_pred))', 'mae')}, {r('sqrt(avg((y_true - y_pred) * (y_true - y_pred)))', 'rmse')}, {r('avg(y_true - y_pred)', 'bias')},
{r('CASE WHEN min(coalesce(mase_scale, 0)) > 0 THEN avg(abs(y_true - y_pred) / nullif(mase_scale, 0)) END', 'mase')}, {r('sum(abs(y_true - y_pred)) / nullif(sum(abs(y_true)), 0)', 'wape')},
{r('100 * avg(coalesce(2 * abs(y_true - y_pred) / nullif(abs(y_true) + abs(y_pred), 0), 0))', 'smape')}, {r('CASE WHEN min(low) > 0 THEN 100 * avg(abs(y_true - y_pred) / nullif(abs(y_true), 0)) END', 'mape')}"""


@query(f'WITH {M_STORE}, q AS (SELECT *, min(y_true) OVER (PARTITION BY unique_id, "window") AS low FROM sc) SELECT unique_id, "window", model, h, {_POINT} FROM q GROUP BY unique_id, "window", model, h')
def point_metrics(spark, sf_dir):
    return scoring.point_metrics(scoring.scorable(monthly_store(spark, sf_dir)))


_PT = norm_sf_sql("pt")


@query(f"""WITH {D_STORE}, b AS (SELECT unique_id, "window", origin_t, h, y_pred AS m FROM sc WHERE model = 'mean_return'), q AS (SELECT sc.*, m FROM sc LEFT JOIN b USING (unique_id, "window", origin_t, h)),
a AS (SELECT unique_id, "window", model, h, count(*) AS n, avg(CAST((y_true > 0) = (y_pred > 0) AS DOUBLE)) AS hit, avg(CAST(y_true > 0 AS DOUBLE)) AS py, avg(CAST(y_pred > 0 AS DOUBLE)) AS px,
  avg(abs(y_true - y_pred)) / nullif(avg(abs(y_true)), 0) AS z1, sqrt(avg((y_true - y_pred) ** 2) / nullif(avg(y_true ** 2), 0)) AS z2, 1 - sum((y_true - y_pred) ** 2) FILTER (m IS NOT NULL) / nullif(sum((y_true - m) ** 2), 0) AS r2 FROM q GROUP BY ALL),
c AS (SELECT *, py * px + (1 - py) * (1 - px) AS ps FROM a),
d AS (SELECT *, ps * (1 - ps) / n - ((2 * py - 1) ** 2 * px * (1 - px) / n + (2 * px - 1) ** 2 * py * (1 - py) / n + 4 * py * px * (1 - py) * (1 - px) / (CAST(n AS DOUBLE) * n)) AS v FROM c),
e AS (SELECT *, CASE WHEN v > 0 AND px NOT IN (0, 1) AND py NOT IN (0, 1) THEN (hit - ps) / sqrt(CASE WHEN v > 0 THEN v END) END AS pt FROM d)
SELECT unique_id, "window", model, h, n, {r('hit', 'dir_acc')}, {r('z1', 'mae_vs_zero')}, {r('z2', 'rmse_vs_zero')}, {r('r2', 'r2_oos')}, {r('pt', 'pt_stat')}, {r(f'CASE WHEN pt IS NOT NULL THEN {_PT} END', 'pt_p')} FROM e""")
def return_metrics(spark, sf_dir):
    return scoring.return_metrics(scoring.scorable(daily_store(spark, sf_dir)))


@query(f'WITH {M_STORE}, {SELECTION} SELECT unique_id, "window", sma, reference, {r("reference_mase", "reference_mase")} FROM ref')
def dev_selection(spark, sf_dir):
    return scoring.dev_selection(monthly_store(spark, sf_dir)).drop("candidate")


@query(f"""WITH {M_STORE}, {SELECTION}, {PAIRS}, {dm_sql('unique_id, "window", model, h', MONTHLY.H)}
SELECT unique_id, "window", model, h, n, {r('rel_mae', 'rel_mae')}, {r('round(dm_stat, 3)', 'dm_stat')}, {r('dm_p', 'dm_p')}, {r('dm_p_better', 'dm_p_better')} FROM dm""")
def pairwise_dm(spark, sf_dir):
    store = monthly_store(spark, sf_dir)
    return scoring.diebold_mariano(scoring.paired(scoring.scorable(store), scoring.dev_selection(store)), scoring.CELL, MONTHLY.H).withColumn("dm_stat", F.round("dm_stat", 3))


@query(f"""WITH {M_STORE}, {SELECTION}, {PAIRS}, {dm_sql('unique_id, "window", model, h', MONTHLY.H)}, {holm_sql('dm', 'dm_p_better', 'unique_id, "window"', 'dm_p_better_holm', 'hm')}
SELECT unique_id, "window", model, h, {r('dm_p_better', 'dm_p_better')}, {r('dm_p_better_holm', 'dm_p_better_holm')} FROM hm""")
def holm(spark, sf_dir):
    out = pairwise_dm(spark, sf_dir)
    return scoring.holm(out, "dm_p_better", ["unique_id", "window"], "dm_p_better_holm").select(*scoring.CELL, "dm_p_better", "dm_p_better_holm")


@query(f"""WITH {M_STORE}, {IV}, g AS (SELECT unique_id, "window", model, h, level, count(*) AS n, avg(1 - miss) AS coverage, CAST(sum(miss) AS DOUBLE) AS misses, avg(hi - lo) AS width,
  avg((hi - lo) + 2 / (1 - level) * greatest(lo - y_true, 0) + 2 / (1 - level) * greatest(y_true - hi, 0)) AS winkler FROM iv GROUP BY ALL),
e AS (SELECT *, CAST(n AS DOUBLE) / h AS ne, misses * (CAST(n AS DOUBLE) / h) / n AS xe FROM g), k AS (SELECT *, {kupiec_sql('xe', 'ne', '(1 - level)')} AS lr FROM e)
SELECT unique_id, "window", model, h, level, n, {r('coverage', 'coverage')}, {r('width', 'width')}, {r('winkler', 'winkler')}, {r('lr', 'kupiec_lr')}, {r(chi1_sql('lr'), 'kupiec_p')} FROM k""")
def interval_metrics(spark, sf_dir):
    rows = scoring.interval_rows(scoring.scorable(monthly_store(spark, sf_dir)), LEVELS)
    return scoring.interval_metrics(rows, LEVELS).drop("band_lo", "band_hi")


def _band(q: float) -> str:
    return f"CAST(list_filter(range(0, k + 1), lambda i: list_sum(list_transform(range(0, i + 1), lambda j: exp(lgamma(k + 1.0) - lgamma(j + 1.0) - lgamma(k - j + 1.0) + j * ln(level) + (k - j) * ln(1 - level)))) >= {q})[1] AS DOUBLE) / k"


@query(f"""WITH {M_STORE}, {IV}, g AS (SELECT unique_id, "window", model, h, level, greatest(1, count(*) // max(h)) AS k FROM iv GROUP BY ALL)
SELECT unique_id, "window", model, h, level, {r(_band(0.025), 'band_lo')}, {r(_band(0.975), 'band_hi')} FROM g""")
def coverage_band(spark, sf_dir):
    rows = scoring.interval_rows(scoring.scorable(monthly_store(spark, sf_dir)), LEVELS)
    return scoring.interval_metrics(rows, LEVELS).select(*scoring.CELL, "level", "band_lo", "band_hi")


@query(f"""WITH {M_STORE}, {IV}, b AS (SELECT *, CASE WHEN h = 1 THEN 'very_short' WHEN h <= 3 THEN 'short' WHEN h <= 12 THEN 'medium' ELSE 'long' END AS bucket FROM iv),
g AS (SELECT unique_id, "window", model, bucket, level, count(*) AS n, count(DISTINCT origin_t) / CAST(max(h) AS DOUBLE) AS ne, avg(1 - miss) AS coverage, avg(hi - lo) AS width, avg(miss) AS share FROM b GROUP BY ALL),
l AS (SELECT *, greatest(1, CAST(floor(ne) AS BIGINT)) AS k, {kupiec_sql('(share * ne)', 'ne', '(1 - level)')} AS lr FROM g)
SELECT unique_id, "window", model, bucket, level, n, {r('ne', 'n_eff')}, {r('coverage', 'coverage')}, {r('width', 'width')}, {r(_band(0.025), 'band_lo')}, {r(_band(0.975), 'band_hi')}, {r(chi1_sql('lr'), 'kupiec_p')} FROM l""")
def interval_buckets(spark, sf_dir):
    return scoring.interval_buckets(scoring.interval_rows(scoring.scorable(monthly_store(spark, sf_dir)), LEVELS), 12, MONTHLY.H)


_LRI = f"-2 * ({xlog('(n00 + n10)', '(1 - p)')} + {xlog('(n01 + n11)', 'p')} - {xlog('n00', '(1 - p0)')} - {xlog('n01', 'p0')} - {xlog('n10', '(1 - p1)')} - {xlog('n11', 'p1')})"


@query(f"""WITH {D_STORE}, {IV}, a AS (SELECT *, lag(miss) OVER (PARTITION BY unique_id, "window", model, h, level ORDER BY origin_t) AS b FROM iv),
g AS (SELECT unique_id, "window", model, h, level, count(*) AS n, CAST(sum(miss) AS DOUBLE) AS x, CAST(count(*) FILTER (b = 0 AND miss = 0) AS DOUBLE) AS n00, CAST(count(*) FILTER (b = 0 AND miss = 1) AS DOUBLE) AS n01,
  CAST(count(*) FILTER (b = 1 AND miss = 0) AS DOUBLE) AS n10, CAST(count(*) FILTER (b = 1 AND miss = 1) AS DOUBLE) AS n11 FROM a GROUP BY ALL),
p AS (SELECT *, n01 / nullif(n00 + n01, 0) AS p0, n11 / nullif(n10 + n11, 0) AS p1, (n01 + n11) / nullif(n00 + n01 + n10 + n11, 0) AS p FROM g),
l AS (SELECT *, CASE WHEN n >= 30 AND p0 IS NOT NULL AND p1 IS NOT NULL THEN greatest(0.0, {_LRI}) END AS lr, {kupiec_sql('x', 'n', '(1 - level)')} AS uc FROM p)
SELECT unique_id, "window", model, h, level, n00, n01, n10, n11, {r('lr', 'lr_ind')}, {r(chi1_sql('lr'), 'ind_p')}, {r('lr + uc', 'lr_cc')}, {r('exp(-(lr + uc) / 2)', 'cc_p')}, coalesce(p1 > p0, false) AS clustered, true AS testable FROM l""")
def christoffersen(spark, sf_dir):
    rows = scoring.interval_rows(scoring.scorable(daily_store(spark, sf_dir)), LEVELS)
    return scoring.christoffersen(rows, [*scoring.CELL, "level"], DAILY.origin_step)


@query(f"""WITH {M_STORE}, ex AS (SELECT unique_id, model, h, origin_t, abs(y_true - y_pred) AS d_b FROM sc WHERE "window" = 'expanding'), ro AS (SELECT unique_id, model, h, origin_t, abs(y_true - y_pred) AS d_a FROM sc WHERE "window" = 'rolling'),
wp AS (SELECT * FROM ro JOIN ex USING (unique_id, model, h, origin_t)), {dm_sql('unique_id, model, h', MONTHLY.H, 'wp')}, mm AS (SELECT unique_id, model, h, avg(d_b) AS me, avg(d_a) AS mr FROM wp GROUP BY ALL),
w0 AS (SELECT *, 1 - dm_p_better AS pe FROM dm JOIN mm USING (unique_id, model, h)), {holm_sql('w0', 'dm_p_better', 'unique_id', 'hr', 'ha')}, {holm_sql('ha', 'pe', 'unique_id', 'he', 'hb')}
SELECT unique_id, model, h, n, {r('rel_mae', 'ratio')}, {r('dm_stat', 'dm_stat')}, {r('dm_p', 'dm_p')}, {r('dm_p_better', 'p_rolling_better')}, {r('me', 'mae_expanding')}, {r('mr', 'mae_rolling')}, {r('pe', 'p_expanding_better')},
{r('hr', 'p_rolling_better_holm')}, {r('he', 'p_expanding_better_holm')} FROM hb""")
def window_gap(spark, sf_dir):
    return scoring.window_gap(scoring.scorable(monthly_store(spark, sf_dir)), MONTHLY.H)


@query(f"""WITH {M_STORE}, {SELECTION}, {PAIRS}, b AS (SELECT unique_id, "window", h, origin_t, ntile(4) OVER (PARTITION BY unique_id, "window", h ORDER BY origin_t) AS block FROM own)
SELECT unique_id, "window", model, h, CAST(block AS INTEGER) AS block, min(origin_t) AS first_origin, max(origin_t) AS last_origin, count(*) AS n, {r('avg(d_a) / nullif(avg(d_b), 0)', 'rel_mae')} FROM pairs JOIN b USING (unique_id, "window", h, origin_t)
WHERE model <> reference GROUP BY unique_id, "window", model, h, block""")
def subperiods(spark, sf_dir):
    store = monthly_store(spark, sf_dir)
    return scoring.subperiods(scoring.scorable(store), scoring.dev_selection(store))


@query(f'WITH {M_STORE} SELECT "window", count(*) AS n, count(*) FILTER (status <> \'ok\') AS failed, round_even(count(*) FILTER (status <> \'ok\') / CAST(count(*) AS DOUBLE), 5) + 0.0 AS share, count(*) FILTER (status <> \'ok\') / CAST(count(*) AS DOUBLE) <= 0.01 AS passed FROM store GROUP BY GROUPING SETS (("window"), ())')
def a4_failed_share(spark, sf_dir):
    return scoring.failed_share(monthly_store(spark, sf_dir))


_RES = 'res AS (SELECT unique_id, "window", model, h, origin_t, y_true - y_pred AS e FROM sc WHERE h = 1)'
def chi_even_sql(x: str, df: int) -> str:
    """The upper tail of chi-squared for an even number of degrees of freedom."""
    return f"(CASE WHEN {x} <= 0 THEN 1.0 ELSE exp(-{x} / 2) * (" + " + ".join(f"({x} / 2) ** {k} / {math.factorial(k)}" for k in range(df // 2)) + ") END)"


def _ljung_ctes(source: str, key: str, order: str, lags: int) -> str:
    """CTE ``lj``: ``key``, n, q of the column e of ``source``."""
    lb = " + ".join(f"(g{k} / nullif(g0, 0)) ** 2 / nullif(n - {k}, 0)" for k in range(1, lags + 1))
    return f"""jc AS (SELECT {key}, {order}, e - avg(e) OVER (PARTITION BY {key}) AS cc FROM {source}), jl AS (SELECT *, {", ".join(f'lag(cc, {k}) OVER (PARTITION BY {key} ORDER BY {order}) AS l{k}' for k in range(1, lags + 1))} FROM jc),
jg AS (SELECT {key}, count(*) AS n, sum(cc * cc) AS g0, {", ".join(f"sum(cc * l{k}) AS g{k}" for k in range(1, lags + 1))} FROM jl GROUP BY ALL),
lj AS (SELECT *, CASE WHEN n >= {2 * lags + 1} AND g0 > 0 THEN CAST(n AS DOUBLE) * (n + 2) * ({lb}) END AS q FROM jg)"""


def _ljung_sql(store: str, lags: int) -> str:
    return f"""WITH {store}, {_RES}, {_ljung_ctes("res", 'unique_id, "window", model', "origin_t", lags)}
SELECT unique_id, "window", model, n, {r('q', 'lb_q')}, {r(f"CASE WHEN q IS NOT NULL THEN {chi_even_sql('q', lags)} END", 'lb_p')} FROM lj"""


def _one_step(store: DataFrame) -> DataFrame:
    return scoring.scorable(store).where("h = 1").withColumn("e", F.col("y_true") - F.col("y_pred"))


_FOLD = ["unique_id", "window", "model"]


@query(_ljung_sql(D_STORE, 10))
def ljung_box(spark, sf_dir):
    """Without a season: ten lags."""
    return scoring.autocorrelation(_one_step(daily_store(spark, sf_dir)), _FOLD, "e", 10)


@query(_ljung_sql(M_STORE, 12))
def ljung_box_season(spark, sf_dir):
    return scoring.autocorrelation(_one_step(monthly_store(spark, sf_dir)), _FOLD, "e", 12)


@query(_ljung_sql(D_STORE, 24))
def ljung_box_two_seasons(spark, sf_dir):
    return scoring.autocorrelation(_one_step(daily_store(spark, sf_dir)), _FOLD, "e", 24)


def _arch_ctes(source: str, key: str, order: str, lags: int) -> str:
    """CTE ``al``: ``key``, n, x of the column e of ``source``, by Gram and Schmidt: each regressor is replaced by what earlier ones leave of it, so the fit is a sum of separate squares."""
    part = f"(PARTITION BY {key})"
    steps = [f"""v AS (SELECT {key}, {order}, e * e / nullif(avg(e * e) OVER {part}, 0) AS sq FROM {source}),
l AS (SELECT *, count(*) OVER {part} AS na, max(sq) OVER {part} - min(sq) OVER {part} AS span, {", ".join(f'lag(sq, {k}) OVER (PARTITION BY {key} ORDER BY {order}) AS l{k}' for k in range(1, lags + 1))} FROM v),
u0 AS (SELECT *, sq - avg(sq) OVER {part} AS t, {", ".join(f"l{k} - avg(l{k}) OVER {part} AS x{k}" for k in range(1, lags + 1))} FROM l WHERE l{lags} IS NOT NULL)"""]
    for k in range(1, lags + 1):
        rest = [f"x{j}" for j in range(k + 1, lags + 1)]
        out = ", ".join([f"{c} - x{k} * coalesce(sum({c} * x{k}) OVER {part} / nullif(sum(x{k} * x{k}) OVER {part}, 0), 0) AS {c}" for c in rest] + [f"x{k}", "t"])
        others = ", ".join([key, "na", "span", *[f"x{j}" for j in range(1, k)]])
        steps.append(f"u{k} AS (SELECT {others}, {out} FROM u{k - 1})")
    fit = " + ".join(f"coalesce(sum(t * x{k}) ** 2 / nullif(sum(x{k} * x{k}), 0), 0)" for k in range(1, lags + 1))
    steps.append(f"al AS (SELECT {key}, count(*) AS n, CASE WHEN any_value(na) >= {2 * lags + 1} AND any_value(span) > 0 AND sum(t * t) > 0 THEN count(*) * least(1.0, ({fit}) / nullif(sum(t * t), 0)) END AS x FROM u{lags} GROUP BY ALL)")
    return ",\n".join(steps)


def _arch_sql(store: str, lags: int) -> str:
    return f"""WITH {store}, {_RES}, {_arch_ctes("res", 'unique_id, "window", model', "origin_t", lags)}
SELECT unique_id, "window", model, n, {r('x', 'arch_lm')}, {r(f"CASE WHEN x IS NOT NULL THEN {chi_even_sql('x', lags)} END", 'arch_p')} FROM al"""


@query(_arch_sql(D_STORE, 4))
def arch_lm(spark, sf_dir):
    """Without a season: four lags."""
    return scoring.arch_lm(_one_step(daily_store(spark, sf_dir)), _FOLD, "e", 4)


@query(_arch_sql(M_STORE, 12))
def arch_lm_season(spark, sf_dir):
    return scoring.arch_lm(_one_step(monthly_store(spark, sf_dir)), _FOLD, "e", 12)


# ---------------------------------------------------------------- calibration and risk

_DOWN, _UP = sorted(LEVELS, reverse=True), sorted(LEVELS)
_TAUS = [round((1 - x) / 2, 12) for x in _DOWN] + [round((1 + x) / 2, 12) for x in _UP]
_QUANTILES = [f"lo_{tag(x)}" for x in _DOWN] + [f"hi_{tag(x)}" for x in _UP]
_PIN = "pin AS (" + " UNION ALL ".join(f"SELECT unique_id, \"window\", model, h, CAST({t!r} AS DOUBLE) AS tau, CASE WHEN y_true >= {q} THEN {t!r} * (y_true - {q}) ELSE ({t!r} - 1) * (y_true - {q}) END AS loss FROM sc WHERE {q} IS NOT NULL" for t, q in zip(_TAUS, _QUANTILES)) + ")"


@query(f'WITH {D_STORE}, {_PIN} SELECT unique_id, "window", model, h, {r("tau", "tau")}, {r("avg(loss)", "pinball")} FROM pin GROUP BY unique_id, "window", model, h, tau')
def pinball(spark, sf_dir):
    return cal.pinball(scoring.scorable(daily_store(spark, sf_dir)), LEVELS)


@query(f"""WITH {D_STORE}, {_PIN}, p AS (SELECT unique_id, "window", model, h, tau, avg(loss) AS v FROM pin GROUP BY ALL), a AS (SELECT *, (tau - lag(tau) OVER w) * (v + lag(v) OVER w) / 2 AS t FROM p WINDOW w AS (PARTITION BY unique_id, "window", model, h ORDER BY tau))
SELECT unique_id, "window", model, h, {r('2 * sum(t)', 'crps')} FROM a GROUP BY unique_id, "window", model, h""")
def crps_grid(spark, sf_dir):
    return cal.crps(scoring.scorable(daily_store(spark, sf_dir)), LEVELS)


_EDGES = [0.0, *_TAUS, 1.0]
_BINS = f"""b0 AS (SELECT unique_id, "window", model, h, {" + ".join(f"CAST({q} <= y_true AS INTEGER)" for q in _QUANTILES)} AS bin FROM sc WHERE {" AND ".join(f"{q} IS NOT NULL" for q in _QUANTILES)}),
b1 AS (SELECT unique_id, "window", model, h, bin, count(*) AS n FROM b0 GROUP BY ALL), ex AS (SELECT * FROM (VALUES {", ".join(f"({k}, CAST({b - a!r} AS DOUBLE))" for k, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))}) v(bin, expected)),
bins AS (SELECT k.unique_id, k."window", k.model, k.h, ex.bin, coalesce(n, 0) AS n, expected FROM (SELECT DISTINCT unique_id, "window", model, h FROM b1) k CROSS JOIN ex LEFT JOIN b1 ON k.unique_id = b1.unique_id AND k."window" = b1."window" AND k.model = b1.model AND k.h = b1.h AND ex.bin = b1.bin)"""


@query(f'WITH {D_STORE}, {_BINS} SELECT unique_id, "window", model, h, bin, n, {r("expected", "expected")} FROM bins')
def pit_bins(spark, sf_dir):
    return cal.pit_bins(scoring.scorable(daily_store(spark, sf_dir)), LEVELS)


@query(f"""WITH {D_STORE}, {_BINS}, t AS (SELECT *, sum(n) OVER (PARTITION BY unique_id, "window", model, h) * expected AS e FROM bins), x AS (SELECT unique_id, "window", model, h, CASE WHEN min(e) >= 5 - 1e-9 THEN sum((n - e) ** 2 / e) END AS x FROM t GROUP BY ALL)
SELECT unique_id, "window", model, h, {r('x', 'chi2')}, 4 AS df, {r('exp(-x / 2) * (1 + x / 2)', 'p')} FROM x""")
def pit_uniformity(spark, sf_dir):
    return cal.pit_uniformity(cal.pit_bins(scoring.scorable(daily_store(spark, sf_dir)), LEVELS))


def _conformal_sql(level: float) -> str:
    """The last 60 scores at each outcome, and for each row those at the last outcome known by then."""
    t = tag(level)
    return f"""s{t} AS MATERIALIZED (SELECT unique_id, model, h, origin_t, list(s) OVER (PARTITION BY unique_id, model, h ORDER BY origin_t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS v
  FROM (SELECT *, greatest(lo_{t} - y_true, y_true - hi_{t}) AS s FROM store WHERE "window" = 'expanding' AND status = 'ok' AND y_true IS NOT NULL AND lo_{t} IS NOT NULL)),
a{t} AS (SELECT a.unique_id, a.model, a.origin_t, a.h, coalesce(len(b.v), 0) AS n, list_sort(b.v) AS v FROM (SELECT *, origin_t - h AS known FROM store WHERE "window" = 'expanding' AND status = 'ok' AND y_true IS NOT NULL AND origin_role IN ('dev', 'test')) a
  ASOF LEFT JOIN s{t} b ON a.unique_id = b.unique_id AND a.model = b.model AND a.h = b.h AND a.known >= b.origin_t),
c{t} AS (SELECT unique_id, model, origin_t, h, 'expanding' AS "window", CASE WHEN n >= 20 THEN n END AS n, CASE WHEN n >= 20 THEN v[CAST(ceil(round_even(least(1.0, ceil((n + 1) * CAST({level!r} AS DOUBLE)) / n) * (n - 1), 9)) AS INTEGER) + 1] END AS q FROM a{t})"""


_CONF = "".join(f", {_conformal_sql(x)}" for x in LEVELS)
_CK = 'unique_id, "window", model, origin_t, h'
_CQ = f"""cq AS (SELECT {_CK}, lo_80 - coalesce(c80.q, 0) AS l80, hi_80 + coalesce(c80.q, 0) AS h80, lo_95 - coalesce(c95.q, 0) AS l95, hi_95 + coalesce(c95.q, 0) AS h95, CASE WHEN c95.q IS NOT NULL THEN c95.n ELSE 0 END AS conformal_n, c95.q AS conformal_q
  FROM store LEFT JOIN c80 USING ({_CK}) LEFT JOIN c95 USING ({_CK}))"""


@query(f"""WITH {M_STORE}{_CONF}, {_CQ} SELECT {_CK}, {r('l80', 'lo_80')}, {r('h80', 'hi_80')}, {r('CASE WHEN conformal_n > 0 THEN least(l80, l95) ELSE l95 END', 'lo_95')}, {r('CASE WHEN conformal_n > 0 THEN greatest(h80, h95) ELSE h95 END', 'hi_95')},
conformal_n, {r('conformal_q', 'conformal_q')} FROM cq""")
def conformal(spark, sf_dir):
    out = cal.conformal(monthly_store(spark, sf_dir), LEVELS, model_window="expanding")
    return out.select("unique_id", "window", "model", "origin_t", "h", "lo_80", "hi_80", "lo_95", "hi_95", "conformal_n", "conformal_q")


_LOSSES = [0.1, 0.3, 0.5, 0.8]
_SCORES = [NORMAL.inv_cdf(t) for t in _TAUS]
_Q4 = ", ".join(_QUANTILES)


def _threshold_sql() -> str:
    values = ", ".join(f"(CAST({x!r} AS DOUBLE), CAST({math.log1p(-x)!r} AS DOUBLE))" for x in _LOSSES)
    z, t = "[" + ", ".join(map(repr, _SCORES)) + "]", "[" + ", ".join(map(repr, _TAUS)) + "]"
    return f"""t0 AS (SELECT sc.*, loss, rr, [{_Q4}] AS q FROM sc CROSS JOIN (VALUES {values}) v(loss, rr)),
t1 AS (SELECT *, len(list_filter(q, lambda x: x <= rr)) AS i, CASE WHEN {" OR ".join(f"{c} IS NULL" for c in _QUANTILES)} THEN 'no_grid' WHEN {" OR ".join(f"{b} < {a}" for a, b in zip(_QUANTILES, _QUANTILES[1:]))} THEN 'crossed_grid'
  WHEN rr < {_QUANTILES[0]} OR rr > {_QUANTILES[-1]} THEN 'outside_grid' ELSE 'ok' END AS state FROM t0),
t2 AS (SELECT *, least(greatest(i - 1, 0), 2) + 1 AS g FROM t1),
t3 AS (SELECT *, {z}[g] + CASE WHEN q[g + 1] > q[g] THEN (rr - q[g]) / (q[g + 1] - q[g]) ELSE 1 END * ({z}[g + 1] - {z}[g]) AS zz, {t}[g] AS ta, {t}[g + 1] AS tb FROM t2),
tp AS (SELECT *, CASE WHEN state = 'ok' THEN {norm_sf_sql('(-zz)')} END AS p_exceed, CASE WHEN state = 'ok' THEN ta WHEN state = 'outside_grid' THEN CASE WHEN rr < q[1] THEN 0.0 ELSE {_TAUS[-1]!r} END END AS p_lo,
  CASE WHEN state = 'ok' THEN tb WHEN state = 'outside_grid' THEN CASE WHEN rr < q[1] THEN {_TAUS[0]!r} ELSE 1.0 END END AS p_hi, y_true <= rr AS realised FROM t3)"""


@query(f'WITH {D_STORE}, {_threshold_sql()} SELECT unique_id, "window", model, origin_t, h, {r("loss", "loss")}, state, {r("p_exceed", "p_exceed")}, {r("p_lo", "p_lo")}, {r("p_hi", "p_hi")}, realised FROM tp')
def threshold_probabilities(spark, sf_dir):
    out = cal.threshold_probabilities(scoring.scorable(daily_store(spark, sf_dir)), LEVELS, _LOSSES)
    return out.select("unique_id", "window", "model", "origin_t", "h", "loss", "state", "p_exceed", "p_lo", "p_hi", "realised")


@query(f"""WITH {D_STORE}, {_threshold_sql()} SELECT unique_id, "window", model, h, {r('loss', 'loss')}, count(*) AS n, count(*) FILTER (state = 'ok') AS answered, count(*) FILTER (state = 'outside_grid') AS outside, count(*) FILTER (state = 'crossed_grid') AS crossed,
{r('avg(p_exceed)', 'p_mean')}, {r("avg(CAST(realised AS INTEGER)) FILTER (state = 'ok')", 'realised')}, count(*) FILTER (state = 'outside_grid' AND realised) AS outside_hits FROM tp GROUP BY unique_id, "window", model, h, loss""")
def threshold_summary(spark, sf_dir):
    return cal.threshold_summary(cal.threshold_probabilities(scoring.scorable(daily_store(spark, sf_dir)), LEVELS, _LOSSES))


@query(f"""WITH {D_STORE}, v AS ({" UNION ALL ".join(f'SELECT unique_id, "window", model, h, y_true, CAST({x!r} AS DOUBLE) AS level, lo_{tag(x)} AS lo FROM sc WHERE lo_{tag(x)} IS NOT NULL' for x in LEVELS)}),
g AS (SELECT unique_id, "window", model, h, level, count(*) AS n, avg(1 - exp(lo)) AS var_mean, max(1 - exp(y_true)) AS worst, count(*) FILTER (y_true <= lo) AS breaches FROM v GROUP BY ALL),
e AS (SELECT *, n / greatest(1.0, h / 5.0) AS ne, breaches * (n / greatest(1.0, h / 5.0)) / n AS xe FROM g), k AS (SELECT *, {kupiec_sql('xe', 'ne', '((1 - level) / 2)')} AS lr FROM e)
SELECT unique_id, "window", model, h, {r('level', 'level')}, n, {r('var_mean', 'var_mean')}, {r('worst', 'worst')}, breaches, {r('lr', 'kupiec_lr')}, {r(chi1_sql('lr'), 'kupiec_p')} FROM k""")
def risk_table(spark, sf_dir):
    return cal.risk_table(scoring.scorable(daily_store(spark, sf_dir)), LEVELS, DAILY.origin_step)


_QUARTER_RAW = """m1 AS (SELECT CAST(o_custkey AS VARCHAR) AS unique_id, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS period, round(sum(o_totalprice) / 1e6, 8) AS y FROM orders GROUP BY ALL),
m2 AS (SELECT unique_id, unnest(range(min(period), max(period) + 1)) AS period FROM m1 GROUP BY unique_id),
s AS (SELECT unique_id, row_number() OVER (PARTITION BY unique_id ORDER BY period) - 1 AS pos, CAST(period AS BIGINT) AS period, y FROM m2 LEFT JOIN m1 USING (unique_id, period))"""
_Q_STORE = ",\n".join([_QUARTER_RAW, FILL, origins_sql(QUARTERLY), truth_sql(QUARTERLY), store_sql(QUARTERLY)])


@query(f'WITH {_Q_STORE} SELECT "window", model, origin_role, h, status, count(*) AS n, {r("avg(abs(y_true - y_pred))", "mae")} FROM store GROUP BY ALL')
def panel_scale(spark, sf_dir):
    """Many short series at once: a series a customer."""
    store = folds.forecasts(panels.quarterly(spark, sf_dir), QUARTERLY, LEVELS)
    return store.groupBy("window", "model", "origin_role", "h", "status").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))


# ---------------------------------------------------------------- fitted models, simulation and bootstraps: numeric kernels, without SQL

def _fitted(panel: str, model: str, **changes) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from dataclasses import replace

        from .operators.backtest import fitted_forecasts

        _ship(spark)
        config = replace(MONTHLY if panel == "monthly" else DAILY, models=(model,) if isinstance(model, str) else model, **changes)
        out = fitted_forecasts(getattr(panels, panel)(spark, sf_dir), config, LEVELS)
        return out.select("unique_id", "model", "window", "origin_t", "origin_role", "h", "y_true", "y_pred", "lo_80", "hi_80", "es_80", "lo_95", "hi_95", "es_95", "n_outliers", "lb_p", "lb_p_2m", "arch_p", "transform", "variant", "status")

    return run


def _ship(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver's path holds it."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


_CUMULATIVE = {"target": "cumulative_returns"}
for _name, _args in {
    "fc_ses": ("monthly", "ses", {}), "fc_ets": ("monthly", "ets", {}), "fc_theta": ("monthly", "theta", {"transform": "auto"}),
    "fc_sarima": ("monthly", "sarima", {}), "fc_ar": ("daily", "ar", {}),
    "fc_garch": ("daily", "garch", {}), "fc_gjr_garch": ("daily", "gjr_garch", {}), "fc_garch_normal": ("daily", "garch_normal", {}),
    "fc_combination": ("monthly", ("theta", "ets", "sarima", "combination"), {}),
    "sim_cumulative": ("daily", ("ewma", "garch"), _CUMULATIVE), "sim_block": ("daily", ("ewma_block", "garch_block"), _CUMULATIVE), "sim_parameter_uncertainty": ("daily", ("garch_pu", "gjr_garch_pu"), _CUMULATIVE),
}.items():
    _run = _fitted(_args[0], _args[1], **_args[2])
    _run.__name__ = _name
    query()(_run)


@query()
def skill_bootstrap(spark, sf_dir):
    from .operators.backtest import bootstrap_skill

    _ship(spark)
    store = monthly_store(spark, sf_dir)
    return bootstrap_skill(scoring.paired(scoring.scorable(store), scoring.dev_selection(store)), 20260922)


@query()
def h_star(spark, sf_dir):
    return scoring.h_star(skill_bootstrap(spark, sf_dir), MONTHLY.H)


@query()
def mcs(spark, sf_dir):
    from .operators.backtest import model_confidence_set

    _ship(spark)
    return model_confidence_set(scoring.scorable(monthly_store(spark, sf_dir)), 20260922)


@query()
def es_backtest(spark, sf_dir):
    from .operators.backtest import shortfall_backtest

    _ship(spark)
    return shortfall_backtest(scoring.scorable(_simulated(spark, sf_dir)), LEVELS, 20260922)


def _simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted("daily", "ewma", **_CUMULATIVE)(spark, sf_dir).withColumn("y_true_missing", F.col("y_true").isNull())


_GATE = {"coverage_lo": 0.7, "coverage_hi": 0.9, "alpha": 0.05, "crps_ratio": 1.05}


def _cell_sql(c, store: str) -> str:
    """CTE ``cell``: coverage with its tests, uniformity and score, a row a cell and level."""
    return f"""WITH {store}, {IV}, a AS (SELECT *, lag(miss) OVER (PARTITION BY unique_id, "window", model, h, level ORDER BY origin_t) AS b FROM iv),
g AS (SELECT unique_id, "window", model, h, level, count(*) AS n, avg(1 - miss) AS coverage, avg(hi - lo) AS width, CAST(sum(miss) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) / max(h) AS ne, CAST(sum(miss) AS DOUBLE) / max(h) AS xe, greatest(1, count(*) // max(h)) AS k,
  avg((hi - lo) + 2 / (1 - level) * greatest(lo - y_true, 0) + 2 / (1 - level) * greatest(y_true - hi, 0)) AS winkler,
  CAST(count(*) FILTER (b = 0 AND miss = 0) AS DOUBLE) AS n00, CAST(count(*) FILTER (b = 0 AND miss = 1) AS DOUBLE) AS n01, CAST(count(*) FILTER (b = 1 AND miss = 0) AS DOUBLE) AS n10, CAST(count(*) FILTER (b = 1 AND miss = 1) AS DOUBLE) AS n11 FROM a GROUP BY ALL),
p AS (SELECT *, n01 / nullif(n00 + n01, 0) AS p0, n11 / nullif(n10 + n11, 0) AS p1, (n01 + n11) / nullif(n00 + n01 + n10 + n11, 0) AS p, {kupiec_sql('xe', 'ne', '(1 - level)')} AS lr, {kupiec_sql('x', 'n', '(1 - level)')} AS uc FROM g),
i AS (SELECT *, h <= {c.origin_step} AS testable, CASE WHEN h <= {c.origin_step} AND n >= 30 AND p0 IS NOT NULL AND p1 IS NOT NULL THEN greatest(0.0, {_LRI}) END AS li FROM p),
{_PIN}, pq AS (SELECT unique_id, "window", model, h, tau, avg(loss) AS v FROM pin GROUP BY ALL), ar AS (SELECT *, (tau - lag(tau) OVER w) * (v + lag(v) OVER w) / 2 AS t FROM pq WINDOW w AS (PARTITION BY unique_id, "window", model, h ORDER BY tau)),
cr AS (SELECT unique_id, "window", model, h, 2 * sum(t) AS crps FROM ar GROUP BY ALL), {_BINS},
be AS (SELECT *, sum(n) OVER (PARTITION BY unique_id, "window", model, h) * expected AS e FROM bins), bx AS (SELECT unique_id, "window", model, h, CASE WHEN min(e) >= 5 - 1e-9 THEN sum((n - e) ** 2 / e) END AS bx FROM be GROUP BY ALL),
cell AS (SELECT *, {chi1_sql('lr')} AS kupiec_p, {chi1_sql('li')} AS ind_p, exp(-(li + uc) / 2) AS cc_p, coalesce(p1 > p0, false) AS clustered, exp(-bx / 2) * (1 + bx / 2) AS pit_p FROM i LEFT JOIN cr USING (unique_id, "window", model, h) LEFT JOIN bx USING (unique_id, "window", model, h))"""


@query(f"""{_cell_sql(MONTHLY, M_STORE)} SELECT unique_id, "window", model, h, level, n, {r('coverage', 'coverage')}, {r('width', 'width')}, {r('winkler', 'winkler')}, {r(_band(0.025), 'band_lo')}, {r(_band(0.975), 'band_hi')}, {r('lr', 'kupiec_lr')}, {r('kupiec_p', 'kupiec_p')},
{r('ind_p', 'ind_p')}, {r('cc_p', 'cc_p')}, clustered, testable, {r('pit_p', 'pit_p')}, {r('crps', 'crps')} FROM cell""")
def calibration_table(spark, sf_dir):
    return cal.calibration_table(scoring.scorable(monthly_store(spark, sf_dir)), LEVELS, MONTHLY.origin_step)


def _gate_sql() -> str:
    checks = {
        "coverage": f"coverage BETWEEN {_GATE['coverage_lo']} AND {_GATE['coverage_hi']}", "kupiec": f"kupiec_p >= {_GATE['alpha']}",
        "independence": f"CASE WHEN ind_p IS NULL THEN true ELSE ind_p >= {_GATE['alpha']} END", "crps": f"cell.crps / nullif(base, 0) < {_GATE['crps_ratio']}",
    }
    each = " UNION ALL ".join(f"SELECT unique_id, \"window\", model, h, '{k}' AS name, coalesce({v}, false) AS passed FROM j" for k, v in checks.items())
    return f"""{_cell_sql(DAILY, D_STORE)}, j AS (SELECT cell.*, base FROM cell LEFT JOIN (SELECT DISTINCT unique_id, "window", h, crps AS base FROM cell WHERE model = 'zero_return') USING (unique_id, "window", h) WHERE level = 0.8),
ck AS ({each.replace("cell.crps", "crps")})"""


@query(f"""{_gate_sql()} SELECT unique_id, "window", model, h, name, passed FROM ck""")
def gate_checks(spark, sf_dir):
    return cal.gate_checks(_gate_table(spark, sf_dir), _GATE)


def _gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cal.calibration_table(scoring.scorable(daily_store(spark, sf_dir)), LEVELS, DAILY.origin_step).where("level = 0.8")
    base = table.where("model = 'zero_return'").select("unique_id", "window", "h", F.col("crps").alias("base"))
    return table.join(base, ["unique_id", "window", "h"], "left").withColumn("crps_ratio", F.try_divide("crps", "base"))


@query(f"""{_gate_sql()} SELECT unique_id, "window", model, count(*) AS n_checks, count(*) FILTER (passed) AS n_passed, bool_and(passed) AS go FROM ck GROUP BY ALL""")
def gate_decision(spark, sf_dir):
    return cal.gate_decision(cal.gate_checks(_gate_table(spark, sf_dir), _GATE))


_PIT = f"""CASE WHEN i = 0 THEN {_TAUS[0]!r} WHEN i > {len(_TAUS) - 1} THEN {_TAUS[-1]!r} ELSE t[i] + (t[i + 1] - t[i]) * (y_true - q[i]) / nullif(q[i + 1] - q[i], 0) END"""


@query(f"""WITH {D_STORE}, a AS (SELECT unique_id, "window", model, origin_t, h, y_true, [{", ".join(_QUANTILES)}] AS q, {_TAUS!r} AS t FROM sc), b AS (SELECT *, len(list_filter(q, lambda v: v <= y_true)) AS i FROM a)
SELECT unique_id, "window", model, origin_t, h, {r(f"CASE WHEN len(list_filter(q, lambda v: v IS NOT NULL)) = {len(_TAUS)} AND list_sort(q) = q THEN {_PIT} END", 'pit')} FROM b""")
def pit_values(spark, sf_dir):
    return cal.pit(scoring.scorable(daily_store(spark, sf_dir)), LEVELS).select("unique_id", "window", "model", "origin_t", "h", "pit")


_BUCKET = "CASE WHEN h = 1 THEN 'very_short' WHEN h <= 3 THEN 'short' WHEN h <= 12 THEN 'medium' ELSE 'long' END"


@query(f"""WITH {M_STORE}, b AS (SELECT *, {_BUCKET} AS bucket, abs(y_true - y_pred) AS e FROM sc), want AS (SELECT unique_id, "window", bucket, count(DISTINCT (model, h)) AS k, max(h) AS h_last FROM b GROUP BY ALL),
have AS (SELECT unique_id, "window", bucket, origin_t, count(*) AS k FROM b GROUP BY ALL), fine AS (SELECT unique_id, "window", bucket, origin_t, h_last FROM have JOIN want USING (unique_id, "window", bucket, k))
SELECT unique_id, "window", bucket, h_last, origin_t, model, {r('avg(e)', 'loss')} FROM b JOIN fine USING (unique_id, "window", bucket, origin_t) GROUP BY unique_id, "window", bucket, h_last, origin_t, model""")
def bucket_losses(spark, sf_dir):
    return scoring.bucket_losses(scoring.scorable(monthly_store(spark, sf_dir)), MONTHLY.m, MONTHLY.H)


@query()
def mcs_buckets(spark, sf_dir):
    from .operators.backtest import bucket_confidence_set

    _ship(spark)
    return bucket_confidence_set(scoring.scorable(monthly_store(spark, sf_dir)), MONTHLY.m, MONTHLY.H, 20260922)


@query(f"""WITH {D_STORE}, dm0 AS (SELECT unique_id, "window", model, avg(abs(y_true - y_pred) / mase_scale) AS dev_mase, bool_or(lo_80 IS NOT NULL) AS has_intervals FROM store WHERE origin_role = 'dev' AND status = 'ok' AND y_true IS NOT NULL AND mase_scale > 0 AND model = 'ewma' GROUP BY ALL)
SELECT unique_id, "window", model, {r('dev_mase', 'dev_mase')}, 1 AS rank, has_intervals, 'point' AS chosen FROM dm0""")
def candidate_ranking(spark, sf_dir):
    return scoring.candidate_ranking(daily_store(spark, sf_dir))


@query(f"""WITH {M_STORE} SELECT unique_id, "window", model, origin_t, h, {r('y_pred', 'y_pred')} FROM store QUALIFY origin_t = max(origin_t) OVER (PARTITION BY unique_id, "window", model)""")
def latest_origin(spark, sf_dir):
    return scoring.latest_origin(monthly_store(spark, sf_dir)).select("unique_id", "window", "model", "origin_t", "h", "y_pred")


_FACTS = f"""fo AS (SELECT *, list(z) OVER w AS pv FROM fill WINDOW w AS (PARTITION BY unique_id ORDER BY pos ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)), fm AS (SELECT *, list_median(list_filter(pv, lambda x: x IS NOT NULL)) AS med FROM fo),
ff AS (SELECT unique_id, pos, coalesce(len(list_filter(pv, lambda x: x IS NOT NULL)) = 24 AND abs(z - med) > 4 * 1.4826 * list_median(list_transform(list_filter(pv, lambda x: x IS NOT NULL), lambda x: abs(x - med))) AND list_median(list_transform(list_filter(pv, lambda x: x IS NOT NULL), lambda x: abs(x - med))) > 0, false) AS flag FROM fm)"""


@query(f"""WITH {M_STORE}, {_FACTS}, each_fold AS (SELECT DISTINCT unique_id, "window", origin_t, h FROM store),
lab AS (SELECT unique_id, pos, y, printf('%04d-%02d', period // 12, period % 12 + 1) AS label FROM s)
SELECT e.unique_id, e."window", e.origin_t, e.h, a.label AS origin_period, b.label AS target_period,
  CASE WHEN a.y IS NULL THEN 0 ELSE (SELECT count(*) FROM ff WHERE ff.unique_id = e.unique_id AND flag AND ff.pos <= e.origin_t AND (e."window" = 'expanding' OR ff.pos >= fs.f + 24)) END AS n_outliers
FROM each_fold e LEFT JOIN fs ON fs.unique_id = e.unique_id AND fs.origin_t = e.origin_t JOIN lab a ON a.unique_id = e.unique_id AND a.pos = e.origin_t LEFT JOIN lab b ON b.unique_id = e.unique_id AND b.pos = e.origin_t + e.h""")
def store_facts(spark, sf_dir):
    """Periods and outliers of the store's folds."""
    return monthly_store(spark, sf_dir).select("unique_id", "window", "origin_t", "h", "origin_period", "target_period", "n_outliers").distinct()


_KEY = 'unique_id, "window", origin_t'


def _slices_sql(c) -> str:
    """CTE ``sl``: the training values of each dev and test fold, one a row."""
    return f"""fq AS (SELECT p.unique_id, p.origin_t, p.role, w."window", min(g.pos) AS f FROM plan p CROSS JOIN (VALUES {", ".join(f"('{w}')" for w in c.windows)}) w("window")
  JOIN s g ON g.unique_id = p.unique_id AND g.y IS NOT NULL AND g.pos <= p.origin_t AND (w."window" = 'expanding' OR g.pos >= p.origin_t - {c.rolling_length - 1 + c.offset}) WHERE p.role <> 'warmup' GROUP BY ALL),
sl AS MATERIALIZED (SELECT p.unique_id, p."window", p.origin_t, p.role, g.pos, g.z AS e, row_number() OVER k AS i, count(*) OVER (PARTITION BY p.unique_id, p."window", p.origin_t) AS n
  FROM fq p JOIN fill g ON g.unique_id = p.unique_id AND g.pos BETWEEN p.f + {c.offset} AND p.origin_t WHERE g.z IS NOT NULL WINDOW k AS (PARTITION BY p.unique_id, p."window", p.origin_t ORDER BY g.pos))"""


def _fhs_sql() -> str:
    """CTE ``fh``: a row a fold of the constant-variance model with empirical quantiles; innovations are returns over one deviation, so tests of them are tests of the returns."""
    flags = _FACTS.replace("24 PRECEDING", "20 PRECEDING").replace("= 24", "= 20")
    bounds = ", ".join(f"quantile_cont(e, {(1 - x) / 2:.6g}) AS lo_{tag(x)}, quantile_cont(e, {(1 + x) / 2:.6g}) AS hi_{tag(x)}" for x in LEVELS)
    fine = " AND ".join(["n >= 100", *[f"lo_{tag(x)} < 0 AND hi_{tag(x)} > 0" for x in LEVELS]])
    return f"""{D_RAW}, {RETURNS}, {origins_sql(DAILY)}, {truth_sql(DAILY)}, {_slices_sql(DAILY)}, {flags},
own AS (SELECT {_KEY}, any_value(role) AS role, count(*) AS n, {bounds} FROM sl GROUP BY {_KEY}), st AS (SELECT * FROM sl WHERE role = 'test'),
{_ljung_ctes("st", _KEY, "i", 10)}, {_arch_ctes("st", _KEY, "i", 4)},
fh AS (SELECT own.*, {fine} AS fine, {chi_even_sql('q', 10)} AS lb_p, {chi_even_sql('x', 4)} AS arch_p,
  (SELECT count(*) FROM ff WHERE ff.unique_id = own.unique_id AND flag AND ff.pos <= own.origin_t AND (own."window" = 'expanding' OR ff.pos >= own.origin_t - {DAILY.rolling_length - 1} + 20)) AS n_outliers
  FROM own LEFT JOIN (SELECT {_KEY}, q FROM lj) USING ({_KEY}) LEFT JOIN (SELECT {_KEY}, x FROM al) USING ({_KEY}))"""


_FHS_ROWS = ", ".join(f"{r(f'CASE WHEN fine THEN {c}_{tag(x)} END', f'{c}_{tag(x)}')}, CAST(NULL AS DOUBLE) AS es_{tag(x)}" if c == "lo" else r(f"CASE WHEN fine THEN {c}_{tag(x)} END", f"{c}_{tag(x)}") for x in LEVELS for c in ("lo", "hi"))


@query(f"""WITH {_fhs_sql()} SELECT unique_id, 'zero_return_fhs' AS model, "window", origin_t, role AS origin_role, h, {r('y_true', 'y_true')}, CASE WHEN fine THEN CAST(0 AS DOUBLE) END AS y_pred, {_FHS_ROWS}, n_outliers,
{r('CASE WHEN fine THEN lb_p END', 'lb_p')}, CAST(NULL AS DOUBLE) AS lb_p_2m, {r('CASE WHEN fine THEN arch_p END', 'arch_p')}, 'none' AS transform, CASE WHEN fine THEN 'zero_return_fhs' END AS variant, CASE WHEN fine THEN 'ok' ELSE 'failed' END AS status
FROM fh JOIN truth USING (unique_id, origin_t)""")
def fc_fhs(spark, sf_dir):
    return _fitted("daily", "zero_return_fhs")(spark, sf_dir)


@query(f"""WITH {_fhs_sql()}, t AS (SELECT * FROM fh WHERE fine AND role = 'test') SELECT unique_id, "window", 'zero_return_fhs' AS model, count(lb_p) AS n_lb, {r('avg(CAST(lb_p < 0.05 AS DOUBLE))', 'lb_reject_share')}, {r('median(lb_p)', 'lb_median_p')},
CAST(0 AS BIGINT) AS n_lb_2m, CAST(NULL AS DOUBLE) AS lb_2m_reject_share, CAST(NULL AS DOUBLE) AS lb_2m_median_p, count(arch_p) AS n_arch, {r('avg(CAST(arch_p < 0.05 AS DOUBLE))', 'arch_reject_share')}, {r('median(arch_p)', 'arch_median_p')} FROM t GROUP BY unique_id, "window\"""")
def residual_summary(spark, sf_dir):
    return scoring.residual_summary(_fitted("daily", "zero_return_fhs")(spark, sf_dir).where("origin_role = 'test' AND status = 'ok' AND h = 1"))


@query()
def residual_summary_seasonal(spark, sf_dir):
    return scoring.residual_summary(_fitted("monthly", "ses", window="expanding")(spark, sf_dir).where("origin_role = 'test' AND status = 'ok' AND h = 1"))


@query()
def transform_counts(spark, sf_dir):
    return scoring.transform_counts(_fitted("monthly", "ses", transform="boxcox")(spark, sf_dir).where("transform IS NOT NULL"))


@query(f"""WITH {M_RAW}, {FILL}, {origins_sql(MONTHLY)}, {_slices_sql(MONTHLY)}, seen AS (SELECT unique_id, pos AS origin_t FROM s WHERE y IS NOT NULL), sb AS (SELECT *, (n - i) // 12 AS b FROM sl JOIN seen USING (unique_id, origin_t)),
sd AS (SELECT *, e - lag(e) OVER (PARTITION BY {_KEY}, b ORDER BY i) AS d FROM sb), bl AS (SELECT {_KEY}, b, avg(e) AS mean, stddev_samp(d) AS sd, count(*) AS k, min(e) AS low FROM sd GROUP BY ALL),
fo AS (SELECT {_KEY}, min(low) AS low, regr_slope(ln(CASE WHEN k = 12 AND sd > 0 AND mean > 0 THEN sd END), ln(CASE WHEN k = 12 AND sd > 0 AND mean > 0 THEN mean END)) AS slope, count(*) FILTER (k = 12 AND sd > 0 AND mean > 0) AS nb FROM bl GROUP BY {_KEY}),
c AS (SELECT unique_id, CASE WHEN low > 0 AND nb >= 3 AND slope > 0.5 THEN 'log' ELSE 'none' END AS family, count(*) AS n FROM fo GROUP BY ALL)
SELECT unique_id, family, n, CAST(NULL AS DOUBLE) AS power_min, CAST(NULL AS DOUBLE) AS power_max, {r('n / sum(n) OVER (PARTITION BY unique_id)', 'share')} FROM c""")
def transform_counts_auto(spark, sf_dir):
    return scoring.transform_counts(_fitted("monthly", "ses", transform="auto")(spark, sf_dir).where("transform IS NOT NULL"))


@query(f"SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, {r('sum(value)', 'total')} FROM events GROUP BY ALL")
def stream_event_counts(spark, sf_dir):
    """The windowed stream over the events file, run to its end. Each batch adds the windows that it changed to files; a window's last state counts."""
    import uuid

    from .streaming.scorer import event_counts, latest_state, sink_states

    schema = panels.read(spark, sf_dir, "events").schema
    folder = f"{shared_folder(spark)}/foresail/events-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = event_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    running = counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(sink_states(f"{folder}/rows")).trigger(availableNow=True).start()
    running.awaitTermination()
    return latest_state(spark, f"{folder}/rows", counts.schema, ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT event_type AS unique_id, CAST(CAST(ts AS DATE) - DATE '1970-01-05' AS BIGINT) // 7 AS period, sum(value) AS v FROM events GROUP BY ALL),
c AS (SELECT unique_id, unnest(range(min(period), max(period) + 1)) AS period FROM e GROUP BY unique_id)
SELECT unique_id, row_number() OVER (PARTITION BY unique_id ORDER BY period) - 1 AS pos, CAST(period AS BIGINT) AS period, """ + r("v", "y") + " FROM c LEFT JOIN e USING (unique_id, period)")
def calendar_reindex(spark, sf_dir):
    rows = panels.read(spark, sf_dir, "events").withColumn("p", series.ordinal(F.col("ts"), "weekly"))
    rows = rows.groupBy(F.col("event_type").alias("unique_id"), "p").agg(F.min("ts").alias("ds"), F.sum("value").alias("y"))
    return series.reindexed(rows, "weekly")


@query(f'WITH {M_STORE} SELECT unique_id, "window", origin_t, any_value(round(CAST(mase_scale AS DOUBLE) + {NUDGE!r}, 6) + 0.0) AS mase_scale FROM store GROUP BY unique_id, "window", origin_t')
def mase_scale(spark, sf_dir):
    plan = folds.origins(panels.monthly(spark, sf_dir), MONTHLY).select("unique_id", "origin_t")
    return folds.fold_facts(panels.monthly(spark, sf_dir), MONTHLY).join(plan, ["unique_id", "origin_t"]).select("unique_id", "window", "origin_t", "mase_scale")


@query(f'WITH {M_STORE}, {SELECTION}, {PAIRS} SELECT unique_id, "window", model, h, any_value(reference) AS reference, count(*) AS n, {r("avg(d_a) / nullif(avg(d_b), 0)", "rel_mae")}, {r("sqrt(avg(d_a * d_a) / nullif(avg(d_b * d_b), 0))", "rel_rmse")} FROM pairs GROUP BY unique_id, "window", model, h')
def relative_mae(spark, sf_dir):
    store = monthly_store(spark, sf_dir)
    pairs = scoring.paired(scoring.scorable(store), scoring.dev_selection(store))
    return pairs.groupBy(*scoring.CELL).agg(
        F.min("reference").alias("reference"), F.count(F.lit(1)).alias("n"), F.try_divide(F.avg("d_a"), F.avg("d_b")).alias("rel_mae"),
        F.sqrt(F.try_divide(F.avg(F.col("d_a") * F.col("d_a")), F.avg(F.col("d_b") * F.col("d_b")))).alias("rel_rmse"),
    )


_GRID = 'SELECT unique_id, "window", model, origin_t, h, y_true, lo_80 - 0.5 * (origin_t % 3) AS l80, hi_80 + 0.5 * (origin_t % 3) AS h80, lo_95 AS l95, hi_95 AS h95 FROM sc WHERE lo_80 IS NOT NULL'


@query(f"""WITH {M_STORE}, g AS ({_GRID}) SELECT unique_id, "window", model, origin_t, h, {r('l80', 'lo_80')}, {r('h80', 'hi_80')}, {r('least(l80, l95)', 'lo_95')}, {r('greatest(h80, h95)', 'hi_95')} FROM g""")
def grid_repair(spark, sf_dir):
    """Inner bounds moved past the outer ones, and the grid made to widen again."""
    rows = scoring.scorable(monthly_store(spark, sf_dir)).where("lo_80 IS NOT NULL").withColumn("conformal_n", F.lit(1))
    moved = F.lit(0.5) * (F.col("origin_t") % 3)
    rows = rows.withColumn("lo_80", F.col("lo_80") - moved).withColumn("hi_80", F.col("hi_80") + moved)
    return cal.monotone(rows, LEVELS).select("unique_id", "window", "model", "origin_t", "h", "lo_80", "hi_80", "lo_95", "hi_95")


_AR1 = """g AS (SELECT unique_id, pos, z, lag(z) OVER (PARTITION BY unique_id ORDER BY pos) AS x FROM fill),
b AS (SELECT unique_id, pos AS origin_t, z AS last_z, regr_slope(z, x) OVER w AS b1, regr_intercept(z, x) OVER w AS b0, regr_count(z, x) OVER w AS n FROM g WINDOW w AS (PARTITION BY unique_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"""WITH {D_RAW}, {RET}, {origins_sql(DAILY)}, {_AR1} SELECT unique_id, origin_t, CAST(n AS BIGINT) AS n, {r('b0', 'intercept')}, {r('b1', 'slope')}, {r('b0 + b1 * last_z', 'y_pred')} FROM b JOIN plan USING (unique_id, origin_t)""")
def fc_ar1(spark, sf_dir):
    """A first-order autoregression on expanding slices as running regressions."""
    from pyspark.sql import Window

    dense = panels.daily(spark, sf_dir)
    w = Window.partitionBy("unique_id").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = series.log_returns(dense).withColumn("x", F.lag("r").over(w))
    rows = rows.select("unique_id", F.col("pos").alias("origin_t"), "r", F.regr_slope("r", "x").over(upto).alias("slope"), F.regr_intercept("r", "x").over(upto).alias("intercept"), F.regr_count("r", "x").over(upto).alias("n"))
    rows = rows.join(folds.origins(dense, DAILY).select("unique_id", "origin_t"), ["unique_id", "origin_t"])
    return rows.select("unique_id", "origin_t", "n", "intercept", "slope", (F.col("intercept") + F.col("slope") * F.col("r")).alias("y_pred"))


@query(f"""WITH {M_STORE}, q AS (SELECT unique_id, "window", model, origin_t, min(h) AS first, bool_and(status = 'ok') AS fine FROM store GROUP BY ALL)
SELECT "window", model, count(*) AS n_folds, count(*) FILTER (fine) AS n_fine, count(DISTINCT unique_id) AS n_series FROM q GROUP BY "window", model""")
def fold_status(spark, sf_dir):
    folded = monthly_store(spark, sf_dir).groupBy("unique_id", "window", "model", "origin_t").agg(F.bool_and(F.col("status") == "ok").alias("fine"))
    return folded.groupBy("window", "model").agg(F.count(F.lit(1)).alias("n_folds"), F.count_if("fine").alias("n_fine"), F.count_distinct("unique_id").alias("n_series"))
