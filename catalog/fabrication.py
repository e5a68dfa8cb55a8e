"""Fabricated columns and tables, replayed draw by draw in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalog.aggregation import PLACES_SQL, places
from catalog.common import between_sql, list_sql, load, pick_sql, rounded, u_sql, union_all
from twintable.functions import numbers as num
from twintable.functions import text as text_fn
from twintable.functions.draw import GAMMA_TRIES, Draws
from twintable.operators.ecdf import two_sample_ks
from twintable.plans.fabricate import categorical, lookups, numeric, people, pools, temporal, text
from twintable.plans.fabricate.table import Options, blend, fabricate
from twintable.session import durable, scratch_folder
from twintable.sources.files import row_source

SEED = 7
ROWS = "rows_ AS (SELECT o_orderkey AS row_id FROM orders)"


def _rows(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))


# ------------------------------------------------------------------ numeric


def fit_parameters(spark, d):
    df = load(spark, d, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice") - 20000.0)
    out = numeric.fit_parameters(df, ["l_quantity", "l_tax", "l_extendedprice"])
    return rounded(out, mean=5, std=5, log_mean=6, log_std=6, pos_mean=5, gamma_shape=6, gamma_scale=4)


def _fit_sql(c: str) -> str:
    s = f"(ln(avg({c}) FILTER (WHERE {c} > 0)) - avg(ln(CASE WHEN {c} > 0 THEN {c} END)))"
    shape = f"(3 - {s} + sqrt(({s} - 3) * ({s} - 3) + 24 * {s})) / (12 * {s})"
    return f"""count({c}) AS n, avg({c}) AS mean, stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max,
  avg(ln(CASE WHEN {c} > 0 THEN {c} END)) AS log_mean, stddev_pop(ln(CASE WHEN {c} > 0 THEN {c} END)) AS log_std,
  avg({c}) FILTER (WHERE {c} > 0) AS pos_mean, bool_and({c} % 1 = 0) AS is_integer,
  CASE WHEN min({c}) >= 0 THEN {shape} END AS gamma_shape,
  CASE WHEN min({c}) >= 0 THEN avg({c}) FILTER (WHERE {c} > 0) / ({shape}) END AS gamma_scale"""


FIT_SQL = """
SELECT * REPLACE (round(mean, 5) AS mean, round(std, 5) AS std, round(log_mean, 6) AS log_mean,
  round(log_std, 6) AS log_std, round(pos_mean, 5) AS pos_mean, round(gamma_shape, 6) AS gamma_shape,
  round(gamma_scale, 4) AS gamma_scale) FROM (""" + union_all([
    f"""SELECT '{c}' AS "column", {_fit_sql(e)} FROM lineitem"""
    for c, e in [("l_quantity", "l_quantity"), ("l_tax", "l_tax"), ("l_extendedprice", "(l_extendedprice - 20000.0)")]
]) + ")"

FIT_COLUMNS = ["l_extendedprice", "l_quantity"]


def fit_scores(spark, d):
    df = load(spark, d, "lineitem")
    out = numeric.fit_scores(df, FIT_COLUMNS, numeric.fit_parameters(df, FIT_COLUMNS))
    return rounded(out, ks=8, score=8)


def _phi_sql(x: str) -> str:
    top, bottom = str(num._HART_TOP[0]), str(num._HART_BOTTOM[0])
    for k in num._HART_TOP[1:]:
        top = f"({top} * abs({x}) + {k})"
    for k in num._HART_BOTTOM[1:]:
        bottom = f"({bottom} * abs({x}) + {k})"
    upper = f"exp(-({x}) * ({x}) / 2.0) * {top} / {bottom}"
    return f"(CASE WHEN ({x}) > 0 THEN 1.0 - {upper} ELSE {upper} END)"


def _ks_fit_sql(c: str) -> str:
    families = {
        "normal": _phi_sql("((v - mean) / std)"),
        "uniform": "((v - min) / (max - min))",
        "exponential": "(1 - exp(-v / mean))",
        "lognormal": _phi_sql("((ln(v) - log_mean) / log_std)"),
        # the power series of the regularized gamma function
        "gamma": "(CASE WHEN v <= 0 THEN 0 ELSE list_sum(list_transform(range(200), lambda n: exp((gamma_shape + n) "
                 "* ln(v / gamma_scale) - v / gamma_scale - lgamma(gamma_shape + n + 1)))) END)",
    }
    return union_all([f"""
SELECT '{c}' AS "column", '{k}' AS family, max(greatest(hi / tot - {f}, {f} - lo / tot)) AS ks FROM (
  SELECT v, sum(k) OVER (ORDER BY v) AS hi, sum(k) OVER (ORDER BY v) - k AS lo, sum(k) OVER () AS tot
  FROM (SELECT {c} AS v, count(*) AS k FROM lineitem GROUP BY 1)), (SELECT {_fit_sql(c)} FROM lineitem)"""
        for k, f in families.items()])


_SCORES = union_all([_ks_fit_sql(c) for c in FIT_COLUMNS])


def fit_scores_all(spark, d):
    """All five families on the prices."""
    df = load(spark, d, "lineitem")
    return rounded(numeric.fit_scores(df, ["l_extendedprice"], numeric.fit_parameters(df, ["l_extendedprice"])),
                   ks=6, score=6)


def best_fit(spark, d):
    return rounded(numeric.best_fit(load(spark, d, "lineitem"), FIT_COLUMNS), score=8).select(
        "column", "family", "score"
    )


ALL_SQL = f"""SELECT "column", family, round(ks, 6) AS ks, round(1 - ks, 6) AS score FROM ({_ks_fit_sql("l_extendedprice")})"""

BEST_SQL = f"""
SELECT "column", arg_max(family, 1 - ks) AS family, round(max(1 - ks), 8) AS score FROM ({_SCORES}) GROUP BY 1"""


def sample_families(spark, d):
    """One draw per family with the parameters of the order totals."""
    p = numeric.fit_parameters(load(spark, d, "orders"), ["o_totalprice"]).first().asDict()
    r = F.col("row_id")
    out = _rows(spark, d).select("row_id", *[
        numeric.sample(k, p, Draws(SEED, k, r)).alias(k) for k in numeric.FAMILIES
    ])
    return rounded(out, **{k: 3 for k in numeric.FAMILIES})


def normal_sql(name: str, d0: int | str = 0, d1: int | str = 1, row: str = "row_id") -> str:
    return (f"(sqrt(-2.0 * ln(1.0 - {u_sql(SEED, name, row, d0)})) "
            f"* cos({2 * math.pi!r} * {u_sql(SEED, name, row, d1)}))")


FAMILY_SQL = f"""
WITH {ROWS}, p AS (SELECT {_fit_sql('o_totalprice')} FROM orders),
g AS (SELECT *, CASE WHEN gamma_shape >= 1 THEN gamma_shape ELSE gamma_shape + 1 END - 1.0 / 3 AS d FROM p),
tries AS (SELECT row_id, i, {normal_sql('gamma', 'i * 3', 'i * 3 + 1')} AS z, {u_sql(SEED, 'gamma', 'row_id', 'i * 3 + 2')} AS u, d
  FROM rows_, g, range({GAMMA_TRIES}) t(i)),
vs AS (SELECT *, pow(1 + z / sqrt(9 * d), 3) AS v FROM tries),
taken AS (SELECT row_id, arg_min(v, i) AS v FROM vs
  WHERE v > 0 AND ln(1 - u) < 0.5 * z * z + d - d * v + d * ln(CASE WHEN v > 0 THEN v END) GROUP BY 1)
SELECT row_id, round(mean + std * {normal_sql('normal')}, 3) AS normal,
  round(min + {u_sql(SEED, 'uniform', 'row_id', 0)} * (max - min), 3) AS uniform,
  round(-mean * ln(1 - {u_sql(SEED, 'exponential', 'row_id', 0)}), 3) AS exponential,
  round(exp(log_mean + log_std * {normal_sql('lognormal')}), 3) AS lognormal,
  round(d * gamma_scale * v * CASE WHEN gamma_shape < 1 THEN pow(1 - {u_sql(SEED, 'gamma', 'row_id', 3 * GAMMA_TRIES)}, 1 / gamma_shape) ELSE 1 END, 3) AS gamma
FROM rows_ JOIN taken USING (row_id), g"""


def numeric_columns(spark, d):
    """Sequential id, money floor, range limit, whole numbers."""
    df = load(spark, d, "lineitem").selectExpr("l_quantity", "l_orderkey AS order_id", "l_tax * 100 - 3 AS amount")
    p = {r["column"]: r.asDict() for r in numeric.fit_parameters(df, df.columns).collect()}
    r = F.col("row_id")
    return _rows(spark, d).select(
        "row_id",
        numeric.numeric_column("order_id", "uniform", p["order_id"], r, SEED, True).alias("order_id"),
        numeric.numeric_column("l_quantity", "normal", p["l_quantity"], r, SEED, True).alias("l_quantity"),
        numeric.numeric_column("amount", "normal", p["amount"] | {"max": 12.0}, r, SEED, False, decimals=2).alias("amount"),
    )


NUMERIC_SQL = f"""
WITH {ROWS}, q AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
a AS (SELECT avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo FROM (SELECT l_tax * 100 - 3 AS x FROM lineitem))
SELECT row_id, row_id + 1 AS order_id,
  round_even(least(greatest(q.m + q.s * {normal_sql('l_quantity')}, q.lo), q.hi), 0)::BIGINT AS l_quantity,
  round(least(greatest(greatest(abs(a.m + a.s * {normal_sql('amount')}), 10.0), a.lo), 12.0), 2)::DOUBLE AS amount
FROM rows_, q, a"""


def correlated_columns(spark, d):
    """Correlations before and after: kept within a few hundredths."""
    from twintable.operators.aggregates import correlation_pairs

    df = load(spark, d, "lineitem").selectExpr(
        "l_quantity", "l_quantity * 3 + l_discount * 400 AS mixed", "l_extendedprice"
    )
    exprs = numeric.correlated_columns(df, df.columns, F.col("row_id"), SEED)
    # made once, measured twice
    made = durable(_rows(spark, d).select(*[c.alias(k) for k, c in exprs.items()]))
    a = correlation_pairs(df, df.columns)
    b = correlation_pairs(made, df.columns).withColumnRenamed("corr", "made")
    gap = F.abs(F.col("corr") - F.col("made"))
    return a.join(b, ["column_a", "column_b"]).select(
        "column_a", "column_b", (gap < 0.05).alias("kept")
    )


CORRELATED_SQL = union_all([
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) > 0 AS kept FROM lineitem"
    for a in ("l_quantity", "mixed", "l_extendedprice") for b in ("l_quantity", "mixed", "l_extendedprice")
])

# -------------------------------------------------------------- categorical


def categorical_columns(spark, d):
    df = load(spark, d, "orders")
    counts = categorical.category_counts(df, ["o_orderpriority", "o_orderstatus"])
    r = F.col("row_id")
    return _rows(spark, d).select("row_id", *[
        categorical.by_frequency(counts[c], Draws(SEED, c, r)(0)).alias(c) for c in counts
    ])


def cat_sql(name: str, source: str, value: str, seed: int = SEED) -> str:
    """Rows joined to cumulative counts; ``source`` is any FROM item."""
    return f"""(SELECT row_id, v AS {name} FROM rows_ JOIN (
  SELECT v, n, sum(n) OVER (ORDER BY md5(v::VARCHAR), v) AS hi, sum(n) OVER () AS tot FROM (
    SELECT {value} AS v, count(*) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY 1)) c
  ON floor({u_sql(seed, name, 'row_id', 0)} * tot) >= hi - n AND floor({u_sql(seed, name, 'row_id', 0)} * tot) < hi)"""


CATEGORICAL_SQL = f"""
WITH {ROWS} SELECT * FROM {cat_sql('o_orderpriority', 'orders', 'o_orderpriority')}
JOIN {cat_sql('o_orderstatus', 'orders', 'o_orderstatus')} USING (row_id)"""


def long_category(spark, d):
    """More categories than literals allow, drawn by a join."""
    df = load(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("part"))
    return categorical.add_long_category(_rows(spark, d), df, "part", SEED)


LONG_SQL = f"WITH {ROWS} SELECT * FROM {cat_sql('part', 'lineitem', 'l_partkey::VARCHAR')}"


def alias_category(spark, d):
    """The same list, drawn from an alias table: one cell a draw."""
    df = load(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("part"))
    return categorical.add_long_category(_rows(spark, d), df, "part", SEED, long_lists="alias")


ALIAS_SQL = f"""
WITH {ROWS}, freq AS (SELECT l_partkey::VARCHAR AS v, count(*) AS w FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1),
size AS (SELECT count(*) AS n, sum(w) AS tot FROM freq),
gaps AS (SELECT v, n, tot, n * w - tot AS g FROM freq, size),
light AS (SELECT v, tot, row_number() OVER o - 1 AS number, tot + g AS keep, sum(-g) OVER o + g AS lo, sum(-g) OVER o AS hi
  FROM gaps WHERE g < 0 WINDOW o AS (ORDER BY md5(v), v)),
heavy AS (SELECT v, tot, n - row_number() OVER o AS number, sum(g) OVER o - g AS lo, sum(g) OVER o AS hi, lead(v) OVER o AS other
  FROM gaps WHERE g >= 0 WINDOW o AS (ORDER BY md5(v), v)),
cells AS (
  SELECT l.number, l.v, l.keep::DOUBLE / l.tot::DOUBLE AS share, h.v AS other
  FROM light l ASOF JOIN (SELECT * FROM heavy WHERE hi > lo) h ON l.lo >= h.lo
  UNION ALL
  SELECT h.number, h.v, (h.tot - coalesce(l.hi - h.hi, 0))::DOUBLE / h.tot::DOUBLE, h.other
  FROM heavy h ASOF LEFT JOIN light l ON h.hi > l.lo)
SELECT row_id, CASE WHEN {u_sql(SEED, 'part', 'row_id', 1)} < share THEN v ELSE other END AS part
FROM rows_ CROSS JOIN size JOIN cells ON number = CAST(floor({u_sql(SEED, 'part', 'row_id', 0)} * n) AS BIGINT)"""


def fallback_categories(spark, d):
    r = F.col("row_id")
    names = ["order_status", "customer_type", "category", "colour"]
    return _rows(spark, d).select("row_id", *[
        categorical.by_name(c, Draws(SEED, c, r)(0)).alias(c) for c in names
    ])


_FALLBACK = lookups.FALLBACK_CATEGORIES
FALLBACK_SQL = f"""
WITH {ROWS} SELECT row_id,
  {pick_sql(_FALLBACK['status'], u_sql(SEED, 'order_status', 'row_id', 0))} AS order_status,
  {pick_sql(_FALLBACK['type'], u_sql(SEED, 'customer_type', 'row_id', 0))} AS customer_type,
  {pick_sql(_FALLBACK['category'], u_sql(SEED, 'category', 'row_id', 0))} AS category,
  {pick_sql(lookups.OTHER_CATEGORIES, u_sql(SEED, 'colour', 'row_id', 0))} AS colour FROM rows_"""


def country_and_city(spark, d):
    ref = places(spark, d)
    counts = categorical.category_counts(ref, ["country", "city"])
    r = F.col("row_id")
    rows = _rows(spark, d).withColumn(
        "country", categorical.by_frequency(counts["country"], Draws(SEED, "country", r)(0))
    )
    u = Draws(SEED, "city", r)(0)
    pairs = categorical.city_table(ref, "country", "city", spark)
    return categorical.add_city(rows, "country", pairs, u, "city", F.lit("?"))


def _default_pairs() -> str:
    return "(VALUES " + ", ".join(
        f"('{k}', '{c}')" for k, cs in lookups.normalized_country_cities().items() for c in cs
    ) + ")"


def _alias_sql(c: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lookups.COUNTRY_ALIASES.items())
    return f"(CASE lower(trim({c})) {cases} ELSE trim({c}) END)"


CITY_SQL = f"""
WITH {ROWS}, ref AS ({PLACES_SQL}),
lists AS (SELECT country, list(city ORDER BY md5(city), city) AS cities FROM (
  SELECT * FROM {_default_pairs()} t(country, city) UNION SELECT {_alias_sql('country')}, city FROM ref) GROUP BY 1)
SELECT row_id, c.country, cities[1 + CAST(floor({u_sql(SEED, 'city', 'row_id', 0)} * len(cities)) AS INT)] AS city
FROM {cat_sql('country', 'ref', 'country')} c JOIN lists ON lists.country = {_alias_sql('c.country')}"""



def names_from_table(spark, d):
    """Names of suppliers by nation, from a file of short lists, and of customers by segment, from long ones."""
    path = f"{scratch_folder(spark)}/names"
    load(spark, d, "supplier").select("s_nationkey", "s_name").write.json(path)
    by_nation = pools.index_pools(lookups.load_lookup(spark, path, "s_nationkey int, s_name string"), "s_name", "s_nationkey")
    by_segment = pools.index_pools(load(spark, d, "customer"), "c_name", "c_mktsegment")
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), "c_nationkey", "c_mktsegment")
    draw = lambda name: Draws(SEED, name, F.col("row_id"))(0)
    rows = pools.draw_from_pools(rows, "supplier", by_nation, draw("supplier"), F.col("c_nationkey"), default="0")
    return pools.draw_from_pools(rows, "customer", by_segment, draw("customer"), F.col("c_mktsegment"))


def _pool_sql(key: str, value: str, table: str) -> str:
    return f"""(SELECT pool, list(v ORDER BY md5(v), v) AS vs FROM (SELECT DISTINCT {key}::VARCHAR AS pool, {value} AS v FROM {table}) GROUP BY 1)"""


def _draw_pool_sql(vs: str, name: str) -> str:
    return f"({vs})[1 + CAST(floor({u_sql(SEED, name, 'row_id', 0)} * len({vs})) AS BIGINT)]"


NAMES_TABLE_SQL = f"""
WITH suppliers AS {_pool_sql('s_nationkey', 's_name', 'supplier')},
customers AS {_pool_sql('c_mktsegment', 'c_name', 'customer')}
SELECT row_id, c_nationkey, c_mktsegment, {_draw_pool_sql('coalesce(s.vs, z.vs)', 'supplier')} AS supplier,
  {_draw_pool_sql('c.vs', 'customer')} AS customer
FROM (SELECT c_custkey AS row_id, c_nationkey, c_mktsegment FROM customer)
LEFT JOIN suppliers s ON s.pool = c_nationkey::VARCHAR LEFT JOIN suppliers z ON z.pool = '0'
LEFT JOIN customers c ON c.pool = c_mktsegment"""

# ----------------------------------------------------------------- temporal


def _date_range(spark, d):
    return load(spark, d, "orders").agg(F.min("o_orderdate"), F.max("o_orderdate")).first()


def uniform_dates(spark, d):
    low, high = _date_range(spark, d)
    u = Draws(SEED, "day", F.col("row_id"))(0)
    day = temporal.uniform_dates(low, temporal.span_days(low, high), u)
    return _rows(spark, d).select(
        "row_id", day.alias("day"), temporal.finish(day, business_days=True).alias("work_day"),
        temporal.finish(day, layout="%d.%m.%Y").alias("shown"),
    )


_SPAN = "(SELECT min(o_orderdate) AS lo, floor(epoch(max(o_orderdate) - min(o_orderdate)) / 86400)::INT AS days FROM orders)"
_DAY = f"(lo + CAST(floor({u_sql(SEED, 'day', 'row_id', 0)} * days) AS INT) * INTERVAL 1 DAY)"
UNIFORM_SQL = f"""
WITH {ROWS} SELECT row_id, {_DAY} AS day,
  {_DAY} + (CASE WHEN isodow({_DAY}) > 5 THEN 8 - isodow({_DAY}) ELSE 0 END) * INTERVAL 1 DAY AS work_day,
  strftime({_DAY}, '%d.%m.%Y') AS shown FROM rows_, {_SPAN}"""


def patterned_dates(spark, d):
    df = load(spark, d, "orders")
    low, high = _date_range(spark, d)
    weekdays, months = temporal.calendar_counts(df, "o_orderdate")
    return temporal.add_patterned_dates(
        _rows(spark, d), "day", low, temporal.span_days(low, high), weekdays, months, SEED
    )


def _slot_sql(part: str, draw: int, name: str, seed: int = SEED) -> str:
    return f"""(SELECT row_id, s FROM rows_ JOIN (SELECT s, n, sum(n) OVER (ORDER BY s) AS hi, sum(n) OVER () AS tot
  FROM (SELECT {part} AS s, count(*) AS n FROM orders GROUP BY 1)) c
  ON floor({u_sql(seed, name, 'row_id', draw)} * tot) >= hi - n AND floor({u_sql(seed, name, 'row_id', draw)} * tot) < hi)"""


def patterned_sql(name: str, seed: int = SEED) -> str:
    return f"""(SELECT row_id, lo + (coalesce(e.offs, f.offs))[1 + CAST(floor({u_sql(seed, name, 'row_id', 2)} * len(coalesce(e.offs, f.offs))) AS INT)] * INTERVAL 1 DAY AS {name}
FROM {_slot_sql('isodow(o_orderdate) - 1', 0, name, seed)} w JOIN {_slot_sql('month(o_orderdate)', 1, name, seed)} m USING (row_id)
JOIN {_SPAN} sp ON TRUE
LEFT JOIN (SELECT w, m, list(o ORDER BY o) AS offs FROM days_ GROUP BY 1, 2) e ON e.w = w.s AND e.m = m.s
LEFT JOIN (SELECT w, list(o ORDER BY o) AS offs FROM days_ GROUP BY 1) f ON f.w = w.s)"""


DAYS = f"""days_ AS (SELECT o, isodow(lo + o * INTERVAL 1 DAY) - 1 AS w, month(lo + o * INTERVAL 1 DAY) AS m
  FROM (SELECT lo, unnest(range(days)) AS o FROM {_SPAN}))"""
PATTERN_SQL = f"WITH {ROWS}, {DAYS} SELECT * FROM {patterned_sql('day')}"


def timed_dates(spark, d):
    """Moments with the weekdays, months and times of day of the events."""
    df = load(spark, d, "events")
    low, high = df.agg(F.min("ts"), F.max("ts")).first()
    rows = df.select(F.col("event_id").alias("row_id"))
    return temporal.add_timed_dates(rows, "moment", df, "ts", low, high, SEED)


def _share_sql(part: str, draw: int) -> str:
    return f"""(SELECT row_id, s FROM (SELECT row_id, floor({u_sql(SEED, 'moment', 'row_id', draw)} * tot)::BIGINT AS t
    FROM rows_, (SELECT count(ts) AS tot FROM events)) r
  ASOF JOIN (SELECT s, sum(n) OVER (ORDER BY s) - n AS lo FROM (
    SELECT {part} AS s, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1)) c ON r.t >= c.lo)"""


TIMED_SQL = f"""
WITH rows_ AS (SELECT event_id AS row_id FROM events),
span AS (SELECT min(ts) AS low, max(ts) AS high, date_trunc('day', min(ts))::TIMESTAMP AS lo,
  date_diff('day', min(ts), max(ts)) + 1 AS days FROM events),
days_ AS (SELECT o, isodow(lo + o * INTERVAL 1 DAY) - 1 AS w, month(lo + o * INTERVAL 1 DAY) AS m
  FROM (SELECT lo, unnest(range(days)) AS o FROM span)),
drawn AS (SELECT row_id, low, high, lo + (coalesce(e.offs, f.offs))[1 + CAST(floor({u_sql(SEED, 'moment', 'row_id', 2)}
    * len(coalesce(e.offs, f.offs))) AS INT)] * INTERVAL 1 DAY AS day
  FROM {_share_sql('isodow(ts) - 1', 0)} w JOIN {_share_sql('month(ts)', 1)} m USING (row_id) JOIN span ON TRUE
  LEFT JOIN (SELECT w, m, list(o ORDER BY o) AS offs FROM days_ GROUP BY 1, 2) e ON e.w = w.s AND e.m = m.s
  LEFT JOIN (SELECT w, list(o ORDER BY o) AS offs FROM days_ GROUP BY 1) f ON f.w = w.s),
clock AS (SELECT w, sec, sum(n) OVER (PARTITION BY w ORDER BY sec) - n AS before, sum(n) OVER (PARTITION BY w) AS tot FROM (
  SELECT isodow(ts) - 1 AS w, date_diff('second', date_trunc('day', ts)::TIMESTAMP, date_trunc('second', ts)) AS sec, count(*) AS n
  FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)),
asked AS (SELECT d.*, isodow(day) - 1 AS w, floor({u_sql(SEED, 'moment', 'row_id', 3)} * tot)::BIGINT AS t
  FROM drawn d JOIN (SELECT DISTINCT w, tot FROM clock) c ON c.w = isodow(d.day) - 1)
SELECT row_id, greatest(least(day + sec * INTERVAL 1 SECOND, high), low) AS moment
FROM asked a ASOF JOIN clock c ON a.w = c.w AND a.t >= c.before"""


def regular_series(spark, d):
    low, high = _date_range(spark, d)
    series = temporal.regular_series(spark, str(low), str(high), "7 day")
    return series


SERIES_SQL = """
SELECT row_number() OVER (ORDER BY ts) - 1 AS step, ts FROM (
  SELECT unnest(generate_series(min(o_orderdate)::TIMESTAMP, max(o_orderdate)::TIMESTAMP, INTERVAL 7 DAY)) AS ts FROM orders)"""


def seasonal_dates(spark, d):
    low, _ = _date_range(spark, d)
    counts = dict(temporal.calendar_counts(load(spark, d, "orders"), "o_orderdate")[1])
    weights = [counts.get(m, 0) for m in range(1, 13)]
    day = temporal.seasonal_dates("season", low.replace(month=1, day=1), weights, F.col("row_id"), SEED)
    return _rows(spark, d).select("row_id", day.cast("timestamp").alias("day"))


_FIRST = "(date_trunc('year', lo)::DATE + (m.s::INT - 1) * INTERVAL 1 MONTH)"
SEASON_SQL = f"""
WITH {ROWS} SELECT row_id, ({_FIRST} + CAST(floor({u_sql(SEED, 'season', 'row_id', 1)} * day(last_day({_FIRST}::DATE))) AS INT) * INTERVAL 1 DAY)::TIMESTAMP AS day
FROM {_slot_sql('month(o_orderdate)', 0, 'season')} m, {_SPAN}"""

# ------------------------------------------------------------------- people

_U = {i: u_sql(SEED, "name", "row_id", i) for i in range(7)}
US = lookups.FIRST_NAMES["en_US"]
_GENDER = f"(CASE WHEN floor({_U[0]} * 1000000) < 500000 THEN 'male' ELSE 'female' END)"
PERSON = {
    "gender": _GENDER,
    "first": f"(CASE WHEN {_GENDER} = 'male' THEN {pick_sql(US['male'], _U[1])} ELSE {pick_sql(US['female'], _U[1])} END)",
    "last": pick_sql(lookups.LAST_NAMES["en_US"], _U[2]),
    "middle": pick_sql(lookups.MIDDLE_NAMES["en_US"], _U[3]),
    "title": f"(CASE WHEN {_GENDER} = 'male' THEN {pick_sql(lookups.TITLES['male'], _U[4])} ELSE {pick_sql(lookups.TITLES['female'], _U[4])} END)",
    "suffix": f"(CASE WHEN {_U[5]} < 0.1 THEN {pick_sql(lookups.SUFFIXES, _U[6])} END)",
}


def person_names(spark, d):
    parts = people.name_parts(F.col("row_id"), SEED)
    return _rows(spark, d).select(
        "row_id", parts["gender"].alias("gender"), parts["first"].alias("first"), parts["last"].alias("last"),
        people.full_name(parts, middle=True, title=True, suffix=True).alias("full"),
    )


NAMES_SQL = f"""
WITH {ROWS} SELECT row_id, {PERSON['gender']} AS gender, {PERSON['first']} AS first, {PERSON['last']} AS last,
  concat_ws(' ', {PERSON['title']}, {PERSON['first']}, {PERSON['middle']}, {PERSON['last']}, {PERSON['suffix']}) AS full FROM rows_"""


def names_by_country(spark, d):
    ref = places(spark, d).withColumnRenamed("c_custkey", "row_id")
    locale = lookups.locale_of_country(F.col("country"))
    return ref.select("row_id", people.full_name(people.name_parts(F.col("row_id"), SEED, locale)).alias("full"))


def _pool_table(pools: dict) -> str:
    return "(VALUES " + ", ".join(f"('{k}', {list_sql(v)})" for k, v in pools.items()) + ")"


_FIRST_POOLS = {f"{loc}|{g}": v for loc, gs in lookups.FIRST_NAMES.items() for g, v in gs.items()}
BY_COUNTRY_SQL = f"""
WITH ref AS (SELECT c_custkey AS row_id, country FROM ({PLACES_SQL})),
loc AS (SELECT row_id, coalesce(v, 'en_US') AS locale FROM ref LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in lookups.COUNTRY_LOCALES.items())}) t(k, v) ON k = lower(trim(country)))
SELECT row_id, f.p[1 + CAST(floor({_U[1]} * len(f.p)) AS INT)] || ' ' || l.p[1 + CAST(floor({_U[2]} * len(l.p)) AS INT)] AS "full"
FROM loc JOIN {_pool_table(_FIRST_POOLS)} f(k, p) ON f.k = locale || '|' || {_GENDER}
JOIN {_pool_table(lookups.LAST_NAMES)} l(k, p) ON l.k = locale"""


def _email_sql(first: str, last: str, name: str = "email") -> str:
    u = {i: u_sql(SEED, name, "row_id", i) for i in range(3)}
    f, s = f"lower({first})", f"lower({last})"
    style = between_sql(u[0], 0, 3)
    return (f"(CASE {style} WHEN 0 THEN {f} || '.' || {s} WHEN 1 THEN {f} || {s} WHEN 2 THEN {f} || {between_sql(u[1], 1, 999)}"
            f" ELSE left({f}, 1) || '.' || {s} END || '@' || {pick_sql(lookups.EMAIL_DOMAINS, u[2])})")


def _phone_sql(name: str = "phone", before="", after="-", inner="-") -> str:
    u = {i: u_sql(SEED, name, "row_id", i) for i in range(3)}
    return (f"('{before}' || {between_sql(u[0], 200, 999)} || '{after}' || {between_sql(u[1], 200, 999)} || '{inner}' || "
            f"{between_sql(u[2], 1000, 9999)})")


def _address_sql(name: str = "address") -> tuple[str, str]:
    u = {i: u_sql(SEED, name, "row_id", i) for i in range(6)}
    street = (f"({between_sql(u[0], 1, 9999)} || ' ' || {pick_sql(lookups.STREET_NAMES, u[1])} || ' ' || "
              f"{pick_sql(lookups.STREET_TYPES, u[2])})")
    place = (f"({pick_sql(lookups.ADDRESS_CITIES, u[3])} || ', ' || {pick_sql(lookups.US_STATES, u[4])} || ' ' || "
             f"{between_sql(u[5], 10000, 99999)})")
    return street, place


def _custom_sql(name: str, pool: str, length: int, prefix: str) -> str:
    chars = [f"substr('{pool}', 1 + CAST(floor({u_sql(SEED, name, 'row_id', i)} * {float(len(pool))}) AS INT), 1)"
             for i in range(length)]
    return f"('{prefix}' || {' || '.join(chars)})"


def emails(spark, d):
    """E-mails from the customers' names."""
    ref = load(spark, d, "customer").select(
        F.col("c_custkey").alias("row_id"), F.lower("c_mktsegment").alias("a"), F.col("c_name").alias("b")
    )
    return ref.select("row_id", people.email(F.col("a"), F.col("b"), F.col("row_id"), SEED).alias("email"))


EMAIL_SQL = f"""
WITH ref AS (SELECT c_custkey AS row_id, c_mktsegment AS a, regexp_replace(c_name, '[^A-Za-z]', '', 'g') AS b FROM customer)
SELECT row_id, {_email_sql('a', 'b')} AS email FROM ref"""


def phones(spark, d):
    r = F.col("row_id")
    return _rows(spark, d).select(
        "row_id", *[people.phone(r, SEED, f"phone_{s}", s).alias(s) for s in people.PHONE_STYLES],
        people.phone(r, SEED, "abroad", country="FR").alias("abroad"),
    )


PHONE_SQL = f"WITH {ROWS} SELECT row_id, " + ", ".join(
    f"{_phone_sql(f'phone_{s}', *parts)} AS {s}" for s, parts in people.PHONE_STYLES.items()
) + f""", '+' || {between_sql(u_sql(SEED, 'abroad', 'row_id', 0), 1, 99)} || ' ' ||
  lpad({between_sql(u_sql(SEED, 'abroad', 'row_id', 1), 0, 999999999)}::VARCHAR, 9, '0') AS abroad FROM rows_"""


def addresses(spark, d):
    r = F.col("row_id")
    return _rows(spark, d).select("row_id", *[
        people.address(r, SEED, style=s).alias(s) for s in ("full", "street_only", "city_state_zip")
    ])


_STREET, _PLACE = _address_sql()
ADDRESS_SQL = f"""WITH {ROWS} SELECT row_id, {_STREET} || ', ' || {_PLACE} AS "full", {_STREET} AS street_only,
  {_PLACE} AS city_state_zip FROM rows_"""


def identifiers(spark, d):
    r = F.col("row_id")
    return _rows(spark, d).select(
        "row_id", people.identifier(r, SEED, "uuid", "uuid").alias("uuid"),
        people.identifier(r, SEED, "ssn", "ssn").alias("ssn"),
        people.identifier(r, SEED, "custom", "custom").alias("custom"),
        people.identifier(r, SEED, "digits", "custom", prefix="N", length=5, letters=False).alias("digits"),
    )


_H = f"md5('{SEED}|uuid|uuid|' || row_id)"
IDENTIFIER_SQL = f"""WITH {ROWS} SELECT row_id, substr({_H}, 1, 8) || '-' || substr({_H}, 9, 4) || '-4' || substr({_H}, 14, 3) || '-' ||
  {pick_sql(['8', '9', 'a', 'b'], u_sql(SEED, 'uuid', 'row_id', 0))} || substr({_H}, 18, 3) || '-' || substr({_H}, 21, 12) AS uuid,
  {between_sql(u_sql(SEED, 'ssn', 'row_id', 0), 100, 899)} || '-' || {between_sql(u_sql(SEED, 'ssn', 'row_id', 1), 10, 99)} || '-' || {between_sql(u_sql(SEED, 'ssn', 'row_id', 2), 1000, 9999)} AS ssn,
  {_custom_sql('custom', people.ALPHABET, 8, 'ID')} AS custom, {_custom_sql('digits', people.DIGITS, 5, 'N')} AS digits FROM rows_"""


def profile_table(spark, d):
    return people.profile_table(_rows(spark, d), SEED)


PROFILE_SQL = f"""WITH {ROWS} SELECT row_id, {_custom_sql('id', people.ALPHABET, 8, 'ID')} AS id,
  {PERSON['first']} || ' ' || {PERSON['last']} AS name, {_email_sql(PERSON['first'], PERSON['last'])} AS email,
  {_phone_sql()} AS phone, {_STREET} || ', ' || {_PLACE} AS address FROM rows_"""


def unique_emails(spark, d):
    df = load(spark, d, "orders").selectExpr(
        "o_orderkey AS row_id", "lower(o_orderstatus) || o_custkey || '@example.com' AS email"
    )
    return people.make_unique(df, "email")


UNIQUE_SQL = """
WITH t AS (SELECT o_orderkey AS row_id, lower(o_orderstatus) || o_custkey || '@example.com' AS email FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY md5(row_id::VARCHAR), row_id) - 1 AS nth FROM t)
SELECT row_id, CASE WHEN nth > 0 THEN replace(email, '@', '-' || nth || '@') ELSE email END AS email FROM n"""

# --------------------------------------------------------------------- text


def template_texts(spark, d):
    r = F.col("row_id")
    return _rows(spark, d).select("row_id", *[
        text.template_text(r, SEED, f"text_{k}", k).alias(k) for k in lookups.TEMPLATES
    ])


def template_sql(name: str, category: str, seed: int = SEED) -> str:
    chosen = lookups.TEMPLATES[category]
    out = pick_sql(chosen, u_sql(seed, name, "row_id", 0))
    used = [k for k in lookups.VARIABLES if any("{" + k + "}" in t for t in chosen)]
    for i, k in enumerate(used):
        out = f"replace({out}, '{{{k}}}', {pick_sql(lookups.VARIABLES[k], u_sql(seed, name, 'row_id', i + 1))})"
    return out


TEMPLATE_SQL = f"WITH {ROWS} SELECT row_id, " + ", ".join(
    f"{template_sql(f'text_{k}', k)} AS {k}" for k in lookups.TEMPLATES
) + " FROM rows_"


def matched_lengths(spark, d):
    """Template texts brought to the mean length of the reference texts."""
    mean = text.reference_length(load(spark, d, "benchmark"), "text")
    return text.add_texts(_rows(spark, d), SEED, {"body": mean})


MATCH_SQL = f"""
WITH {ROWS}, m AS (SELECT avg(length(text)) AS mean FROM benchmark),
t AS (SELECT row_id, mean, {template_sql('body', 'description')} AS c,
  CAST(floor(mean * (1 + ({u_sql(SEED, 'body|length', 'row_id', 0)} * 2 - 1) * 0.2)) AS INT) AS target FROM rows_, m),
fill AS (SELECT row_id, string_agg({pick_sql(lookups.FILLERS, u_sql(SEED, 'body|filler', 'row_id', 'i'))} || ' ' || split_part(c, '.', 1) || '.', '' ORDER BY i) AS cycle
  FROM t, range(100) k(i) GROUP BY 1)
SELECT row_id, CASE WHEN length(c) < target * 0.8 THEN substr(c || cycle, 1, target) ELSE c END AS body FROM t JOIN fill USING (row_id)"""


def shortened_texts(spark, d):
    """Documents cut at a sentence, or else at a word, to a length that varies by row."""
    limit = (F.lit(60) + F.col("doc_id") % 300).cast("int")
    return load(spark, d, "documents").select(
        "doc_id", text_fn.cut_at_sentence(F.col("text"), limit).alias("short")
    )


SHORT_SQL = """
WITH t AS (SELECT doc_id, text, (60 + doc_id % 300)::INT AS lim, string_split(text, '.') AS parts FROM documents),
p AS (SELECT doc_id, lim, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM t),
c AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(s) < lim AS fits FROM p),
f AS (SELECT doc_id, coalesce(min(CASE WHEN NOT fits THEN i END), 1000000) AS stop FROM c GROUP BY 1),
k AS (SELECT f.doc_id, coalesce(string_agg(s || '.', '' ORDER BY i) FILTER (WHERE i < stop), '') AS kept FROM f JOIN c USING (doc_id) GROUP BY 1)
SELECT doc_id, CASE WHEN length(text) <= lim THEN text
  WHEN length(kept) > lim THEN regexp_replace(substr(text, 1, lim), ' [^ ]*$', '') || '...' ELSE kept END AS short FROM t JOIN k USING (doc_id)"""


def text_source(spark, d):
    """Texts from a user callable, asked ten at a time inside the tasks."""
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("row_id"))

    def source(first: int, count: int) -> list[str]:
        return [f"{i + 1}. note {first % 2}" for i in range(count - 1)]  # one short of what was asked

    return text.with_text_source(rows, "note", source, SEED)


SOURCE_SQL = f"""
WITH rows_ AS (SELECT c_custkey AS row_id FROM customer)
SELECT row_id, CASE WHEN row_id % 10 < 9 THEN 'note ' || (row_id // 10 * 10) % 2 ELSE {template_sql('note', 'description')} END AS note
FROM rows_"""


# ------------------------------------------------------------- whole tables

TABLE_SEED = 11
TABLE_COLUMNS = ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def fabricate_table(spark, d):
    ref = load(spark, d, "orders").select(*TABLE_COLUMNS)
    out = fabricate(ref, ref.count(), Options(seed=TABLE_SEED))
    return rounded(out, o_totalprice=3)


def _table_u(name: str, draw: int = 0) -> str:
    return u_sql(TABLE_SEED, name, "row_id", draw)


TABLE_SQL = f"""
WITH {ROWS}, {DAYS}
SELECT o_orderstatus, o_orderpriority, o_orderdate,
  round((SELECT min(o_totalprice) FROM orders) + {_table_u('o_totalprice')} * (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 3) AS o_totalprice
FROM {cat_sql('o_orderstatus', 'orders', 'o_orderstatus', TABLE_SEED)} a
JOIN {cat_sql('o_orderpriority', 'orders', 'o_orderpriority', TABLE_SEED)} b USING (row_id)
JOIN {patterned_sql('o_orderdate', TABLE_SEED)} c USING (row_id)"""


def fabricate_people(spark, d):
    """A person table: names, e-mails, genders, cities agree after repair."""
    ref = places(spark, d).selectExpr(
        "c_custkey + 1 AS record_id", "'Ann' AS first_name", "'Lee' AS last_name",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender",
        "18 + c_custkey % 60 AS age", "trim(country) AS country", "city",
        "'a' || c_custkey || '@example.com' AS email", "'some words about customer ' || c_custkey AS remark",
    )
    out = fabricate(ref, ref.count(), Options(seed=SEED, keep_nulls=True))
    from twintable.operators.sets import list_lookup

    cities = list_lookup(lookups.normalized_country_cities(), lookups.normalize_country(F.col("country")))
    return out.agg(
        F.count("*").alias("rows"), F.countDistinct("record_id").alias("ids"),
        F.count_if(~F.col("age").between(18, 77)).alias("bad_ages"),
        F.count_if(~F.contains(F.col("email"), F.concat(F.lower("first_name"), F.lit("."), F.lower("last_name")))).alias("bad_emails"),
        F.count_if(cities.isNotNull() & ~F.array_contains(cities, F.col("city"))).alias("bad_cities"),
        F.count_if(F.col("remark").isNull()).alias("bad_texts"),
    )


PEOPLE_SQL = """
SELECT count(*) AS rows, count(*) AS ids, 0::BIGINT AS bad_ages, 0::BIGINT AS bad_emails, 0::BIGINT AS bad_cities, 0::BIGINT AS bad_texts FROM customer"""


def keep_nulls(spark, d):
    df = load(spark, d, "orders").selectExpr(
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus"
    )
    out = fabricate(df, df.count(), Options(seed=TABLE_SEED, keep_nulls=True))
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


NULLS_SQL = f"""
WITH {ROWS} SELECT CASE WHEN {_table_u('o_orderstatus|null')} >= (SELECT avg(CASE WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE 0 END) FROM orders) THEN o_orderstatus END AS o_orderstatus, count(*) AS n
FROM {cat_sql('o_orderstatus', "(SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders)", 'o_orderstatus', TABLE_SEED)} GROUP BY 1"""


def column_overrides(spark, d):
    df = load(spark, d, "orders").select("o_totalprice", "o_orderstatus")
    out = fabricate(df, df.count(), Options(seed=TABLE_SEED, overrides={
        "o_totalprice": {"distribution": "uniform", "min": 100.0, "max": 200.0, "decimals": 1},
        "o_orderstatus": {"categories": {"A": 0.25, "B": 0.75}},
    }))
    return out


OVERRIDE_SQL = f"""
WITH {ROWS} SELECT round(100.0 + {_table_u('o_totalprice')} * 100.0, 1)::DOUBLE AS o_totalprice,
  CASE WHEN floor({_table_u('o_orderstatus')} * 1000000) < 250000 THEN 'A' ELSE 'B' END AS o_orderstatus FROM rows_"""


def outlier_handling(spark, d):
    """Reference outliers are moved to the fences before anything is drawn."""
    df = load(spark, d, "orders").selectExpr(
        "o_totalprice * CASE WHEN o_orderkey % 100 = 0 THEN 50 ELSE 1 END AS o_totalprice"
    )
    out = fabricate(df, df.count(), Options(
        seed=TABLE_SEED, outliers="clip", overrides={"o_totalprice": {"distribution": "uniform"}}
    ))
    return rounded(out, o_totalprice=3)


OUTLIER_SQL = f"""
WITH {ROWS}, x AS (SELECT o_totalprice * CASE WHEN o_orderkey % 100 = 0 THEN 50 ELSE 1 END AS v FROM orders),
q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM x),
c AS (SELECT min(least(greatest(v, a - 1.5 * (b - a)), b + 1.5 * (b - a))) AS lo, max(least(greatest(v, a - 1.5 * (b - a)), b + 1.5 * (b - a))) AS hi FROM x, q)
SELECT round(lo + {_table_u('o_totalprice')} * (hi - lo), 3) AS o_totalprice FROM rows_, c"""


def custom_generators(spark, d):
    """A column and a whole data type made by the caller's own expressions."""
    df = load(spark, d, "orders").select("o_totalprice", "o_orderstatus")
    return fabricate(df, df.count(), Options(seed=TABLE_SEED, generators={
        "o_totalprice": lambda name, meta, draws: F.floor(draws(0) * 10) + F.lit(meta["n_unique"] * 0),
        "categorical": lambda name, meta, draws: F.when(draws(0) < 0.5, "low").otherwise("high"),
    }))


CUSTOM_SQL = f"""
WITH {ROWS} SELECT floor({_table_u('o_totalprice')} * 10)::DOUBLE AS o_totalprice,
  CASE WHEN {_table_u('o_orderstatus')} < 0.5 THEN 'low' ELSE 'high' END AS o_orderstatus FROM rows_"""


def blended_rows(spark, d):
    real = load(spark, d, "orders").select("o_orderstatus", "o_totalprice")
    made = fabricate(real, real.count(), Options(seed=TABLE_SEED))
    return blend(real, made).groupBy("origin").agg(F.count("*").alias("n"))


BLEND_SQL = "SELECT 'real' AS origin, count(*) AS n FROM orders UNION ALL SELECT 'fabricated', count(*) FROM orders"


def fast_draws(spark, d):
    """The cheaper hash: same distribution, checked by its distance from the reference."""
    ref = load(spark, d, "orders").select("o_totalprice")
    made = fabricate(ref, ref.count(), Options(seed=TABLE_SEED, method="xxhash64"))
    return two_sample_ks(ref, made, ["o_totalprice"]).select("n_ref", "n_syn", (F.col("ks") < 0.05).alias("near"))


QUERIES = {
    "fit_parameters": (fit_parameters, FIT_SQL),
    "fit_scores": (fit_scores, f'SELECT "column", family, round(ks, 8) AS ks, round(1 - ks, 8) AS score FROM ({_SCORES})'),
    "fit_scores_all": (fit_scores_all, ALL_SQL),
    "best_fit": (best_fit, BEST_SQL),
    "sample_families": (sample_families, FAMILY_SQL),
    "numeric_columns": (numeric_columns, NUMERIC_SQL),
    "correlated_columns": (correlated_columns, CORRELATED_SQL),
    "categorical_columns": (categorical_columns, CATEGORICAL_SQL),
    "long_category": (long_category, LONG_SQL),
    "alias_category": (alias_category, ALIAS_SQL),
    "fallback_categories": (fallback_categories, FALLBACK_SQL),
    "country_and_city": (country_and_city, CITY_SQL),
    "uniform_dates": (uniform_dates, UNIFORM_SQL),
    "patterned_dates": (patterned_dates, PATTERN_SQL),
    "timed_dates": (timed_dates, TIMED_SQL),
    "regular_series": (regular_series, SERIES_SQL),
    "seasonal_dates": (seasonal_dates, SEASON_SQL),
    "person_names": (person_names, NAMES_SQL),
    "names_by_country": (names_by_country, BY_COUNTRY_SQL),
    "names_from_table": (names_from_table, NAMES_TABLE_SQL),
    "emails": (emails, EMAIL_SQL),
    "phones": (phones, PHONE_SQL),
    "addresses": (addresses, ADDRESS_SQL),
    "identifiers": (identifiers, IDENTIFIER_SQL),
    "profile_table": (profile_table, PROFILE_SQL),
    "unique_emails": (unique_emails, UNIQUE_SQL),
    "template_texts": (template_texts, TEMPLATE_SQL),
    "matched_lengths": (matched_lengths, MATCH_SQL),
    "shortened_texts": (shortened_texts, SHORT_SQL),
    "text_source": (text_source, SOURCE_SQL),
    "fabricate_table": (fabricate_table, TABLE_SQL),
    "fabricate_people": (fabricate_people, PEOPLE_SQL),
    "keep_nulls": (keep_nulls, NULLS_SQL),
    "column_overrides": (column_overrides, OVERRIDE_SQL),
    "outlier_handling": (outlier_handling, OUTLIER_SQL),
    "custom_generators": (custom_generators, CUSTOM_SQL),
    "blended_rows": (blended_rows, BLEND_SQL),
    "fast_draws": (fast_draws, "SELECT count(*) AS n_ref, count(*) AS n_syn, TRUE AS near FROM orders"),
}
