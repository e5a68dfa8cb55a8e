"""Disclosure risk and fidelity reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregation import ks_sql
from catalog.common import load, rounded, union_all
from twintable.functions.text import TOKEN
from twintable.plans import fidelity, risk

# --------------------------------------------------------------------- risk
QUASI = ["c_nationkey", "c_mktsegment"]


def k_anonymity(spark, d):
    return risk.k_anonymity(load(spark, d, "customer"), QUASI, k=5)


K_SQL = """
SELECT min(n) >= 5 AS satisfied, min(n) AS min_group_size, 5::INT AS required_k,
  count(*) FILTER (WHERE n < 5) AS groups_below_k, count(*) AS total_groups
FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)"""


def suggest_quasi_identifiers(spark, d):
    return rounded(risk.suggest_quasi_identifiers(load(spark, d, "part")), ratio=6)


SUGGEST_SQL = "SELECT * FROM (" + union_all([f"""
SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct, round(count(DISTINCT {c}) / count(*), 6) AS ratio FROM part"""
    for c in ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]]) + \
    ") WHERE n_distinct > 2 AND n_distinct < 100 AND ratio > 0.01 AND ratio < 0.5"


def _entropy_sql(table: str, c: str) -> str:
    return (f"(SELECT -sum(n / t * log2(n / t + 1e-12)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1 END FROM "
            f"(SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}))")


def reid_sql(table: str, cols: list[str]) -> str:
    keys = ", ".join(cols)
    entropy = " + ".join(_entropy_sql(table, c) for c in cols)
    product = " * ".join(f"(SELECT count(DISTINCT {c})::DOUBLE FROM {table})" for c in cols)
    return f"""
SELECT *, CASE WHEN risk < 0.25 THEN 'low' WHEN risk < 0.5 THEN 'medium' WHEN risk < 0.75 THEN 'high' ELSE 'critical' END AS risk_level
FROM (SELECT u * 0.4 + e * 0.3 + c * 0.3 AS risk, u AS uniqueness_score, e AS distinctiveness_score, c AS combinatorial_risk
 FROM (SELECT (SELECT count(*) FROM (SELECT 1 FROM {table} GROUP BY {keys} HAVING count(*) = 1)) / (SELECT count(*) FROM {table}) AS u,
   ({entropy}) / {len(cols)} AS e, least(1.0, {product} / (SELECT count(*) FROM {table})) AS c))"""


REID_COLUMNS = ["p_brand", "p_type", "p_size"]


def reidentification_risk(spark, d):
    return rounded(risk.reidentification_risk(load(spark, d, "part"), REID_COLUMNS),
                   risk=6, uniqueness_score=6, distinctiveness_score=6, combinatorial_risk=6)


REID_SQL = f"""SELECT round(risk, 6) AS risk, risk_level, round(uniqueness_score, 6) AS uniqueness_score,
  round(distinctiveness_score, 6) AS distinctiveness_score, round(combinatorial_risk, 6)::DOUBLE AS combinatorial_risk
FROM ({reid_sql('part', REID_COLUMNS)})"""


def uniqueness_analysis(spark, d):
    return rounded(risk.uniqueness(load(spark, d, "part"), ["p_brand", "p_size"]),
                   unique_percentage=6, rare_percentage=6)


UNIQ_SQL = """
SELECT (SELECT count(*) FROM part) AS total_records, count(*) AS total_unique_combinations,
  count(*) FILTER (WHERE n = 1) AS unique_records, count(*) FILTER (WHERE n <= 3) AS rare_records,
  round(count(*) FILTER (WHERE n = 1) / count(*) * 100, 6) AS unique_percentage,
  round(count(*) FILTER (WHERE n <= 3) / count(*) * 100, 6) AS rare_percentage
FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_size)"""

_UNIQ_COLS = ["p_brand", "p_size", "p_name", "p_retailprice"]


def column_uniqueness(spark, d):
    return rounded(risk.column_uniqueness(load(spark, d, "part"), _UNIQ_COLS), unique_ratio=6)


COLUMN_UNIQ_SQL = union_all([f"""
SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count(*), 6) AS unique_ratio FROM part"""
    for c in _UNIQ_COLS])

_LEAK = ["l_suppkey", "l_linenumber", "l_returnflag", "l_quantity"]


def _leak_sides(spark, d):
    df = load(spark, d, "lineitem")
    syn = df.filter("l_orderkey % 2 = 1").withColumn(
        "l_quantity", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity"))
    )
    return df.filter("l_orderkey % 2 = 0").select(*_LEAK), syn.select(*_LEAK)


def data_leakage(spark, d):
    return rounded(risk.data_leakage(*_leak_sides(spark, d)), leakage_ratio=6, score=6)


LEAK_SQL = """
WITH r AS (SELECT l_suppkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE l_orderkey % 2 = 0),
s AS (SELECT l_suppkey, l_linenumber, l_returnflag, CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS l_quantity FROM lineitem WHERE l_orderkey % 2 = 1),
x AS (SELECT count(*) AS shared_rows, (SELECT count(*) FROM s) AS n FROM (SELECT * FROM r INTERSECT SELECT * FROM s WHERE l_quantity IS NOT NULL))
SELECT shared_rows, round(shared_rows / n, 6) AS leakage_ratio, round(1 - shared_rows / n, 6) AS score,
  CASE WHEN shared_rows = 0 THEN 'low' WHEN shared_rows / n < 0.05 THEN 'medium' WHEN shared_rows / n < 0.1 THEN 'high' ELSE 'critical' END AS risk_level FROM x"""

_CUSTOMER = ["c_nationkey", "c_mktsegment"]


def _report(spark, d):
    df = load(spark, d, "customer").select("c_custkey", *_CUSTOMER, "c_acctbal")
    syn, ref = df.filter("c_custkey % 3 <> 0"), df.filter("c_custkey % 3 <> 1")
    return risk.privacy_report(syn.drop("c_custkey"), ref.drop("c_custkey"), _CUSTOMER)


def privacy_report(spark, d):
    return rounded(_report(spark, d), value=6).select("metric", "value", "passed", "risk_level")


REPORT_SQL = f"""
WITH syn AS (SELECT c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 3 <> 0),
ref AS (SELECT c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 3 <> 1),
g AS (SELECT count(*) AS n FROM syn GROUP BY c_nationkey, c_mktsegment),
reid AS ({reid_sql('syn', _CUSTOMER)}),
u AS (SELECT count(*) FILTER (WHERE n = 1) / count(*) AS r FROM g),
l AS (SELECT count(*) / (SELECT count(*) FROM syn) AS r FROM (SELECT * FROM ref INTERSECT SELECT * FROM syn)),
report AS (
 SELECT 'k_anonymity' AS metric, min(n) / 5 AS value, min(n) >= 5 AS passed, CASE WHEN min(n) >= 5 THEN 'low' ELSE 'high' END AS risk_level FROM g
 UNION ALL SELECT 'reidentification_risk', 1 - risk, risk < 0.5, risk_level FROM reid
 UNION ALL SELECT 'uniqueness', 1 - r, r < 0.3, CASE WHEN r < 0.1 THEN 'low' WHEN r < 0.3 THEN 'medium' WHEN r < 0.5 THEN 'high' ELSE 'critical' END FROM u
 UNION ALL SELECT 'data_leakage', 1 - r, 1 - r > 0.95, CASE WHEN r = 0 THEN 'low' WHEN r < 0.05 THEN 'medium' WHEN r < 0.1 THEN 'high' ELSE 'critical' END FROM l)"""


def privacy_summary(spark, d):
    return risk.privacy_summary(_report(spark, d))


SUMMARY_SQL = REPORT_SQL + """
SELECT count(*) AS total_metrics, count(*) FILTER (WHERE risk_level = 'critical') AS critical_risks,
  count(*) FILTER (WHERE risk_level = 'high') AS high_risks,
  (['low', 'medium', 'high', 'critical'])[max(list_position(['low', 'medium', 'high', 'critical'], risk_level))] AS overall_risk,
  max(list_position(['low', 'medium', 'high', 'critical'], risk_level)) <= 2 AS passed FROM report"""


def privacy_recommendations(spark, d):
    return risk.recommendations(_report(spark, d)).select("recommendation")


ADVICE_SQL = REPORT_SQL + f"""
, advice AS (
 SELECT '{risk.ADVICE['k']}' AS recommendation FROM report WHERE metric = 'k_anonymity' AND value < 1 AND value > 0
 UNION ALL SELECT '{risk.ADVICE['reid']}' FROM report WHERE metric = 'reidentification_risk' AND value < 0.5
 UNION ALL SELECT '{risk.ADVICE['critical']}' WHERE EXISTS (SELECT 1 FROM report WHERE risk_level = 'critical')
 UNION ALL SELECT '{risk.ADVICE['high']}' WHERE EXISTS (SELECT 1 FROM report WHERE risk_level = 'high') AND NOT EXISTS (SELECT 1 FROM report WHERE risk_level = 'critical'))
SELECT * FROM advice UNION ALL SELECT '{risk.ADVICE['passed']}' WHERE NOT EXISTS (SELECT 1 FROM advice)"""


def privacy_critical(spark, d):
    report = _report(spark, d)
    worst = risk.risks_at(report, "critical").unionByName(risk.risks_at(report, "high"))
    return rounded(worst, value=6).select("metric", "value", "risk_level")


def enforce_k_anonymity(spark, d):
    return risk.enforce_k_anonymity(
        load(spark, d, "part"), ["p_brand", "p_size", "p_type"], k=5,
        widths={"p_size": 10}, prefixes={"p_brand": 6},
    )


ENFORCE_SQL = """
SELECT * FROM (SELECT p_partkey, p_name, substr(p_brand, 1, 6) AS p_brand, p_type, (floor(p_size / 10) * 10)::INT AS p_size, p_retailprice FROM part)
QUALIFY count(*) OVER (PARTITION BY p_brand, p_size, p_type) >= 5"""

# ----------------------------------------------------------------- fidelity
LINE = ["l_quantity", "l_extendedprice", "l_discount"]
_R, _S = "l_orderkey % 2 = 0", "l_orderkey % 2 = 1 AND l_extendedprice < 90000"


def _line_sides(spark, d):
    df = load(spark, d, "lineitem")
    return df.filter(_R), df.filter(_S)


def numeric_fidelity(spark, d):
    ref, syn = _line_sides(spark, d)
    out = fidelity.numeric_metrics(ref, syn, LINE)
    return rounded(out, value=6).drop("details")


def _diff(a: str, b: str) -> str:
    return f"abs({a} - {b}) / (abs({a}) + 1e-9)"


def numeric_parts(table: str, columns: list[str], r: str, s: str, threshold: float, corr: bool) -> list[str]:
    parts = []
    for c in columns:
        both = f"""(SELECT avg({c}) FILTER (WHERE {r}) AS rm, avg({c}) FILTER (WHERE {s}) AS sm,
  stddev_samp({c}) FILTER (WHERE {r}) AS rd, stddev_samp({c}) FILTER (WHERE {s}) AS sd,
  min({c}) FILTER (WHERE {r}) AS rl, min({c}) FILTER (WHERE {s}) AS sl, max({c}) FILTER (WHERE {r}) AS rh, max({c}) FILTER (WHERE {s}) AS sh,
  quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) FILTER (WHERE {r}) AS rq, quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) FILTER (WHERE {s}) AS sq FROM {table})"""
        diffs = " + ".join([_diff("rm", "sm"), _diff("rd", "sd")] + [_diff(f"rq[{i}]", f"sq[{i}]") for i in (1, 2, 3)])
        parts += [
            f"SELECT '{c}' AS c, 'ks_test' AS metric, greatest(0.0, least(1.0, 1 - ks)) AS value, {threshold} AS threshold FROM {ks_sql(table, c, r, s)}",
            f"SELECT '{c}', 'statistics', greatest(0.0, least(1.0, 1 - ({diffs}) / 5)), {threshold} FROM {both}",
            f"SELECT '{c}', 'range', CASE WHEN rh = rl THEN 1.0 ELSE 1 - CASE WHEN sl < rl - 0.1 * (rh - rl) THEN 0.2 ELSE 0 END - CASE WHEN sh > rh + 0.1 * (rh - rl) THEN 0.2 ELSE 0 END END, {threshold} FROM {both}",
        ]
    if corr:
        cells = [f"abs(corr({a}, {b}) FILTER (WHERE {r}) - corr({a}, {b}) FILTER (WHERE {s}))"
                 for a in columns for b in columns]
        parts.append(f"SELECT '*', 'correlation_preservation', 1 - ({' + '.join(cells)}) / {len(cells)}, {threshold} FROM {table}")
    return parts


def _final(parts: list[str]) -> str:
    return f"""SELECT c AS "column", metric, round(value, 6)::DOUBLE AS value, threshold::DOUBLE AS threshold,
  value >= threshold AS passed FROM ({union_all(parts)}) t(c, metric, value, threshold)"""


def text_fidelity(spark, d):
    df = load(spark, d, "documents")
    out = fidelity.text_metrics(df.filter("doc_id % 2 = 0"), df.filter("doc_id % 2 = 1"), ["text", "source"])
    return rounded(out, value=6).drop("details")


def text_parts(table: str, columns: list[str], r: str, s: str, threshold: float) -> list[str]:
    parts = []
    for c in columns:
        n = f"length({c})"
        parts.append(f"""SELECT '{c}', 'length_distribution', greatest(0.0, least(1.0, 1 - (abs(rm - sm) / (rm + 1e-9) + abs(rd - sd) / (rd + 1e-9) + ks) / 3)), {threshold}
FROM (SELECT avg({n}) FILTER (WHERE {r}) AS rm, avg({n}) FILTER (WHERE {s}) AS sm, stddev_samp({n}) FILTER (WHERE {r}) AS rd, stddev_samp({n}) FILTER (WHERE {s}) AS sd FROM {table}),
 {ks_sql(table, n, r, s)} k""")
        parts.append(f"""SELECT '{c}', 'vocabulary', 0.7 * sum(a * b) / count(*) + 0.3 * greatest(0.0, 1 - abs(sum(a) / sum(ra) - sum(b) / sum(sa))), {threshold}
FROM (SELECT max(CASE WHEN r THEN 1 ELSE 0 END) AS a, max(CASE WHEN s THEN 1 ELSE 0 END) AS b,
   sum(CASE WHEN r THEN 1 ELSE 0 END) AS ra, sum(CASE WHEN s THEN 1 ELSE 0 END) AS sa
 FROM (SELECT {r} AS r, {s} AS s, unnest(regexp_extract_all(lower({c}), '{TOKEN}')) AS w FROM {table}) WHERE r OR s GROUP BY w)""")
        parts.append(f"""SELECT '{c}', 'uniqueness', 1 - abs(count(DISTINCT {c}) FILTER (WHERE {r}) / count({c}) FILTER (WHERE {r})
  - count(DISTINCT {c}) FILTER (WHERE {s}) / count({c}) FILTER (WHERE {s})), {threshold} FROM {table}""")
    return parts


MAILS = {
    "mail": "CASE WHEN c_custkey % 10 = 3 THEN 'broken' ELSE 'user' || (c_custkey % 700) || '@example.com' END",
    "line": "'555-' || lpad((c_custkey % 1000) || '', 3, '0') || '-' || lpad((c_custkey % 10000) || '', 4, '0')",
    "nick": "c_mktsegment",
}


def pii_fidelity(spark, d):
    df = load(spark, d, "customer").selectExpr("c_custkey", *[f"{e} AS {c}" for c, e in MAILS.items()])
    out = fidelity.pii_metrics(
        df.filter("c_custkey % 2 = 0"), df.filter("c_custkey % 3 = 1"),
        {"mail": "email", "line": "phone", "nick": "name"},
    )
    return rounded(out, value=6).drop("details")


def _pii_sql() -> str:
    t = "(SELECT c_custkey, " + ", ".join(f"{e} AS {c}" for c, e in MAILS.items()) + " FROM customer)"
    parts = []
    for c, kind in [("mail", "email"), ("line", "phone"), ("nick", None)]:
        fmt = f"avg(CASE WHEN regexp_matches({c}, '{fidelity.FORMATS[kind]}') THEN 1.0 ELSE 0.0 END)" if kind else "1.0"
        parts += [
            f"SELECT '{c}', 'format_validity', {fmt}, 0.8 FROM {t} WHERE c_custkey % 3 = 1 {'' if kind else 'LIMIT 1'}" if kind
            else f"SELECT '{c}', 'format_validity', min(1.0), 0.8 FROM {t} WHERE c_custkey % 3 = 1",
            f"""SELECT '{c}', 'no_leakage', 1 - (SELECT count(*) FROM (SELECT {c} FROM {t} WHERE c_custkey % 2 = 0 INTERSECT SELECT {c} FROM {t} WHERE c_custkey % 3 = 1)) / count(*), 0.95 FROM {t} WHERE c_custkey % 3 = 1""",
            f"SELECT '{c}', 'diversity', count(DISTINCT {c}) / count(*), 0.8 FROM {t} WHERE c_custkey % 3 = 1",
        ]
    return _final(parts)


def temporal_fidelity(spark, d):
    df = load(spark, d, "orders")
    out = fidelity.temporal_metrics(
        df.filter("o_orderdate < '2000-01-01'"), df.filter("o_orderkey % 3 = 0"), ["o_orderdate"]
    )
    return rounded(out, value=6).drop("details")


def temporal_parts(table: str, c: str, r: str, s: str, threshold: float) -> list[str]:
    def js(slot):
        return f"""(SELECT sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS js
 FROM (SELECT count(*) FILTER (WHERE {r}) / sum(count(*) FILTER (WHERE {r})) OVER () AS p,
   count(*) FILTER (WHERE {s}) / sum(count(*) FILTER (WHERE {s})) OVER () AS q FROM {table} GROUP BY {slot}))"""

    span = f"""(SELECT min({c}) FILTER (WHERE {r}) AS rl, max({c}) FILTER (WHERE {r}) AS rh, min({c}) FILTER (WHERE {s}) AS sl, max({c}) FILTER (WHERE {s}) AS sh FROM {table})"""
    slack = "0.1 * greatest(floor(epoch(rh - rl) / 86400), 1) * 86400"
    return [
        f"SELECT '{c}', 'range', 1 - CASE WHEN epoch(sl) < epoch(rl) - {slack} THEN 0.2 ELSE 0 END - CASE WHEN epoch(sh) > epoch(rh) + {slack} THEN 0.2 ELSE 0 END, {threshold} FROM {span}",
        f"SELECT '{c}', 'weekday_distribution', greatest(0.0, 1 - js), {threshold} FROM {js(f'isodow({c})')}",
        f"SELECT '{c}', 'monthly_distribution', greatest(0.0, 1 - js), {threshold} FROM {js(f'month({c})')}",
    ]


_OR, _OS = "o_orderkey % 2 = 0", "o_orderkey % 2 = 1"
_REPORT_COLUMNS = {"o_totalprice": "numeric", "o_custkey": "numeric", "o_orderdate": "temporal",
                   "o_orderpriority": "text", "o_orderstatus": "text"}


def _quality(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", *_REPORT_COLUMNS)
    return fidelity.quality_report(
        df.filter(_OR).drop("o_orderkey"), df.filter(_OS).drop("o_orderkey"), threshold=0.99
    )


def quality_report(spark, d):
    return rounded(_quality(spark, d), value=6).drop("details")


_REPORT_PARTS = (
    numeric_parts("orders", ["o_totalprice", "o_custkey"], _OR, _OS, 0.99, False)
    + temporal_parts("orders", "o_orderdate", _OR, _OS, 0.99)
    + text_parts("orders", ["o_orderpriority", "o_orderstatus"], _OR, _OS, 0.99)
)
_REPORT = f"SELECT c, metric, value, value >= threshold AS passed FROM ({union_all(_REPORT_PARTS)}) t(c, metric, value, threshold)"


def quality_column_scores(spark, d):
    return rounded(fidelity.column_scores(_quality(spark, d)), score=6)


def quality_summary(spark, d):
    return rounded(fidelity.quality_summary(_quality(spark, d), 0.99), overall_score=6)


def quality_failed(spark, d):
    return rounded(fidelity.failed_metrics(_quality(spark, d)), value=6).select("column", "metric", "value")


def ks_details(spark, d):
    """Statistic and p-value behind the KS score."""
    ref, syn = _line_sides(spark, d)
    out = fidelity.numeric_metrics(ref, syn, ["l_quantity"]).filter("metric = 'ks_test'")
    return out.select("column", F.round(F.col("details")["ks"], 9).alias("ks"),
                      F.round(F.col("details")["p"], 6).alias("p"))


KS_DETAIL_SQL = f"""
SELECT 'l_quantity' AS "column", round(ks, 9) AS ks, round(CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0,
  (SELECT sum((CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * i * i * x * x)) FROM range(1, 61) t(i)))) END, 6) AS p
FROM (SELECT ks, sqrt(n_ref * n_syn / (n_ref + n_syn)) * ks AS x FROM {ks_sql('lineitem', 'l_quantity', _R, _S)})"""

QUERIES = {
    "k_anonymity": (k_anonymity, K_SQL),
    "suggest_quasi_identifiers": (suggest_quasi_identifiers, SUGGEST_SQL),
    "reidentification_risk": (reidentification_risk, REID_SQL),
    "uniqueness_analysis": (uniqueness_analysis, UNIQ_SQL),
    "column_uniqueness": (column_uniqueness, COLUMN_UNIQ_SQL),
    "data_leakage": (data_leakage, LEAK_SQL),
    "privacy_report": (privacy_report, REPORT_SQL + " SELECT metric, round(value, 6)::DOUBLE AS value, passed, risk_level FROM report"),
    "privacy_summary": (privacy_summary, SUMMARY_SQL),
    "privacy_recommendations": (privacy_recommendations, ADVICE_SQL),
    "privacy_critical": (privacy_critical, REPORT_SQL + " SELECT metric, round(value, 6)::DOUBLE AS value, risk_level FROM report WHERE risk_level IN ('critical', 'high')"),
    "enforce_k_anonymity": (enforce_k_anonymity, ENFORCE_SQL),
    "numeric_fidelity": (numeric_fidelity, _final(numeric_parts("lineitem", LINE, _R, _S, 0.7, True))),
    "text_fidelity": (text_fidelity, _final(text_parts("documents", ["text", "source"], "doc_id % 2 = 0", "doc_id % 2 = 1", 0.7))),
    "pii_fidelity": (pii_fidelity, _pii_sql()),
    "temporal_fidelity": (temporal_fidelity, _final(temporal_parts("orders", "o_orderdate", "o_orderdate < '2000-01-01'", "o_orderkey % 3 = 0", 0.7))),
    "quality_report": (quality_report, _final(_REPORT_PARTS)),
    "quality_column_scores": (quality_column_scores, f'SELECT c AS "column", round(avg(value), 6) AS score, count(*) AS metrics FROM ({_REPORT}) GROUP BY 1'),
    "quality_summary": (quality_summary, f"SELECT round(avg(value), 6) AS overall_score, avg(value) >= 0.99 AS passed, count(*) AS total_metrics, count(*) FILTER (WHERE passed) AS passed_metrics, count(*) FILTER (WHERE NOT passed) AS failed_metrics FROM ({_REPORT})"),
    "quality_failed": (quality_failed, f'SELECT c AS "column", metric, round(value, 6)::DOUBLE AS value FROM ({_REPORT}) WHERE NOT passed'),
    "ks_details": (ks_details, KS_DETAIL_SQL),
}
