"""Domain knowledge: constraints, relationships, rules, distributions, anonymization."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import between_sql, load, pick_sql, rounded, u_sql, union_all
from twintable.plans import knowledge as kn
from twintable.plans import risk

SEED = 42
CONSTRAINTS = [
    kn.Constraint("o_totalprice", "range", {"min": 50000.0, "max": 300000.0}),
    kn.Constraint("o_totalprice", "precision", {"decimal_places": 0}),
    kn.Constraint("o_orderstatus", "category", {"categories": ["F", "O"]}),
    kn.Constraint("o_orderpriority", "pattern", {"pattern": r"[1-3]-"}),
    kn.Constraint("missing", "range", {"min": 0, "max": 1}),
]
_PICK = pick_sql(["F", "O"], u_sql(SEED, "o_orderstatus|category", "o_orderkey", 0))
_FIXED = f"""SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE {_PICK} END AS o_orderstatus,
  round(least(greatest(o_totalprice, 50000.0), 300000.0))::DOUBLE AS o_totalprice, o_orderdate, o_orderpriority FROM orders"""


def enforce_constraints(spark, d):
    return kn.enforce_constraints(load(spark, d, "orders"), CONSTRAINTS, "o_orderkey")[0]


def constraint_report(spark, d):
    return kn.enforce_constraints(load(spark, d, "orders"), CONSTRAINTS, "o_orderkey")[1]


_CLIP = "least(greatest(o_totalprice, 50000.0), 300000.0)"
CONSTRAINT_REPORT = f"""
SELECT 'o_totalprice' AS "column", 'range' AS "constraint", count(*) FILTER (WHERE o_totalprice <> {_CLIP}) AS modified, count(*) FILTER (WHERE o_totalprice <> {_CLIP}) AS violations FROM orders
UNION ALL SELECT 'o_totalprice', 'precision', count(*) FILTER (WHERE {_CLIP} <> round({_CLIP})), count(*) FILTER (WHERE {_CLIP} <> round({_CLIP})) FROM orders
UNION ALL SELECT 'o_orderstatus', 'category', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')), count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders
UNION ALL SELECT 'o_orderpriority', 'pattern', 0, count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')) FROM orders"""


def pattern_null_out(spark, d):
    rule = kn.Constraint("url", "pattern", {"pattern": r"https://", "null_out": True})
    return kn.enforce_constraints(load(spark, d, "pages").select("page_id", "url"), [rule], "page_id")[0]


def dependency_constraint(spark, d):
    rules = [
        kn.Constraint("p_retailprice", "dependency", {"depends_on": "p_type", "rules": {
            "ECONOMY": {"min": 950, "max": 1000}, "SMALL": {"min": 1200}}}),
        kn.Constraint("p_brand", "dependency", {"depends_on": "p_type", "rules": {"SMALL": ["Brand#1", "Brand#2"]}}),
        kn.Constraint("p_size", "formula", {"formula": "CASE WHEN p_type = 'ECONOMY' THEN p_size * 2 END"}),
    ]
    return kn.enforce_constraints(load(spark, d, "part"), rules, "p_partkey")[0]


_BRAND = pick_sql(["Brand#1", "Brand#2"], u_sql(SEED, "p_brand|dependency", "p_partkey", 0))
DEPENDENCY_SQL = f"""
SELECT p_partkey, p_name, CASE WHEN p_type = 'SMALL' AND p_brand NOT IN ('Brand#1', 'Brand#2') THEN {_BRAND} ELSE p_brand END AS p_brand,
  p_type, CASE WHEN p_type = 'ECONOMY' THEN p_size * 2 ELSE p_size END::INT AS p_size,
  CASE p_type WHEN 'ECONOMY' THEN least(greatest(p_retailprice, 950), 1000) WHEN 'SMALL' THEN greatest(p_retailprice, 1200) ELSE p_retailprice END::DOUBLE AS p_retailprice FROM part"""


def enforce_relationships(spark, d):
    df = load(spark, d, "orders")
    return kn.enforce_relationships(df, {"o_custkey": ["o_orderpriority", "o_orderstatus", "absent"]})


_MODE = """SELECT o_custkey, v FROM (SELECT o_custkey, {c} AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, {c}) AS k
  FROM {t} GROUP BY 1, 2) WHERE k = 1"""
RELATION_SQL = f"""
SELECT o_orderkey, o.o_custkey, b.v AS o_orderstatus, o_totalprice, o_orderdate, a.v AS o_orderpriority FROM orders o
JOIN ({_MODE.format(c='o_orderpriority', t='orders')}) a USING (o_custkey) JOIN ({_MODE.format(c='o_orderstatus', t='orders')}) b USING (o_custkey)"""


def constrained_column(spark, d):
    know = kn.Knowledge.from_dict({"constraints": {"c_acctbal": [
        {"type": "range", "parameters": {"min": 0, "max": 5000}},
        {"type": "precision", "parameters": {"decimal_places": 1}}]}})
    out = kn.constrained_column(load(spark, d, "customer"), know, "c_acctbal", "c_custkey")
    return kn.constrained_column(out, know, "c_limit", "c_custkey").select("c_custkey", "c_acctbal", "c_limit")


COLUMN_SQL = """
SELECT c_custkey, round(least(greatest(c_acctbal, 0), 5000), 1)::DOUBLE AS c_acctbal, NULL::DOUBLE AS c_limit FROM customer"""

RULES = [
    kn.Rule("discount_quantity", "l_quantity < 40", when="l_discount > 0.05"),
    kn.Rule("tax_range", "l_tax >= 0 AND l_tax <= 0.08"),
    kn.Rule("returned_before", "l_shipdate < DATE '1999-01-01'", when="l_returnflag = 'R'", level="warning"),
]


def check_rules(spark, d):
    return rounded(kn.check_rules(load(spark, d, "lineitem"), RULES), compliance_rate=6)


def _rules_sql(source: str) -> str:
    return union_all([f"""
SELECT '{r.rule_id}' AS rule_id, '{r.level}' AS level, count(*) AS rows, count(*) FILTER (WHERE ({r.when or 'TRUE'}) AND NOT ({r.condition})) AS violations,
  round(1 - count(*) FILTER (WHERE ({r.when or 'TRUE'}) AND NOT ({r.condition})) / count(*), 6) AS compliance_rate,
  count(*) FILTER (WHERE ({r.when or 'TRUE'}) AND NOT ({r.condition})) = 0 AS passed FROM {source}""" for r in RULES])


KNOWLEDGE = kn.Knowledge("orders", CONSTRAINTS, {"o_custkey": ["o_orderpriority"]},
                         [kn.Rule("cheap_open", "o_totalprice < 250000", when="o_orderstatus = 'O'")])


def enhance(spark, d):
    return kn.enhance(load(spark, d, "orders"), KNOWLEDGE, "o_orderkey")[0]


ENHANCE_SQL = f"""
SELECT o_orderkey, o.o_custkey, o_orderstatus, o_totalprice, o_orderdate, a.v AS o_orderpriority FROM ({_FIXED}) o
JOIN ({_MODE.format(c='o_orderpriority', t='orders')}) a USING (o_custkey)"""


def enhance_report(spark, d):
    return kn.enhance(load(spark, d, "orders"), KNOWLEDGE, "o_orderkey")[1]


ENHANCE_REPORT_SQL = f"""
SELECT "column" || ':' || "constraint" AS item, 'constraint' AS kind, violations FROM ({CONSTRAINT_REPORT})
UNION ALL SELECT 'cheap_open', 'rule', count(*) FILTER (WHERE o_orderstatus = 'O' AND NOT o_totalprice < 250000) FROM ({_FIXED})"""


def term_examples(spark, d):
    """Terms seen in the data, drawn without replacement."""
    terms = load(spark, d, "part").select(F.lit("product_name").alias("key"), F.col("p_name").alias("term")).unionByName(
        load(spark, d, "part").select(F.lit("brand").alias("key"), F.col("p_brand").alias("term"))
    ).distinct()
    return kn.term_examples(terms, "name", 10, SEED)


TERMS_SQL = """
SELECT key, term FROM (SELECT DISTINCT 'product_name' AS key, p_name AS term FROM part) ORDER BY md5('42|' || key || '|' || term), key, term LIMIT 10"""


def check_balance(spark, d):
    """Order totals against the sum of their line items."""
    total = load(spark, d, "orders").selectExpr("o_orderkey", "CAST(round(o_totalprice * 100) AS BIGINT) AS owed", "0L AS billed")
    lines = load(spark, d, "lineitem").selectExpr("l_orderkey AS o_orderkey", "0L AS owed",
                                                  "CAST(round(l_extendedprice * 100) AS BIGINT) AS billed")
    out = kn.check_balance(total.unionByName(lines), ["o_orderkey"], "sum(owed) / 100", "sum(billed) / 100", tolerance=150_000.0)
    return rounded(out, left_value=2, right_value=2)


BALANCE_SQL = """
SELECT o_orderkey, round(l, 2)::DOUBLE AS left_value, round(r, 2)::DOUBLE AS right_value, abs(l - r) <= 150000 AS passed FROM (
 SELECT o_orderkey, sum(owed) / 100.0 AS l, sum(billed) / 100.0 AS r FROM (
  SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS owed, 0 AS billed FROM orders
  UNION ALL SELECT l_orderkey, 0, CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem) GROUP BY o_orderkey)"""

BANDS = [kn.Band("low", 0, 100, 0.16), kn.Band("mid", 101, 500, 0.54), kn.Band("high", 501, 900, 0.30)]


def draw_from_bands(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    label, value = kn.draw_from_bands(BANDS, F.col("row_id"), SEED, "score", whole=True)
    return rows.select("row_id", label.alias("label"), value.alias("score"))


_T = f"floor({u_sql(SEED, 'score', 'row_id', 0)} * 1000000)"
_B = u_sql(SEED, "score", "row_id", 1)
BAND_SQL = f"""
SELECT row_id, CASE WHEN {_T} < 160000 THEN 'low' WHEN {_T} < 700000 THEN 'mid' ELSE 'high' END AS label,
  CASE WHEN {_T} < 160000 THEN {between_sql(_B, 0, 100)} WHEN {_T} < 700000 THEN {between_sql(_B, 101, 500)} ELSE {between_sql(_B, 501, 900)} END AS score
FROM (SELECT o_orderkey AS row_id FROM orders)"""


def band_shares(spark, d):
    bands = [kn.Band("small", 0, 10, 0.25), kn.Band("middle", 11, 40, 0.5), kn.Band("large", 41, 50, 0.25)]
    return rounded(kn.band_shares(load(spark, d, "lineitem"), "l_quantity", bands), observed=6, gap=6)


SHARES_SQL = union_all([f"""
SELECT '{n}' AS label, {s}::DOUBLE AS expected, round(count(*) FILTER (WHERE l_quantity BETWEEN {a} AND {b}) / count(*), 6) AS observed,
  round(abs(count(*) FILTER (WHERE l_quantity BETWEEN {a} AND {b}) / count(*) - {s}), 6) AS gap FROM lineitem"""
    for n, a, b, s in [("small", 0, 10, 0.25), ("middle", 11, 40, 0.5), ("large", 41, 50, 0.25)]])


def anonymize(spark, d):
    df = load(spark, d, "customer").selectExpr(
        "c_custkey", "CAST(c_custkey % 110 AS INT) AS age", "DATE '1950-01-01' + CAST(c_custkey AS INT) AS born",
        "lpad(c_custkey || '', 5, '0') AS zip", "'NATION_' || c_nationkey AS city",
    )
    nations, regions = load(spark, d, "nation"), load(spark, d, "region")
    table = nations.join(regions, nations.n_regionkey == regions.r_regionkey).select(
        F.col("n_name").alias("place"), F.col("r_name").alias("region")
    )
    return kn.anonymize(df, ["age"], ["born"], ["zip"], {"city": table})


ANONYMIZE_SQL = """
SELECT c_custkey, least(c_custkey % 110, 90)::INT AS age, year(DATE '1950-01-01' + c_custkey::INT)::INT AS born,
  substr(lpad(c_custkey || '', 5, '0'), 1, 3) AS zip, r_name AS city
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""


def check_completeness(spark, d):
    df = load(spark, d, "orders").selectExpr(
        "o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice"
    )
    groups = {"keys": (["o_orderkey", "o_custkey"], 0.99), "amounts": (["o_orderkey", "o_totalprice"], 0.98)}
    return rounded(kn.check_completeness(df, groups), completeness=6)


COMPLETE_SQL = """
SELECT 'keys' AS field_group, 1.0::DOUBLE AS completeness, 0.99::DOUBLE AS threshold, count(*) > 0 AS passed FROM orders
UNION ALL SELECT 'amounts', round(c, 6), 0.98, c >= 0.98 FROM (SELECT (count(*) + count(CASE WHEN o_orderkey % 10 <> 0 THEN 1 END)) / (2 * count(*)) AS c FROM orders)"""

SEASONS = [((11, 12), ("1-URGENT", "2-HIGH"), 2.5), ((6, 7, 8), ("5-LOW",), 1.3), ((12,), ("2-HIGH",), 1.1)]


def seasonal_amounts(spark, d):
    out = kn.seasonal_amounts(load(spark, d, "orders"), "o_totalprice", "o_orderdate", "o_orderpriority", SEASONS)
    return rounded(out.select("o_orderkey", "seasonal_amount"), seasonal_amount=6)


SEASON_SQL = """
SELECT o_orderkey, round(o_totalprice * CASE WHEN month(o_orderdate) IN (11, 12) AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2.5 ELSE 1.0 END::DOUBLE
  * CASE WHEN month(o_orderdate) IN (6, 7, 8) AND o_orderpriority = '5-LOW' THEN 1.3 ELSE 1.0 END::DOUBLE
  * CASE WHEN month(o_orderdate) = 12 AND o_orderpriority = '2-HIGH' THEN 1.1 ELSE 1.0 END::DOUBLE, 6)::DOUBLE AS seasonal_amount FROM orders"""


def acceptance_gate(spark, d):
    df = load(spark, d, "customer").select("c_acctbal", "c_mktsegment", "c_name")
    return rounded(kn.acceptance_gate(df, limits={"min_avg_length": 9.0}), value=4)


GATE_SQL = """
SELECT 'c_acctbal' AS "column", 'variance' AS "check", round(var_samp(c_acctbal), 4) AS value, 1e-9::DOUBLE AS "limit", var_samp(c_acctbal) >= 1e-9 AS passed FROM customer
UNION ALL SELECT 'c_mktsegment', 'avg_length', round(avg(length(c_mktsegment)), 4), 9.0, avg(length(c_mktsegment)) >= 9 FROM customer
UNION ALL SELECT 'c_name', 'avg_length', round(avg(length(c_name)), 4), 9.0, avg(length(c_name)) >= 9 FROM customer""" + "".join(f"""
UNION ALL SELECT '{c}', 'min_unique_ratio', round(count(DISTINCT {c}) / count(*), 4), 0.001, count(DISTINCT {c}) / count(*) >= 0.001 FROM customer
UNION ALL SELECT '{c}', 'max_unique_ratio', round(count(DISTINCT {c}) / count(*), 4), 0.999, count(DISTINCT {c}) / count(*) <= 0.999 FROM customer"""
    for c in ("c_acctbal", "c_mktsegment", "c_name"))


def noisy_balances(spark, d):
    out = risk.add_noise(load(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 25.0, "c_custkey")
    return rounded(out, c_acctbal=4)


NOISE_SQL = f"""
SELECT c_custkey, round(c_acctbal + ({u_sql(42, 'c_acctbal', 'c_custkey', 0)} * 2 - 1) * 25.0, 4)::DOUBLE AS c_acctbal FROM customer"""

QUERIES = {
    "enforce_constraints": (enforce_constraints, _FIXED),
    "constraint_report": (constraint_report, CONSTRAINT_REPORT),
    "pattern_null_out": (pattern_null_out, "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN url END AS url FROM pages"),
    "dependency_constraint": (dependency_constraint, DEPENDENCY_SQL),
    "enforce_relationships": (enforce_relationships, RELATION_SQL),
    "constrained_column": (constrained_column, COLUMN_SQL),
    "check_rules": (check_rules, _rules_sql("lineitem")),
    "enhance": (enhance, ENHANCE_SQL),
    "enhance_report": (enhance_report, ENHANCE_REPORT_SQL),
    "term_examples": (term_examples, TERMS_SQL),
    "check_balance": (check_balance, BALANCE_SQL),
    "draw_from_bands": (draw_from_bands, BAND_SQL),
    "band_shares": (band_shares, SHARES_SQL),
    "anonymize": (anonymize, ANONYMIZE_SQL),
    "check_completeness": (check_completeness, COMPLETE_SQL),
    "seasonal_amounts": (seasonal_amounts, SEASON_SQL),
    "acceptance_gate": (acceptance_gate, GATE_SQL),
    "noisy_balances": (noisy_balances, NOISE_SQL),
}
