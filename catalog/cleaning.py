"""Missing values, outliers, redaction, text normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import load
from twintable.plans import clean

GAPS = {
    "o_totalprice": "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END",
    "o_orderstatus": "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END",
}
GAP_SQL = f"""SELECT o_orderkey, o_custkey, {GAPS['o_totalprice']} AS o_totalprice,
  {GAPS['o_orderstatus']} AS o_orderstatus FROM orders"""


def _with_gaps(spark, d):
    return load(spark, d, "orders").selectExpr(
        "o_orderkey", "o_custkey", *[f"{e} AS {c}" for c, e in GAPS.items()]
    )


def drop_missing(spark, d):
    return clean.handle_missing_values(_with_gaps(spark, d), "drop", columns=list(GAPS))


def fill_constant(spark, d):
    df = clean.handle_missing_values(
        _with_gaps(spark, d), "fill", fill_value=0, columns=["o_totalprice"]
    )
    return clean.handle_missing_values(df, "fill", fill_value="?", columns=["o_orderstatus"])


def fill_forward(spark, d):
    return clean.handle_missing_values(
        _with_gaps(spark, d), "forward", columns=list(GAPS), order_by=["o_orderkey"]
    )


def fill_backward(spark, d):
    return clean.handle_missing_values(
        _with_gaps(spark, d), "backward", columns=list(GAPS), order_by=["o_orderkey"]
    )


def fill_forward_by_customer(spark, d):
    return clean.handle_missing_values(
        _with_gaps(spark, d), "forward", columns=list(GAPS), order_by=["o_orderkey"],
        partition_by=["o_custkey"],
    )


def _fill_sql(function: str, span: str, by: str = "") -> str:
    over = f"OVER ({by} ORDER BY o_orderkey ROWS BETWEEN {span})"
    return f"""SELECT o_orderkey, o_custkey,
  {function}(o_totalprice IGNORE NULLS) {over} AS o_totalprice,
  {function}(o_orderstatus IGNORE NULLS) {over} AS o_orderstatus FROM ({GAP_SQL})"""


def remove_outliers_iqr(spark, d):
    df = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"
    )
    tight = clean.remove_outliers(df, ["l_extendedprice", "l_quantity"], "iqr", 0.3)
    return tight.groupBy("l_linenumber").agg(
        F.count("*").alias("kept"), F.min("l_extendedprice").alias("lo"),
        F.max("l_extendedprice").alias("hi"), F.sum("l_quantity").alias("quantity"),
    )


OUTLIER_IQR_SQL = """
WITH q1 AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem),
s1 AS (SELECT l.* FROM lineitem l, q1 WHERE l_extendedprice >= a - 0.3 * (b - a) AND l_extendedprice <= b + 0.3 * (b - a)),
q2 AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM s1),
s2 AS (SELECT s1.* FROM s1, q2 WHERE l_quantity >= a - 0.3 * (b - a) AND l_quantity <= b + 0.3 * (b - a))
SELECT l_linenumber, count(*) AS kept, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
  sum(l_quantity) AS quantity FROM s2 GROUP BY 1"""


def remove_outliers_zscore(spark, d):
    df = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").withColumn(
        "l_extendedprice", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_extendedprice"))
    )
    return clean.remove_outliers(df, ["l_extendedprice"], "zscore", 1.2)


OUTLIER_Z_SQL = """
WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice END AS l_extendedprice FROM lineitem),
m AS (SELECT avg(l_extendedprice) AS a, stddev_pop(l_extendedprice) AS s FROM s)
SELECT s.* FROM s, m WHERE l_extendedprice IS NULL OR abs(l_extendedprice - m.a) / m.s < 1.2"""


def remove_pii(spark, d):
    return clean.remove_pii(load(spark, d, "customer"), ["c_name", "c_acctbal", "not_there"])


def normalize_text(spark, d):
    return clean.normalize_column(
        load(spark, d, "documents").select("doc_id", "text"), "text", remove_punctuation=True
    )


NORMALIZE_SQL = r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text),
  '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents"""


def validate_data_types(spark, d):
    """Type expectations checked on the table's schema, with the rows each column holds."""
    df = load(spark, d, "orders")
    errors = clean.validate_data_types(
        df, {"o_orderkey": "int", "o_totalprice": "string", "o_orderdate": "datetime",
             "o_custkey": "float", "o_comment": "string"},
    )
    return errors.withColumn("rows_checked", F.lit(df.count()))


TYPES_SQL = """
SELECT c AS "column", e AS expected, a AS actual,
  CASE WHEN a IS NULL THEN 'Missing column: ' || c ELSE 'Column ' || c || ': expected ' || e || ', got ' || a END AS error,
  (SELECT count(*) FROM orders) AS rows_checked
FROM (VALUES ('o_totalprice', 'string', 'double'), ('o_custkey', 'float', 'bigint'),
             ('o_comment', 'string', NULL)) t(c, e, a)"""

QUERIES = {
    "drop_missing": (drop_missing, f"SELECT * FROM ({GAP_SQL}) WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL"),
    "fill_constant": (fill_constant, f"SELECT o_orderkey, o_custkey, coalesce(o_totalprice, 0)::DOUBLE AS o_totalprice, coalesce(o_orderstatus, '?') AS o_orderstatus FROM ({GAP_SQL})"),
    "fill_forward": (fill_forward, _fill_sql("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW")),
    "fill_backward": (fill_backward, _fill_sql("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")),
    "fill_forward_by_customer": (fill_forward_by_customer, _fill_sql("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW", "PARTITION BY o_custkey")),
    "remove_outliers_iqr": (remove_outliers_iqr, OUTLIER_IQR_SQL),
    "remove_outliers_zscore": (remove_outliers_zscore, OUTLIER_Z_SQL),
    "remove_pii": (remove_pii, "SELECT c_custkey, '[REDACTED]' AS c_name, c_nationkey, '[REDACTED]' AS c_acctbal, c_mktsegment FROM customer"),
    "normalize_text": (normalize_text, NORMALIZE_SQL),
    "validate_data_types": (validate_data_types, TYPES_SQL),
}
