"""Column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import load, rounded, union_all
from twintable.operators import frequency
from twintable.plans import profile

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _numeric_sql(table: str, columns: list[str], source: str | None = None) -> str:
    parts = []
    for c in columns:
        parts.append(f"""
SELECT '{c}' AS "column", count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
  round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(var_samp({c}), 1) AS variance, round(skewness({c}), 6) AS skewness,
  round(kurtosis({c}), 6) AS kurtosis, bool_and({c} % 1 = 0) AS is_integer,
  bool_and({c} > 0) AS is_positive,
  (SELECT count(*) FROM {table}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a,
     quantile_cont({c}::DOUBLE, 0.75) AS b FROM {table}) q
   WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outlier_count,
  round(median({c}), 6) AS median,
  round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.50), 6) AS q50,
  round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, round(quantile_cont({c}::DOUBLE, 0.95), 6) AS q95,
  round(quantile_cont({c}::DOUBLE, 0.99), 6) AS q99
FROM {table}""")
    inner = union_all(parts)
    return f"SELECT *, outlier_count > 0 AS has_outliers FROM ({inner})"


_NUMERIC_DIGITS = dict(mean=4, std=4, variance=1, skewness=6, kurtosis=6, median=6,
                       q25=6, q50=6, q75=6, q95=6, q99=6)


def profile_numeric(spark, d):
    return rounded(profile.profile_numeric(load(spark, d, "lineitem"), LINE_NUMBERS),
                   **_NUMERIC_DIGITS)


def profile_numeric_narrowed(spark, d):
    """The same profile when distinct values exceed what one task may hold."""
    df = load(spark, d, "orders")
    return rounded(profile.profile_numeric(df, ["o_totalprice"], distinct_limit=500),
                   **_NUMERIC_DIGITS)


def profile_numeric_account(spark, d):
    return rounded(profile.profile_numeric(load(spark, d, "customer"), ["c_acctbal"]),
                   **_NUMERIC_DIGITS)


TEXT_COLUMNS = ["text", "lang", "source"]


def _text_sql(table: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(f"""
SELECT '{c}' AS "column", count({c}) AS n, min(length({c}))::INT AS min_length,
  max(length({c}))::INT AS max_length, round(avg(length({c})), 6) AS avg_length,
  round(median(length({c})), 6) AS median_length,
  round(sum(len(regexp_extract_all({c}, '[A-Z]'))) / sum(length({c})), 6) AS uppercase_ratio,
  round(sum(len(regexp_extract_all({c}, '[a-z]'))) / sum(length({c})), 6) AS lowercase_ratio,
  round(sum(len(regexp_extract_all({c}, '[0-9]'))) / sum(length({c})), 6) AS numeric_ratio,
  round(sum(len(regexp_extract_all({c}, '[^a-zA-Z0-9\\s]'))) / sum(length({c})), 6) AS special_char_ratio,
  (SELECT round(CASE WHEN max(k) > 1 THEN max(k) / sum(k) ELSE 0 END, 6) FROM (
     SELECT count(*) AS k FROM {table} WHERE {c} IS NOT NULL GROUP BY {_shape_sql(c)})) AS top_share
FROM {table}""")
    return f"SELECT *, top_share >= 0.8 AS has_consistent_format FROM ({union_all(parts)})"


def _shape_sql(c: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace({c}, '[a-z]', 'a', 'g'), "
            f"'[A-Z]', 'A', 'g'), '[0-9]', '9', 'g')")


def profile_text(spark, d):
    out = profile.profile_text(load(spark, d, "documents"), TEXT_COLUMNS)
    return rounded(out, avg_length=6, median_length=6, uppercase_ratio=6, lowercase_ratio=6,
                   numeric_ratio=6, special_char_ratio=6, top_share=6)


def common_shapes(spark, d):
    return profile.common_shapes(load(spark, d, "pages"), ["url", "html"]).unionByName(
        profile.common_shapes(load(spark, d, "part"), ["p_name", "p_brand", "p_type"])
    )


_SHAPE_PARTS = [("pages", "url"), ("pages", "html"), ("part", "p_name"), ("part", "p_brand"),
                ("part", "p_type")]
COMMON_SHAPES_SQL = union_all([f"""
SELECT '{c}' AS "column", rank::INT AS rank, shape, n FROM (
  SELECT shape, n, row_number() OVER (ORDER BY n DESC, shape) AS rank
  FROM (SELECT {_shape_sql(c)} AS shape, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)
) WHERE rank <= 5 AND n > 1""" for t, c in _SHAPE_PARTS])


def format_consistency(spark, d):
    out = profile.format_consistency(load(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])
    return rounded(
        out.unionByName(profile.format_consistency(load(spark, d, "customer"), ["c_name"])),
        top_share=6,
    )


FORMAT_SQL = union_all([f"""
SELECT '{c}' AS "column", round(CASE WHEN max(k) > 1 THEN max(k) / sum(k) ELSE 0 END, 6) AS top_share,
  CASE WHEN max(k) > 1 THEN max(k) / sum(k) ELSE 0 END >= 0.8 AS has_consistent_format
FROM (SELECT count(*) AS k FROM {t} WHERE {c} IS NOT NULL GROUP BY {_shape_sql(c)})"""
    for t, c in [("orders", "o_orderpriority"), ("orders", "o_orderstatus"), ("customer", "c_name")]])

CATEGORY_COLUMNS = ["o_orderstatus", "o_orderpriority", "o_custkey"]


def profile_categorical(spark, d):
    return rounded(profile.profile_categorical(load(spark, d, "orders"), CATEGORY_COLUMNS),
                   cardinality_ratio=6)


CATEGORICAL_SQL = union_all([f"""
SELECT '{c}' AS "column", sum(n)::BIGINT AS n_values, count(*) AS n_distinct,
  round(count(*) / sum(n), 6) AS cardinality_ratio,
  (count(*) / sum(n) < 0.05 OR count(*) < 50) AS is_categorical, max(n) AS top_count
FROM (SELECT {c}, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1)"""
    for c in CATEGORY_COLUMNS])


def value_frequencies(spark, d):
    return frequency.value_frequencies(
        load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"]
    )


FREQUENCY_SQL = union_all([f"""
SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS n FROM lineitem
WHERE {c} IS NOT NULL GROUP BY 2"""
    for c in ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"]])


def top_values(spark, d):
    freq = frequency.value_frequencies(load(spark, d, "lineitem"), ["l_suppkey", "l_quantity"])
    return frequency.top_values(freq, 10)


TOP_SQL = union_all([f"""
SELECT '{c}' AS "column", rank::INT AS rank, value, n FROM (
  SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank
  FROM (SELECT {c}::VARCHAR AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1))
WHERE rank <= 10""" for c in ["l_suppkey", "l_quantity"]])


def profile_temporal(spark, d):
    orders = profile.profile_temporal(load(spark, d, "orders"))
    lines = profile.profile_temporal(load(spark, d, "lineitem"), ["l_shipdate"])
    texts = profile.profile_temporal(
        load(spark, d, "events").select(
            F.date_format("ts", "dd/MM/yyyy").alias("day_text"), "event_type"
        )
    )
    return orders.unionByName(lines).unionByName(texts)


TEMPORAL_SQL = union_all([f"""
SELECT '{c}' AS "column", min({c})::TIMESTAMP AS min_date, max({c})::TIMESTAMP AS max_date,
  floor(epoch(max({c}) - min({c})) / 86400)::BIGINT AS date_range_days,
  '%Y-%m-%d %H:%M:%S' AS date_format FROM {t}"""
    for t, c in [("orders", "o_orderdate"), ("lineitem", "l_shipdate")]] + ["""
SELECT 'day_text' AS "column", min(date_trunc('day', ts)) AS min_date,
  max(date_trunc('day', ts)) AS max_date,
  date_diff('day', min(ts::DATE), max(ts::DATE)) AS date_range_days,
  '%d/%m/%Y' AS date_format FROM events"""])


def sample_rows(spark, d):
    return profile.sample_rows(load(spark, d, "orders"), ["o_orderkey"], 100, seed=42)


SAMPLE_SQL = """
SELECT * FROM orders ORDER BY md5('42|' || o_orderkey::VARCHAR), o_orderkey LIMIT 100"""

TABLE_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def analyze_table(spark, d):
    out = profile.analyze_table(load(spark, d, "orders"), TABLE_COLUMNS)
    return rounded(out, completeness=6, uniqueness=6, consistency=6)


def _analyze_sql(spec: list[tuple[str, str, str]]) -> str:
    """(column, physical kind, table); numbers are cast to text like the profile does."""
    parts = []
    for c, kind, t in spec:
        text = f"{c}::VARCHAR"
        numeric = kind == "number"
        dated = kind == "date"
        parts.append(f"""
SELECT '{c}' AS "column", {str(numeric).upper()} AS is_number, {str(dated).upper()} AS is_date,
  count(*) AS total_count, count({c}) AS n, count(DISTINCT {c}) AS n_distinct,
  (SELECT max(k) FROM (SELECT count(*) AS k FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})) AS top_count,
  avg(length({text})) AS avg_len, coalesce(stddev_samp(length({text})), 0) AS std_len,
  avg(CASE WHEN {text} LIKE '% %' THEN 1.0 ELSE 0 END) AS spaces,
  avg(CASE WHEN regexp_matches({text}, '[a-z]') AND regexp_matches({text}, '[A-Z]') THEN 1.0 ELSE 0 END) AS mixed,
  avg(CASE WHEN regexp_matches({text}, '[0-9]{{1,4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,4}}') THEN 1.0 ELSE 0 END) AS date_like,
  (SELECT CASE WHEN max(k) > 1 THEN max(k) / sum(k) ELSE 0 END FROM (
     SELECT count(*) AS k FROM {t} GROUP BY {_shape_sql(text)})) AS top_share
FROM {t}""")
    return f"""
WITH s AS ({union_all(parts)}),
scores AS (SELECT *,
  CASE WHEN is_number THEN 0.9 ELSE 0 END AS numeric_score,
  round((CASE WHEN n_distinct / n < 0.01 THEN 0.4 WHEN n_distinct / n < 0.05 THEN 0.3
         WHEN n_distinct / n < 0.1 THEN 0.2 ELSE 0 END)
   + (CASE WHEN n_distinct < 10 THEN 0.2 WHEN n_distinct < 50 THEN 0.1 ELSE 0 END)
   + (CASE WHEN top_count / n > 0.3 THEN 0.1 ELSE 0 END), 6) AS categorical_score,
  round((CASE WHEN avg_len > 20 THEN 0.3 ELSE 0 END) + (CASE WHEN std_len > 10 THEN 0.2 ELSE 0 END)
   + (CASE WHEN spaces > 0.5 THEN 0.2 ELSE 0 END) + (CASE WHEN mixed > 0.3 THEN 0.1 ELSE 0 END), 6) AS text_score,
  CASE WHEN is_date THEN 0.5 ELSE 0 END + CASE WHEN NOT is_number AND date_like > 0.7 THEN 0.2 ELSE 0 END AS temporal_score
  FROM s),
best AS (SELECT *, greatest(numeric_score, categorical_score, text_score, temporal_score) AS top FROM scores),
typed AS (SELECT *,
  CASE WHEN top <= 0.3 THEN 'text' WHEN numeric_score = top THEN 'numeric'
   WHEN categorical_score = top THEN 'categorical' WHEN text_score = top THEN 'text'
   ELSE 'temporal' END AS inferred_type,
  CASE WHEN top <= 0.3 THEN 0.2 ELSE top END::DOUBLE AS type_confidence FROM best),
done AS (SELECT *, inferred_type IN ('text', 'categorical') AND top_share >= 0.8 AS consistent FROM typed)
SELECT "column", total_count, total_count - n AS null_count, n_distinct AS unique_count,
  total_count - n_distinct AS duplicate_count, round(n / total_count, 6) AS completeness,
  round(n_distinct / total_count, 6) AS uniqueness, inferred_type, type_confidence,
  NULL::VARCHAR AS pii_type, FALSE AS contains_pii, consistent AS has_consistent_format,
  round((n / total_count + type_confidence + CASE WHEN consistent THEN 0.9 ELSE 0 END
   + CASE WHEN (1 - n / total_count) * 100 < 5 THEN 0.9 ELSE 0 END)
   / (2 + CASE WHEN consistent THEN 1 ELSE 0 END
   + CASE WHEN (1 - n / total_count) * 100 < 5 THEN 1 ELSE 0 END), 6) AS consistency
FROM done"""


ANALYZE_SQL = _analyze_sql([
    ("o_orderkey", "number", "orders"), ("o_orderstatus", "text", "orders"),
    ("o_totalprice", "number", "orders"), ("o_orderdate", "date", "orders"),
    ("o_orderpriority", "text", "orders"),
])

QUERIES = {
    "profile_numeric": (profile_numeric, _numeric_sql("lineitem", LINE_NUMBERS)),
    "profile_numeric_narrowed": (profile_numeric_narrowed, _numeric_sql("orders", ["o_totalprice"])),
    "profile_numeric_account": (profile_numeric_account, _numeric_sql("customer", ["c_acctbal"])),
    "profile_text": (profile_text, _text_sql("documents", TEXT_COLUMNS)),
    "common_shapes": (common_shapes, COMMON_SHAPES_SQL),
    "format_consistency": (format_consistency, FORMAT_SQL),
    "profile_categorical": (profile_categorical, CATEGORICAL_SQL),
    "value_frequencies": (value_frequencies, FREQUENCY_SQL),
    "top_values": (top_values, TOP_SQL),
    "profile_temporal": (profile_temporal, TEMPORAL_SQL),
    "sample_rows": (sample_rows, SAMPLE_SQL),
    "analyze_table": (analyze_table, ANALYZE_SQL),
}
