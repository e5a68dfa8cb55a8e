"""Aggregates, windows in effect, set operations and lookup joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.common import load, rounded, union_all
from twintable.functions import dates, text
from twintable.functions import numbers as num
from twintable.operators import aggregates, ecdf, frequency, quantiles, sets
from twintable.plans import fabricate
from twintable.plans.fabricate import lookups

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def null_counts(spark, d):
    df = load(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice",
        "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS o_orderpriority",
    )
    return rounded(aggregates.null_counts(df), completeness=6)


NULL_SQL = union_all([f"""
SELECT '{c}' AS "column", count(*) AS total_count, count(*) - count({e}) AS null_count,
  round(count({e}) / count(*), 6) AS completeness FROM orders"""
    for c, e in [("o_orderkey", "o_orderkey"),
                 ("o_totalprice", "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END"),
                 ("o_orderpriority", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END")]])


def distinct_counts(spark, d):
    out = frequency.frequency_summary(
        frequency.value_frequencies(load(spark, d, "lineitem"),
                                    ["l_suppkey", "l_returnflag", "l_shipdate", "l_extendedprice"], keys=True)
    )
    return out.withColumn("duplicates", F.col("n_values") - F.col("n_distinct"))


DISTINCT_SQL = union_all([f"""
SELECT '{c}' AS "column", sum(n)::BIGINT AS n_values, count(*) AS n_distinct, max(n) AS top_count,
  (sum(n) - count(*))::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})"""
    for c in ["l_suppkey", "l_returnflag", "l_shipdate", "l_extendedprice"]])


def frame_totals(spark, d):
    df = load(spark, d, "events").selectExpr(
        "event_id", "ts", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value",
        "CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS event_type",
    )
    return aggregates.frame_totals(df)


TOTALS_SQL = """
SELECT count(*) AS total_rows, 4::BIGINT AS total_columns,
  (count(*) FILTER (WHERE event_id % 4 = 0) + count(*) FILTER (WHERE event_type = 'view'))::BIGINT AS missing_cells FROM events"""


def moments(spark, d):
    out = aggregates.moments(load(spark, d, "lineitem"), LINE)
    return rounded(out, mean=4, std=4, variance=1, skewness=6, kurtosis=6)


MOMENTS_SQL = union_all([f"""
SELECT '{c}' AS "column", count({c}) AS n, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, round(var_samp({c}), 1) AS variance, round(skewness({c}), 6) AS skewness,
  round(kurtosis({c}), 6) AS kurtosis, bool_and({c} % 1 = 0) AS is_integer, bool_and({c} > 0) AS is_positive
FROM lineitem""" for c in LINE])

PROBS = [0.25, 0.5, 0.75, 0.95, 0.99]


def quantile_table(spark, d):
    return rounded(quantiles.quantile_table(load(spark, d, "lineitem"), LINE, PROBS), value=6)


QUANTILE_SQL = union_all([f"""
SELECT '{c}' AS "column", {p}::DOUBLE AS prob, round(quantile_cont({c}, {p}), 6) AS value FROM lineitem"""
    for c in LINE for p in PROBS])


def quantile_table_narrowed(spark, d):
    out = quantiles.quantile_table(load(spark, d, "lineitem"), LINE, PROBS, distinct_limit=200)
    return rounded(out, value=6)


def approx_quantiles(spark, d):
    """The sketch answer, scored by the rank it hits: always within a fraction of a per cent."""
    df = load(spark, d, "lineitem").select("l_extendedprice")
    table = quantiles.approx_quantile_table(df, ["l_extendedprice"], PROBS).collect()
    hit = df.agg(*[F.avg((F.col("l_extendedprice") <= r["value"]).cast("double")).alias(f"h{i}")
                   for i, r in enumerate(table)])
    structs = [
        F.struct(F.lit(r["prob"]).alias("prob"),
                 (F.abs(F.col(f"h{i}") - F.lit(r["prob"])) < 0.002).alias("close"))
        for i, r in enumerate(table)
    ]
    return hit.select(F.inline(F.array(*structs)))


APPROX_SQL = union_all([f"SELECT {p}::DOUBLE AS prob, count(*) > 0 AS close FROM lineitem" for p in PROBS])


def correlation_matrix(spark, d):
    df = load(spark, d, "lineitem").withColumn(
        "l_tax", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_tax"))
    )
    return rounded(aggregates.correlation_pairs(df, LINE), corr=6)


_TAX = "(SELECT *, CASE WHEN l_orderkey % 9 <> 0 THEN l_tax END AS tax FROM lineitem)"
CORR_SQL = union_all([f"""
SELECT '{a}' AS column_a, '{b}' AS column_b,
  round(corr({a.replace('l_tax', 'tax')}, {b.replace('l_tax', 'tax')}), 6) AS corr FROM {_TAX}"""
    for a in LINE for b in LINE])


def group_sizes(spark, d):
    df = load(spark, d, "customer").withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 13 != 0, F.col("c_mktsegment"))
    )
    return frequency.group_sizes(df, ["c_nationkey", "c_mktsegment"])


GROUP_SQL = """
SELECT c_nationkey, c_mktsegment, count(*) AS group_size FROM customer
WHERE c_custkey % 13 <> 0 GROUP BY 1, 2"""


def group_size_summary(spark, d):
    from twintable.plans import risk

    return risk.group_summary(load(spark, d, "part"), ["p_brand", "p_type", "p_size"])


GROUP_SUMMARY_SQL = """
SELECT count(*) AS total_groups, min(n) AS min_group_size, count(*) FILTER (WHERE n < 5) AS groups_below_k,
  count(*) FILTER (WHERE n = 1) AS unique_groups, count(*) FILTER (WHERE n <= 3) AS rare_groups
FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type, p_size)"""

ENTROPY = ["o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice"]


def entropy(spark, d):
    freq = frequency.value_frequencies(load(spark, d, "orders"), ENTROPY, keys=True)
    return rounded(frequency.normalized_entropy(freq), entropy_bits=6, entropy=6)


ENTROPY_SQL = union_all([f"""
SELECT '{c}' AS "column", sum(n)::BIGINT AS n_values, count(*) AS n_distinct,
  round(-sum(n / t * log2(n / t + 1e-12)), 6) AS entropy_bits,
  round(-sum(n / t * log2(n / t + 1e-12)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1 END, 6) AS entropy
FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY {c})""" for c in ENTROPY])


def mode_of_column(spark, d):
    return aggregates.deterministic_mode(load(spark, d, "lineitem"), "l_shipdate")


def mode_by_group(spark, d):
    return aggregates.deterministic_mode(load(spark, d, "orders"), "o_orderstatus", ["o_orderpriority"])


def _mode_sql(table: str, c: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}{c} AS mode, n FROM (SELECT {lead}{c}, count(*) AS n,
  row_number() OVER ({part} ORDER BY count(*) DESC, {c}) AS k FROM {table} GROUP BY {lead}{c}) WHERE k = 1"""


def calendar_shares(spark, d):
    df = load(spark, d, "orders").select(
        F.inline(F.array(
            F.struct(F.lit("weekday").alias("part"), F.weekday("o_orderdate").alias("slot")),
            F.struct(F.lit("month").alias("part"), F.month("o_orderdate").alias("slot")),
        ))
    ).groupBy("part", "slot").agg(F.count("*").alias("n"))
    # nineteen rows by now
    share = F.col("n") / F.sum("n").over(Window.partitionBy("part"))
    return df.select("part", "slot", F.round(share, 6).alias("share"))


CALENDAR_SQL = """
SELECT 'weekday' AS part, (isodow(o_orderdate) - 1)::INT AS slot, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 2
UNION ALL SELECT 'month', month(o_orderdate)::INT, round(count(*) / (SELECT count(*) FROM orders), 6) FROM orders GROUP BY 2"""


def category_pairs(spark, d):
    return frequency.category_pairs(load(spark, d, "part"), "p_brand", "p_type")


def distinct_words(spark, d):
    words = sets.vocabulary(load(spark, d, "conversations"), "text", "role")
    return words.groupBy("role").agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))


WORDS_SQL = f"""
SELECT role, count(DISTINCT w) AS words, count(*) AS tokens FROM (
  SELECT role, unnest(regexp_extract_all(lower(text), '{text.TOKEN}')) AS w FROM conversations) GROUP BY 1"""


def shared_words(spark, d):
    v = sets.vocabulary(load(spark, d, "conversations"), "text", "role")
    sides = v.groupBy("token").agg(
        F.max((F.col("role") == "user").cast("int")).alias("u"),
        F.max((F.col("role") == "assistant").cast("int")).alias("a"),
    )
    return sides.agg(
        F.count_if((F.col("u") == 1) & (F.col("a") == 1)).alias("both"),
        F.count_if((F.col("u") == 1) | (F.col("a") == 1)).alias("either"),
    )


SHARED_SQL = f"""
WITH w AS (SELECT DISTINCT role, w FROM (SELECT role, unnest(regexp_extract_all(lower(text), '{text.TOKEN}')) AS w FROM conversations)),
u AS (SELECT w FROM w WHERE role = 'user'), a AS (SELECT w FROM w WHERE role = 'assistant')
SELECT (SELECT count(*) FROM (SELECT * FROM u INTERSECT SELECT * FROM a)) AS both,
  (SELECT count(*) FROM (SELECT * FROM u UNION SELECT * FROM a)) AS either"""


def shared_rows(spark, d):
    df = load(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_orderkey")
    return sets.shared_rows(
        df.filter("l_orderkey % 2 = 0"), df.filter("l_orderkey % 2 = 1"),
        ["l_suppkey", "l_linenumber", "l_returnflag"],
    )


SHARED_ROWS_SQL = """
SELECT l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey % 2 = 0
INTERSECT SELECT l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey % 2 = 1"""


def unexpected_categories(spark, d):
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    customers = load(spark, d, "customer").filter("c_nationkey <> 7").select("c_custkey")
    return sets.unexpected_values(orders, "c_custkey", customers)


UNEXPECTED_SQL = """
SELECT o_custkey AS c_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey <> 7"""

PLACES = {
    "c_custkey": "c_custkey",
    "country": "element_at(array('USA', ' uk', 'India', 'Canada ', 'Atlantis', 'great britain', 'Germany', 'Singapore'), 1 + cast(c_custkey % 8 AS INT))",
    "city": "element_at(array('London', 'Austin', 'Mumbai', 'Toronto', 'Pune', 'Leeds'), 1 + cast(c_custkey % 6 AS INT))",
}


def places(spark, d):
    return load(spark, d, "customer").selectExpr(*[f"{e} AS {c}" for c, e in PLACES.items()])


PLACES_SQL = """SELECT c_custkey,
  (['USA', ' uk', 'India', 'Canada ', 'Atlantis', 'great britain', 'Germany', 'Singapore'])[1 + c_custkey % 8] AS country,
  (['London', 'Austin', 'Mumbai', 'Toronto', 'Pune', 'Leeds'])[1 + c_custkey % 6] AS city FROM customer"""


def _values_sql(table: dict) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in table.items())
    return f"(VALUES {rows})"


def normalize_country(spark, d):
    return places(spark, d).withColumn("country_norm", lookups.normalize_country(F.col("country")))


COUNTRY_SQL = f"""
WITH p AS ({PLACES_SQL})
SELECT p.*, coalesce(a.v, trim(country)) AS country_norm
FROM p LEFT JOIN {_values_sql(lookups.COUNTRY_ALIASES)} a(k, v) ON a.k = lower(trim(country))"""


def place_locales(spark, d):
    return places(spark, d).select(
        "c_custkey", lookups.locale_of_country(F.col("country"), "en_US").alias("by_country"),
        lookups.locale_of_city(F.col("city"), "en_US").alias("by_city"),
    )


LOCALE_SQL = f"""
WITH p AS ({PLACES_SQL})
SELECT c_custkey, coalesce(a.v, 'en_US') AS by_country, coalesce(b.v, 'en_US') AS by_city FROM p
LEFT JOIN {_values_sql(lookups.COUNTRY_LOCALES)} a(k, v) ON a.k = lower(trim(country))
LEFT JOIN {_values_sql(lookups.CITY_LOCALES)} b(k, v) ON b.k = lower(trim(city))"""


def locale_vote(spark, d):
    locale = fabricate.people.vote_locale(places(spark, d), "en_US")
    return places(spark, d).agg(F.count("*").alias("votes")).withColumn("locale", F.lit(locale))


VOTE_SQL = f"""
WITH v AS ({LOCALE_SQL})
SELECT (SELECT count(*) FROM v) AS votes,
  (SELECT by_country FROM v GROUP BY 1 ORDER BY count(*) DESC, by_country LIMIT 1) AS locale"""


def invalid_city_pairs(spark, d):
    df = places(spark, d).withColumn("country", lookups.normalize_country(F.col("country")))
    return sets.invalid_pairs(df, lookups.country_city_pairs(spark), "country", "city").select(
        "c_custkey", "country", "city"
    )


def _pairs_sql() -> str:
    rows = ", ".join(f"('{k}', '{c}')" for k, cs in lookups.normalized_country_cities().items() for c in cs)
    return f"(VALUES {rows})"


INVALID_SQL = f"""
WITH p AS ({COUNTRY_SQL}), v AS (SELECT * FROM {_pairs_sql()} t(country, city))
SELECT c_custkey, country_norm AS country, city FROM p
WHERE country_norm IN (SELECT country FROM v)
  AND NOT EXISTS (SELECT 1 FROM v WHERE v.country = p.country_norm AND v.city = p.city)"""


def unique_records(spark, d):
    return frequency.unique_rows(load(spark, d, "part"), ["p_brand", "p_type", "p_size"])


UNIQUE_SQL = """
SELECT * FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_type, p_size) = 1"""


def two_sample_ks(spark, d):
    df = load(spark, d, "lineitem")
    out = ecdf.two_sample_ks(df.filter("l_orderkey % 2 = 0"), df.filter("l_orderkey % 2 = 1"), LINE)
    return rounded(out, ks=9)


def ks_sql(table: str, column: str, ref: str, syn: str) -> str:
    """Two-sample statistic by one global running count."""
    return f"""(SELECT max(abs(cr / nr - cs / ns)) AS ks, max(nr) AS n_ref, max(ns) AS n_syn FROM (
  SELECT sum(sum(CASE WHEN {ref} THEN 1 ELSE 0 END)) OVER (ORDER BY v) AS cr,
    sum(sum(CASE WHEN {syn} THEN 1 ELSE 0 END)) OVER (ORDER BY v) AS cs,
    sum(sum(CASE WHEN {ref} THEN 1 ELSE 0 END)) OVER () AS nr,
    sum(sum(CASE WHEN {syn} THEN 1 ELSE 0 END)) OVER () AS ns
  FROM (SELECT *, ({column})::DOUBLE AS v FROM {table}) WHERE v IS NOT NULL GROUP BY v))"""


KS_SQL = union_all([f"""SELECT '{c}' AS "column", n_ref::BIGINT AS n_ref, n_syn::BIGINT AS n_syn, round(ks, 9) AS ks
FROM {ks_sql('lineitem', c, 'l_orderkey % 2 = 0', 'l_orderkey % 2 = 1')}""" for c in LINE])


def parsed_dates(spark, d):
    """Text dates in several layouts, parsed or NULL."""
    df = load(spark, d, "orders").selectExpr(
        "o_orderkey",
        "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy/MM/dd')"
        " WHEN 2 THEN date_format(o_orderdate, 'MMM dd, yyyy') WHEN 3 THEN date_format(o_orderdate, 'yyyyMMdd') ELSE 'soon' END AS t",
    )
    return df.select("o_orderkey", dates.parse_date(F.col("t")).alias("parsed"),
                     dates.date_format_name(F.col("t")).alias("layout"))


PARSED_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN date_trunc('day', o_orderdate)::TIMESTAMP END AS parsed,
  (['%Y-%m-%d', '%Y/%m/%d', '%b %d, %Y', '%Y%m%d', '%Y-%m-%d'])[1 + o_orderkey % 5] AS layout FROM orders"""


def date_parts(spark, d):
    c = F.col("o_orderdate")
    return load(spark, d, "orders").select(
        "o_orderkey", F.weekday(c).alias("weekday"), F.month(c).alias("month"),
        F.datediff(F.lit("2005-01-01").cast("date"), c).alias("age_days"),
        F.date_add(c, 30).cast("timestamp").alias("due"), F.date_format(c, "dd/MM/yyyy").alias("shown"),
        dates.to_business_day(c).alias("business_day"),
    )


DATE_PARTS_SQL = """
SELECT o_orderkey, (isodow(o_orderdate) - 1)::INT AS weekday, month(o_orderdate)::INT AS month,
  date_diff('day', o_orderdate::DATE, DATE '2005-01-01')::INT AS age_days,
  (o_orderdate::DATE + INTERVAL 30 DAY)::TIMESTAMP AS due, strftime(o_orderdate, '%d/%m/%Y') AS shown,
  o_orderdate + (CASE WHEN isodow(o_orderdate) > 5 THEN 8 - isodow(o_orderdate) ELSE 0 END) * INTERVAL 1 DAY AS business_day
FROM orders"""


def text_style(spark, d):
    df = load(spark, d, "documents")
    out = df.select("doc_id", *[c.alias(k) for k, c in text.style_features(F.col("text")).items()])
    return rounded(out, avg_word_length=6)


STYLE_SQL = r"""
WITH w AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents)
SELECT doc_id, length(text)::BIGINT AS n_chars, len(words)::BIGINT AS n_words,
  round(coalesce(list_sum(list_transform(words, lambda x: length(x))) / len(words), 0), 6) AS avg_word_length,
  regexp_matches(text, '[.,!?;:]') AS has_punctuation, regexp_matches(text, '[0-9]') AS has_numbers,
  upper(text) = text AND upper(text) <> lower(text) AS is_uppercase,
  lower(text) = text AND upper(text) <> lower(text) AS is_lowercase,
  len(list_filter(words, lambda x: regexp_matches(x, '^\p{Lu}')))::BIGINT AS capitalized_words
FROM w"""


def text_helpers(spark, d):
    c = F.col("c_name")
    df = load(spark, d, "customer").selectExpr(
        "c_custkey", "c_name", "CASE WHEN c_custkey % 3 = 0 THEN 'Dr. Ann-Marie  Lee' WHEN c_custkey % 3 = 1 THEN 'Cher' ELSE '' END AS person",
        "CASE WHEN c_custkey % 4 = 0 THEN 'no mail' WHEN c_custkey % 4 = 1 THEN 'a@b@c' ELSE 'x' || c_custkey || '@mail.example' END AS mail",
        "(c_custkey % 30) || '. ' || c_name AS listed",
    )
    p = F.col("person")
    return df.select(
        "c_custkey", text.shape_pattern(c).alias("shape"), text.first_name(p).alias("first"),
        text.last_name(p).alias("last"), text.letters_only(p).alias("letters"),
        text.email_domain(F.col("mail")).alias("domain"),
        text.strip_numbering(F.col("listed")).alias("unlisted"),
    )


HELPERS_SQL = r"""
WITH t AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'Dr. Ann-Marie  Lee' WHEN c_custkey % 3 = 1 THEN 'Cher' ELSE '' END AS person,
  CASE WHEN c_custkey % 4 = 0 THEN 'no mail' WHEN c_custkey % 4 = 1 THEN 'a@b@c' ELSE 'x' || c_custkey || '@mail.example' END AS mail,
  (c_custkey % 30) || '. ' || c_name AS listed FROM customer)
SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g') AS shape,
  (['Dr.', 'Cher', 'User'])[1 + c_custkey % 3] AS first, (['Lee', 'Name', 'Name'])[1 + c_custkey % 3] AS last,
  (['drannmarielee', 'cher', 'user'])[1 + c_custkey % 3] AS letters,
  CASE WHEN c_custkey % 4 IN (0, 1) THEN 'test.com' ELSE 'mail.example' END AS domain,
  regexp_replace(listed, '^[0-9]+[.)]\s*', '') AS unlisted FROM t"""


def number_helpers(spark, d):
    c = F.col("o_totalprice")
    return load(spark, d, "orders").select(
        "o_orderkey",
        num.to_number(F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).otherwise(c.cast("string"))).alias("coerced"),
        num.clip(c, 50000.0, 200000.0).alias("clipped"), num.money_floor(c - 100000.0, 10.0).alias("floored"),
        num.round_half_even(F.col("o_orderkey") / 2).alias("rounded"),
        F.round(num.relative_difference(c, F.lit(1000.0)), 6).alias("difference"),
    )


NUMBERS_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS coerced,
  least(greatest(o_totalprice, 50000.0), 200000.0)::DOUBLE AS clipped, greatest(abs(o_totalprice - 100000.0), 10.0)::DOUBLE AS floored,
  round_even(o_orderkey / 2, 0)::BIGINT AS rounded,
  round(abs(o_totalprice - 1000.0) / (abs(o_totalprice) + 1e-9), 6) AS difference FROM orders"""


def url_matches(spark, d):
    """Anchored pattern predicate over whole values."""
    return load(spark, d, "pages").select(
        "page_id", F.col("url").rlike(r"^https://[^\s/]+/en/").alias("is_english")
    )


QUERIES = {
    "null_counts": (null_counts, NULL_SQL),
    "distinct_counts": (distinct_counts, DISTINCT_SQL),
    "frame_totals": (frame_totals, TOTALS_SQL),
    "moments": (moments, MOMENTS_SQL),
    "quantile_table": (quantile_table, QUANTILE_SQL),
    "quantile_table_narrowed": (quantile_table_narrowed, QUANTILE_SQL),
    "approx_quantiles": (approx_quantiles, APPROX_SQL),
    "correlation_matrix": (correlation_matrix, CORR_SQL),
    "group_sizes": (group_sizes, GROUP_SQL),
    "group_size_summary": (group_size_summary, GROUP_SUMMARY_SQL),
    "entropy": (entropy, ENTROPY_SQL),
    "mode_of_column": (mode_of_column, _mode_sql("lineitem", "l_shipdate")),
    "mode_by_group": (mode_by_group, _mode_sql("orders", "o_orderstatus", "o_orderpriority")),
    "calendar_shares": (calendar_shares, CALENDAR_SQL),
    "category_pairs": (category_pairs, "SELECT DISTINCT p_brand, p_type FROM part"),
    "distinct_words": (distinct_words, WORDS_SQL),
    "shared_words": (shared_words, SHARED_SQL),
    "shared_rows": (shared_rows, SHARED_ROWS_SQL),
    "unexpected_categories": (unexpected_categories, UNEXPECTED_SQL),
    "normalize_country": (normalize_country, COUNTRY_SQL),
    "place_locales": (place_locales, LOCALE_SQL),
    "locale_vote": (locale_vote, VOTE_SQL),
    "invalid_city_pairs": (invalid_city_pairs, INVALID_SQL),
    "unique_records": (unique_records, UNIQUE_SQL),
    "two_sample_ks": (two_sample_ks, KS_SQL),
    "parsed_dates": (parsed_dates, PARSED_SQL),
    "date_parts": (date_parts, DATE_PARTS_SQL),
    "text_style": (text_style, STYLE_SQL),
    "text_helpers": (text_helpers, HELPERS_SQL),
    "number_helpers": (number_helpers, NUMBERS_SQL),
    "url_matches": (url_matches, r"SELECT page_id, regexp_matches(url, '^https://[^\s/]+/en/') AS is_english FROM pages"),
}
