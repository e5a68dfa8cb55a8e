"""Personal-data detection and type inference."""

from __future__ import annotations

from catalog.common import load, rounded, union_all
from twintable.plans import detect, infer

# A contact table derived from the customers; the expressions run in both engines.
CONTACTS = {
    "record_id": "c_custkey + 1",
    "person": "CASE WHEN c_custkey % 3 = 0 THEN 'James' WHEN c_custkey % 3 = 1 THEN 'MARIA' ELSE 'Wei' END"
              " || ' ' || CASE WHEN c_custkey % 2 = 0 THEN 'Smith' ELSE 'Okafor' END",
    "contact": "CASE WHEN c_custkey % 50 = 0 THEN 'none' ELSE 'user' || c_custkey || '@example.com' END",
    "line": "CASE WHEN c_custkey % 8 = 0 THEN 'n/a' ELSE '555-' || lpad((c_custkey % 1000) || '', 3, '0')"
            " || '-' || lpad((c_custkey % 10000) || '', 4, '0') END",
    "tax_no": "lpad((100 + c_custkey % 800) || '', 3, '0') || '-' || lpad((c_custkey % 100) || '', 2, '0')"
              " || '-' || lpad((c_custkey % 10000) || '', 4, '0')",
    "card": "'4000 1234 5678 ' || lpad((c_custkey % 10000) || '', 4, '0')",
    "post_code": "CASE WHEN c_custkey % 3 = 0 THEN lpad(c_custkey || '', 5, '0') ELSE lpad(c_custkey || '', 5, '0') || '-0001' END",
    "host": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '10.0.' || (c_custkey % 256) || '.' || (c_custkey % 100) END",
    "page": "'https://site' || (c_custkey % 7) || '.example.org/' || c_custkey",
    "token": "'0a1b2c3d-0000-4000-8000-' || lpad(c_custkey || '', 12, '0')",
    "place": "c_custkey || CASE WHEN c_custkey % 4 = 0 THEN ' Nothing' ELSE ' Oak Street' END",
    "segment": "c_mktsegment",
}
CONTACT_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in CONTACTS.items()) + " FROM customer"
TEXTS = [c for c in CONTACTS if c != "record_id"]


def contacts(spark, d):
    return load(spark, d, "customer").selectExpr(*[f"{e} AS {c}" for c, e in CONTACTS.items()])


def _hits_sql(c: str) -> str:
    hits = {k: f"regexp_matches({c}, '{p}')" for k, p in detect.PATTERNS.items()}
    first = ", ".join(f"'{n}'" for n in detect.COMMON_FIRST_NAMES)
    last = ", ".join(f"'{n}'" for n in detect.COMMON_LAST_NAMES)
    w = f"regexp_split_to_array(lower(trim({c})), '\\s+')"
    hits["name"] = (
        f"(regexp_matches(trim({c}), '{detect.FULL_NAME}') OR (len({w}) >= 2 AND ({w}[1] IN ({first})"
        f" OR {w}[-1] IN ({last}))) OR regexp_matches(trim({c}), '{detect.TITLED_NAME}'))"
    )
    words = "|".join(detect.ADDRESS_WORDS)
    hits["address"] = f"(regexp_matches(lower({c}), '({words})') AND regexp_matches({c}, '[0-9]'))"
    return union_all([
        f"""SELECT '{c}' AS "column", '{k}' AS pii_type,
        coalesce(sum(CASE WHEN {h} THEN 1 ELSE 0 END), 0)::BIGINT AS match_count, count({c}) AS total_count FROM t"""
        for k, h in hits.items()
    ])


COUNTS_SQL = (f"WITH t AS ({CONTACT_SQL}), c AS (" + union_all([_hits_sql(c) for c in TEXTS])
              + "), rated AS (SELECT *, match_count / total_count AS match_rate FROM c)")
_PRIORITY_SQL = "list_position([" + ", ".join(f"'{k}'" for k in detect.PRIORITY) + "], pii_type)"
SCORED_SQL = COUNTS_SQL + f"""
, scored AS (SELECT *, CASE WHEN pii_type = 'name' THEN least(0.9, match_rate + 0.2)
   WHEN pii_type = 'address' THEN least(0.85, match_rate + 0.15)
   WHEN match_rate >= 0.95 THEN 0.95 WHEN match_rate >= 0.8 THEN 0.85 WHEN match_rate >= 0.6 THEN 0.7
   ELSE match_rate * 0.8 END::DOUBLE AS confidence FROM rated
  WHERE CASE WHEN pii_type IN ('name', 'address') THEN match_rate >= 0.3 ELSE match_rate > 0.1 END),
ranked AS (SELECT *, confidence >= 0.7 AND match_rate >= 0.7 AS is_likely,
  row_number() OVER (PARTITION BY "column" ORDER BY confidence DESC, {_PRIORITY_SQL})::INT AS rank FROM scored)"""


def pii_match_counts(spark, d):
    return rounded(detect.match_counts(contacts(spark, d), TEXTS), match_rate=6)


def pii_detections(spark, d):
    return rounded(detect.detect(contacts(spark, d), TEXTS), match_rate=6, confidence=6)


def pii_primary_types(spark, d):
    return rounded(detect.primary_types(contacts(spark, d)), match_rate=6, confidence=6)


def pii_numeric_columns(spark, d):
    """Numbers on request: nearly all of them look like phones."""
    df = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    return rounded(detect.primary_types(df, include_numeric=True), match_rate=6, confidence=6)


NUMERIC_PII_SQL = "SELECT * FROM (" + union_all([f"""
SELECT c AS "column", 'phone' AS pii_type, CASE WHEN r >= 0.95 THEN 0.95 WHEN r >= 0.8 THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence,
  round(r, 6) AS match_rate FROM (SELECT '{c}' AS c,
   avg(CASE WHEN regexp_matches({c}::VARCHAR, '{detect.PATTERNS['phone']}') THEN 1.0 ELSE 0 END) AS r FROM orders)"""
    for c in ("o_orderkey", "o_custkey")]) + ") WHERE match_rate >= 0.7"


def pii_examples(spark, d):
    return detect.match_examples(load(spark, d, "pages"), "url", "url", 5)


def pii_router(spark, d):
    out = detect.router_pii(contacts(spark, d), ["person", "contact", "line", "segment"])
    return rounded(out, pii_email=6, pii_phone=6, pii_name=6)


def _router_sql() -> str:
    parts = []
    for c in ["person", "contact", "line", "segment"]:
        rates = ", ".join(
            f"avg(CASE WHEN regexp_matches({c}, '{p}') THEN 1.0 ELSE 0 END) AS {k}"
            for k, (p, _) in detect.ROUTER_PATTERNS.items()
        )
        parts.append(f"""SELECT '{c}' AS "column", {rates} FROM t WHERE {c} IS NOT NULL""")
    return f"""WITH t AS ({CONTACT_SQL}), r AS ({union_all(parts)})
SELECT "column", round(pii_email, 6) AS pii_email, round(pii_phone, 6) AS pii_phone,
  round(pii_name, 6) AS pii_name, CASE WHEN pii_email > 0.8 THEN 'pii_email'
  WHEN pii_phone > 0.8 THEN 'pii_phone' WHEN pii_name > 0.6 THEN 'pii_name' END AS pii_type FROM r"""


# ---------------------------------------------------------------- type inference

DATES = {
    "day_text": "CASE WHEN event_id % 25 = 0 THEN 'soon' ELSE cast(cast(ts AS DATE) AS VARCHAR(10)) END",
    "note": "'Event number ' || event_id || ' seen by user ' || user_id || CASE WHEN event_id % 2 = 0 THEN ' in the late afternoon of a long day' ELSE '' END",
    "amount_text": "cast(event_id AS VARCHAR(20)) || '.5'",
    "event_type": "event_type",
    "value": "value",
    "user_id": "user_id",
    "flag": "cast(event_id % 2 AS INT)",
    "ts": "ts",
}
DATES_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in DATES.items()) + " FROM events"


def _mixed(spark, d):
    return load(spark, d, "events").selectExpr(*[f"{e} AS {c}" for c, e in DATES.items()])


SCORE_COLUMNS = ["column", "numeric_score", "categorical_score", "text_score", "temporal_score",
                 "inferred_type", "type_confidence"]
# (column, numeric type, date type, share of values that parse as dates)
_KINDS = {"value": "number", "user_id": "number", "flag": "number", "ts": "date"}


def type_scores(spark, d):
    return infer.type_scores(_mixed(spark, d)).select(*SCORE_COLUMNS)


def _stats_sql(columns) -> str:
    parts = []
    for c in columns:
        kind = _KINDS.get(c, "text")
        t = f"{c}::VARCHAR"
        parsed = {"number": "0", "date": f"count({c})",
                  "text": f"count(try_strptime({t}, '%Y-%m-%d'))"}[kind]
        number = {"number": f"count({c})", "date": "0", "text": f"count(try_cast({t} AS DOUBLE))"}[kind]
        parts.append(f"""
SELECT '{c}' AS "column", {str(kind == 'number').upper()} AS is_number, {str(kind == 'date').upper()} AS is_date,
  count(*) AS total, count({c}) AS n, {number} AS n_numeric,
  {parsed} AS n_parsed, count(DISTINCT {c}) AS n_distinct,
  (SELECT max(k) FROM (SELECT count(*) AS k FROM t WHERE {c} IS NOT NULL GROUP BY {c})) AS top_count,
  avg(length({t})) AS avg_len, max(length({t})) AS max_len, coalesce(stddev_samp(length({t})), 0) AS std_len,
  avg(CASE WHEN {t} LIKE '% %' THEN 1.0 ELSE 0 END) AS spaces,
  avg(CASE WHEN regexp_matches({t}, '[a-z]') AND regexp_matches({t}, '[A-Z]') THEN 1.0 ELSE 0 END) AS mixed,
  avg(CASE WHEN regexp_matches({t}, '[0-9]{{1,4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,4}}') THEN 1.0 ELSE 0 END) AS date_like
FROM t""")
    return union_all(parts)


SCORE_SQL = f"""
WITH t AS ({DATES_SQL}), s AS ({_stats_sql(DATES)}),
scores AS (SELECT *,
  round(CASE WHEN is_number THEN 0.4 ELSE 0 END + CASE WHEN n_numeric = n THEN 0.5 ELSE 0 END, 6)::DOUBLE AS numeric_score,
  round((CASE WHEN n_distinct / n < 0.01 THEN 0.4 WHEN n_distinct / n < 0.05 THEN 0.3
         WHEN n_distinct / n < 0.1 THEN 0.2 ELSE 0 END)
   + (CASE WHEN n_distinct < 10 THEN 0.2 WHEN n_distinct < 50 THEN 0.1 ELSE 0 END)
   + (CASE WHEN top_count / n > 0.3 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS categorical_score,
  round((CASE WHEN avg_len > 20 THEN 0.3 ELSE 0 END) + (CASE WHEN std_len > 10 THEN 0.2 ELSE 0 END)
   + (CASE WHEN spaces > 0.5 THEN 0.2 ELSE 0 END) + (CASE WHEN mixed > 0.3 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS text_score,
  round(CASE WHEN n_parsed / n >= 0.95 THEN 0.5 WHEN n_parsed / n >= 0.8 THEN 0.3 ELSE 0 END
   + CASE WHEN NOT is_number AND date_like > 0.7 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS temporal_score
  FROM s),
best AS (SELECT *, greatest(numeric_score, categorical_score, text_score, temporal_score) AS top FROM scores)
SELECT "column", numeric_score, categorical_score, text_score, temporal_score,
  CASE WHEN top <= 0.3 THEN 'text' WHEN numeric_score = top THEN 'numeric'
   WHEN categorical_score = top THEN 'categorical' WHEN text_score = top THEN 'text'
   ELSE 'temporal' END AS inferred_type,
  CASE WHEN top <= 0.3 THEN 0.2 ELSE top END::DOUBLE AS type_confidence FROM best"""


def infer_types(spark, d):
    out = infer.infer_types(contacts(spark, d)).select(
        "column", "inferred_type", "type_confidence", "pii_type"
    )
    return rounded(out, type_confidence=6)


_CONTACT_STATS = union_all([f"""
SELECT '{c}' AS "column", count({c}) AS n, count(DISTINCT {c}) AS n_distinct,
  {'count(' + c + ')' if c == 'record_id' else 'count(try_cast(' + c + ' AS DOUBLE))'} AS n_numeric,
  (SELECT max(k) FROM (SELECT count(*) AS k FROM t WHERE {c} IS NOT NULL GROUP BY {c})) AS top_count,
  avg(length({c}::VARCHAR)) AS avg_len, coalesce(stddev_samp(length({c}::VARCHAR)), 0) AS std_len,
  avg(CASE WHEN {c}::VARCHAR LIKE '% %' THEN 1.0 WHEN {c} IS NOT NULL THEN 0 END) AS spaces,
  avg(CASE WHEN regexp_matches({c}::VARCHAR, '[a-z]') AND regexp_matches({c}::VARCHAR, '[A-Z]') THEN 1.0 WHEN {c} IS NOT NULL THEN 0 END) AS mixed,
  avg(CASE WHEN regexp_matches({c}::VARCHAR, '[0-9]{{1,4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,4}}') THEN 1.0 WHEN {c} IS NOT NULL THEN 0 END) AS date_like
FROM t""" for c in CONTACTS])
INFER_SQL = SCORED_SQL + f"""
, s AS ({_CONTACT_STATS}), scores AS (SELECT *,
  CASE WHEN "column" = 'record_id' THEN 0.9 WHEN n_numeric = n THEN 0.5 ELSE 0 END AS a,
  (CASE WHEN n_distinct / n < 0.01 THEN 0.4 WHEN n_distinct / n < 0.05 THEN 0.3 WHEN n_distinct / n < 0.1 THEN 0.2 ELSE 0 END)
   + (CASE WHEN n_distinct < 10 THEN 0.2 WHEN n_distinct < 50 THEN 0.1 ELSE 0 END)
   + (CASE WHEN top_count / n > 0.3 THEN 0.1 ELSE 0 END) AS b,
  (CASE WHEN avg_len > 20 THEN 0.3 ELSE 0 END) + (CASE WHEN std_len > 10 THEN 0.2 ELSE 0 END)
   + (CASE WHEN spaces > 0.5 THEN 0.2 ELSE 0 END) + (CASE WHEN mixed > 0.3 THEN 0.1 ELSE 0 END) AS c,
  CASE WHEN "column" <> 'record_id' AND date_like > 0.7 THEN 0.2 ELSE 0 END AS e FROM s),
typed AS (SELECT *, greatest(a, b, c, e) AS top FROM scores),
named AS (SELECT "column", CASE WHEN top <= 0.3 THEN 'text' WHEN a = top THEN 'numeric' WHEN b = top THEN 'categorical'
   WHEN c = top THEN 'text' ELSE 'temporal' END AS kind, CASE WHEN top <= 0.3 THEN 0.2 ELSE top END AS conf FROM typed),
likely AS (SELECT "column", arg_min(pii_type, rank) AS pii_type, arg_min(confidence, rank) AS confidence
  FROM ranked WHERE is_likely GROUP BY 1)
SELECT n."column", CASE WHEN confidence > 0.8 AND confidence > conf THEN 'pii_' || pii_type ELSE kind END AS inferred_type,
  round(CASE WHEN confidence > 0.8 AND confidence > conf THEN confidence ELSE conf END, 6)::DOUBLE AS type_confidence, pii_type
FROM named n LEFT JOIN likely USING ("column")"""


def route_types(spark, d):
    out = infer.route_types(_mixed(spark, d), hints={"amount_text": "Numeric"})
    return out.select("column", "data_type", "pipeline", "n_distinct")


ROUTE_SQL = f"""
WITH t AS ({DATES_SQL}), s AS ({_stats_sql(DATES)}),
r AS (SELECT "column", n_distinct, CASE WHEN "column" = 'amount_text' THEN 'numeric'
  WHEN "column" = 'flag' THEN 'boolean' WHEN is_number THEN 'numeric' WHEN is_date THEN 'temporal'
  WHEN n_parsed / n >= 0.9 THEN 'temporal'
  WHEN n_distinct / n < 0.05 OR n_distinct < 20 THEN 'categorical' ELSE 'text' END AS data_type FROM s)
SELECT *, CASE data_type WHEN 'boolean' THEN 'numeric' WHEN 'categorical' THEN 'hybrid' ELSE data_type END AS pipeline FROM r"""


def analyze_schema(spark, d):
    out = infer.analyze_schema(_mixed(spark, d))
    return rounded(out, null_pct=6, avg_len=6, min=6, max=6, mean=5, std=5, skew=6)


def _schema_sql() -> str:
    moments = union_all([f"""
SELECT '{c}' AS "column", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 5) AS mean,
  round(stddev_samp({c}), 5) AS std, round(skewness({c}), 6) AS skew FROM t"""
        for c in ("value", "user_id", "flag")])
    return f"""
WITH t AS ({DATES_SQL}), s AS ({_stats_sql(DATES)}), m AS ({moments}),
r AS (SELECT *, CASE WHEN "column" = 'flag' THEN 'boolean' WHEN is_number THEN 'numeric' WHEN is_date THEN 'temporal'
  WHEN n_parsed / n >= 0.9 THEN 'temporal'
  WHEN n_distinct / n < 0.05 OR n_distinct < 20 THEN 'categorical' ELSE 'text' END AS data_type FROM s),
span AS (SELECT 'ts' AS "column", min(ts) AS min_ts, max(ts) AS max_ts, NULL AS date_format FROM t
  UNION ALL SELECT 'day_text', min(try_strptime(day_text, '%Y-%m-%d')), max(try_strptime(day_text, '%Y-%m-%d')), '%Y-%m-%d' FROM t)
SELECT r."column", data_type,
  CASE data_type WHEN 'boolean' THEN 'numeric' WHEN 'categorical' THEN 'hybrid' ELSE data_type END AS pipeline,
  n < total AS nullable, round(1 - n / total, 6) AS null_pct, n_distinct AS n_unique,
  CASE WHEN data_type = 'text' THEN round(avg_len, 6) END AS avg_len,
  CASE WHEN data_type = 'text' THEN max_len END::INT AS max_len,
  min, max, mean, std, skew, min_ts, max_ts, date_format
FROM r LEFT JOIN m USING ("column") LEFT JOIN span USING ("column")"""


def hinted_types(spark, d):
    """Hint words mapped to types and families for every segment row that carries one."""
    from pyspark.sql import functions as F

    from twintable.operators.sets import map_lookup

    words = ["numeric", "text", "categorical", "name", "email", "phone", "address", "id", "date",
             "datetime", "boolean", "colour"]
    df = load(spark, d, "orders").select(
        F.get(F.array(*map(F.lit, words)), (F.col("o_orderkey") % 12).cast("int")).alias("hint")
    )
    kind = map_lookup(infer.HINT_TYPES, F.col("hint"), F.lit("unknown"))
    return df.withColumn("data_type", kind).withColumn(
        "family", map_lookup(infer.FAMILIES, F.col("data_type"), F.lit("hybrid"))
    ).groupBy("hint", "data_type", "family").agg(F.count("*").alias("n"))


HINT_SQL = """
SELECT hint, data_type, CASE WHEN data_type LIKE 'pii%' THEN 'pii' WHEN data_type IN ('numeric', 'boolean') THEN 'numeric'
  WHEN data_type IN ('text', 'temporal') THEN data_type ELSE 'hybrid' END AS family, count(*) AS n
FROM (SELECT hint, CASE WHEN hint IN ('name', 'email', 'phone', 'address', 'id') THEN 'pii_' || hint
  WHEN hint IN ('date', 'datetime') THEN 'temporal' WHEN hint = 'colour' THEN 'unknown' ELSE hint END AS data_type
  FROM (SELECT (['numeric', 'text', 'categorical', 'name', 'email', 'phone', 'address', 'id', 'date',
    'datetime', 'boolean', 'colour'])[1 + o_orderkey % 12] AS hint FROM orders)) GROUP BY ALL"""


def integer_columns(spark, d):
    """Which numeric columns would be fabricated as integers, and why."""
    from pyspark.sql import functions as F

    from twintable.operators.columns import rows_from_wide

    df = load(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount",
                                           F.col("l_tax").alias("stage_id"))
    whole = df.agg(*[F.bool_and(F.col(c) % 1 == 0).alias(c) for c in df.columns])
    flags = whole.first()
    structs = [
        F.struct(F.lit(c).alias("column"), F.col(c).alias("all_integral"),
                 F.lit(infer.should_be_integer(c, df.schema[c].dataType, flags[c])).alias("is_integer"))
        for c in df.columns
    ]
    return rows_from_wide(whole, structs)


INTEGER_SQL = """
SELECT 'l_orderkey' AS "column", bool_and(l_orderkey % 1 = 0) AS all_integral, TRUE AS is_integer FROM lineitem
UNION ALL SELECT 'l_quantity', bool_and(l_quantity % 1 = 0), bool_and(l_quantity % 1 = 0) FROM lineitem
UNION ALL SELECT 'l_discount', bool_and(l_discount % 1 = 0), bool_and(l_discount % 1 = 0) FROM lineitem
UNION ALL SELECT 'stage_id', bool_and(l_tax % 1 = 0), TRUE FROM lineitem"""

QUERIES = {
    "pii_match_counts": (pii_match_counts, COUNTS_SQL + ' SELECT "column", pii_type, match_count, total_count, round(match_rate, 6) AS match_rate FROM rated'),
    "pii_detections": (pii_detections, SCORED_SQL + ' SELECT "column", pii_type, match_count, total_count, round(match_rate, 6) AS match_rate, round(confidence, 6) AS confidence, is_likely, rank FROM ranked'),
    "pii_primary_types": (pii_primary_types, SCORED_SQL + ' SELECT "column", arg_min(pii_type, rank) AS pii_type, round(arg_min(confidence, rank), 6) AS confidence, round(arg_min(match_rate, rank), 6) AS match_rate FROM ranked WHERE is_likely GROUP BY 1'),
    "pii_numeric_columns": (pii_numeric_columns, NUMERIC_PII_SQL),
    "pii_examples": (pii_examples, f"SELECT DISTINCT url AS value FROM pages WHERE regexp_matches(url, '{detect.PATTERNS['url']}') ORDER BY 1 LIMIT 5"),
    "pii_router": (pii_router, _router_sql()),
    "type_scores": (type_scores, SCORE_SQL),
    "infer_types": (infer_types, INFER_SQL),
    "route_types": (route_types, ROUTE_SQL),
    "analyze_schema": (analyze_schema, _schema_sql()),
    "hinted_types": (hinted_types, HINT_SQL),
    "integer_columns": (integer_columns, INTEGER_SQL),
}
