"""Cross-column repair, checks of fabricated columns, derived columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.common import list_sql, load, u_sql
from catalog.fabrication import _alias_sql, _default_pairs
from twintable.operators import sets
from twintable.plans import repair
from twintable.plans.fabricate import lookups

SEED = 7
# A person table derived from the customers; the expressions run in both engines.
_FIRSTS = ["Henry", "Julia", "Kiran", "Aditi", "Zed", "Angus"]
_LASTS = ["O''Neil", "Lee", "Iyer", "Van Dyk"]
_COUNTRIES = ["USA", "india ", "UK", "Atlantis", "Canada"]
_CITIES = ["Mumbai", "Austin", "Pune", "London", "Kochi"]


def _choice(values, e: str, spark: bool) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"array({items})[cast({e} % {len(values)} AS INT)]" if spark else f"([{items}])[1 + {e} % {len(values)}]"


def _person(spark: bool) -> dict[str, str]:
    def c(values, e="c_custkey"):
        # Spark reads a doubled quote inside a literal as two literals
        shown = [v.replace("''", "\\'") for v in values] if spark else values
        return _choice(shown, e, spark)

    return {
        "row_id": "c_custkey",
        "record_id": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey + 0.4 END",
        "serial_no": "c_custkey - 3",
        "age": "CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE (20 + c_custkey % 50) || '.5' END",
        "first_name": c(_FIRSTS), "last_name": c(_LASTS),
        "full_name": f"{c(_FIRSTS)} || ' ' || {c(_LASTS)}",
        "gender": "'Male'", "country": c(_COUNTRIES), "city": c(_CITIES, "(c_custkey + c_nationkey)"),
        "email": "CASE WHEN c_custkey % 5 = 0 THEN 'broken' ELSE 'a@mail' || (c_custkey % 3) || '.example' END",
    }


PERSON_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _person(False).items()) + " FROM customer"


def people_table(spark, d):
    return load(spark, d, "customer").selectExpr(*[f"{e} AS {c}" for c, e in _person(True).items()])


def repair_integers(spark, d):
    out = repair.repair_integers(people_table(spark, d))
    return out.select("row_id", "record_id", "serial_no", "age")


INTEGERS_SQL = f"""
WITH p AS ({PERSON_SQL}), n AS (SELECT row_id, try_cast(record_id AS DOUBLE) AS r, try_cast(serial_no AS DOUBLE) AS s, try_cast(age AS DOUBLE) AS a FROM p),
m AS (SELECT median(r) AS r, median(s) AS s, median(a) AS a, min(round_even(r, 0)) AS rl, min(round_even(s, 0)) AS sl FROM n)
SELECT row_id, CASE WHEN m.rl <= 0 THEN row_id + 1 ELSE round_even(coalesce(n.r, m.r), 0)::BIGINT END AS record_id,
  CASE WHEN m.sl <= 0 THEN row_id + 1 ELSE round_even(coalesce(n.s, m.s), 0)::BIGINT END AS serial_no,
  round_even(coalesce(n.a, m.a), 0)::BIGINT AS age FROM n, m"""


def repair_emails(spark, d):
    return repair.repair_emails(people_table(spark, d)).select("row_id", "email")


_CLEAN = r"regexp_replace(lower({}), '[^\p{{L}}]', '', 'g')"
EMAILS_SQL = f"""
WITH p AS ({PERSON_SQL}) SELECT row_id, {_CLEAN.format('first_name')} || '.' || {_CLEAN.format('last_name')} || (row_id + 1)
  || '@' || CASE WHEN len(string_split(email, '@')) = 2 THEN string_split(email, '@')[2] ELSE 'test.com' END AS email FROM p"""


def repair_cities(spark, d):
    return repair.repair_cities(people_table(spark, d), SEED).select("row_id", "country", "city")


CITIES_SQL = f"""
WITH p AS ({PERSON_SQL}), l AS (SELECT country AS k, list_sort(list(city)) AS cities FROM {_default_pairs()} t(country, city) GROUP BY 1)
SELECT row_id, country, CASE WHEN cities IS NOT NULL AND NOT list_contains(cities, city)
  THEN cities[1 + CAST(floor({u_sql(SEED, 'city|repair', 'row_id', 0)} * len(cities)) AS INT)] ELSE city END AS city
FROM p LEFT JOIN l ON k = {_alias_sql('country')}"""


def repair_genders(spark, d):
    return repair.repair_genders(people_table(spark, d)).select("row_id", "first_name", "gender")


_GENDERS = ", ".join(f"('{n}', '{g}')" for n, g in lookups.gender_of_names().items())
GENDERS_SQL = f"""
WITH p AS ({PERSON_SQL}) SELECT row_id, first_name, coalesce(g, gender) AS gender
FROM p LEFT JOIN (VALUES {_GENDERS}) t(n, g) ON n = lower(first_name)"""


def repair_surnames(spark, d):
    return repair.repair_surnames(people_table(spark, d), SEED).select("row_id", "last_name", "full_name")


_SURNAMES = ", ".join(f"('{k}', {list_sql(v)})" for k, v in lookups.CITY_SURNAMES.items())
SURNAMES_SQL = f"""
WITH p AS ({PERSON_SQL}), s AS (SELECT p.*, pool[1 + CAST(floor({u_sql(SEED, 'city|surname', 'row_id', 0)} * len(pool)) AS INT)] AS sur
 FROM p LEFT JOIN (VALUES {_SURNAMES}) t(k, pool) ON k = lower(trim(city)))
SELECT row_id, coalesce(sur, last_name) AS last_name,
  CASE WHEN sur IS NULL THEN full_name ELSE regexp_replace(full_name, '\\S+$', sur) END AS full_name FROM s"""


def repair_all(spark, d):
    """Everything together: what each repair promises, counted."""
    out = repair.repair(people_table(spark, d), SEED)
    listed = sets.list_lookup(lookups.normalized_country_cities(), lookups.normalize_country(F.col("country")))
    from twintable.functions.text import letters_only

    start = F.concat(letters_only(F.col("first_name")), F.lit("."), letters_only(F.col("last_name"), "name"))
    return out.agg(
        F.count("*").alias("rows"), F.count_if(listed.isNotNull() & ~F.array_contains(listed, F.col("city"))).alias("bad_cities"),
        F.count_if(~F.startswith(F.col("email"), start)).alias("bad_emails"),
        F.count_if(F.col("record_id").isNull() | F.col("age").isNull()).alias("missing"),
        F.count_if((F.col("first_name") == "Julia") & (F.col("gender") != "Female")).alias("bad_genders"),
    )


ALL_SQL = "SELECT count(*) AS rows, 0::BIGINT AS bad_cities, 0::BIGINT AS bad_emails, 0::BIGINT AS missing, 0::BIGINT AS bad_genders FROM customer"


def categorical_checks(spark, d):
    """Unexpected categories and city pairs that do not fit, counted."""
    df = people_table(spark, d)
    known = df.filter("row_id % 2 = 0").select("first_name").distinct().filter("first_name <> 'Zed'")
    odd = sets.unexpected_values(df, "first_name", known).agg(
        F.lit("unexpected_categories").alias("check"), F.count("*").alias("found")
    )
    places = df.withColumn("country", lookups.normalize_country(F.col("country")))
    pairs = sets.invalid_pairs(places, lookups.country_city_pairs(spark), "country", "city").agg(
        F.lit("invalid_pairs").alias("check"), F.count("*").alias("found")
    )
    return odd.unionByName(pairs)


CHECK_SQL = f"""
WITH p AS ({PERSON_SQL}), v AS (SELECT * FROM {_default_pairs()} t(country, city))
SELECT 'unexpected_categories' AS "check", count(*) AS found FROM (SELECT DISTINCT first_name FROM p
  WHERE first_name NOT IN (SELECT first_name FROM p WHERE row_id % 2 = 0 AND first_name <> 'Zed'))
UNION ALL SELECT 'invalid_pairs', count(*) FROM p WHERE {_alias_sql('country')} IN (SELECT country FROM v)
  AND NOT EXISTS (SELECT 1 FROM v WHERE v.country = {_alias_sql('p.country')} AND v.city = p.city)"""


def temporal_checks(spark, d):
    df = load(spark, d, "orders").withColumn(
        "o_orderdate", F.when(F.col("o_orderkey") % 40 != 0, F.col("o_orderdate"))
    )
    return repair.temporal_checks(
        df, {"o_orderdate": (dt.datetime(1996, 1, 1), dt.datetime(1999, 1, 1))}, business_days=True
    )


TEMPORAL_SQL = """
WITH t AS (SELECT CASE WHEN o_orderkey % 40 <> 0 THEN o_orderdate END AS x FROM orders),
b AS (SELECT epoch(TIMESTAMP '1996-01-01') - 0.1 * s AS lo, epoch(TIMESTAMP '1999-01-01') + 0.1 * s AS hi
  FROM (SELECT epoch(TIMESTAMP '1999-01-01') - epoch(TIMESTAMP '1996-01-01') AS s))
SELECT 'o_orderdate' AS "column", count(*) FILTER (WHERE x IS NULL) AS missing, count(*) FILTER (WHERE epoch(x) < lo) AS before_range,
  count(*) FILTER (WHERE epoch(x) > hi) AS after_range, count(*) FILTER (WHERE isodow(x) > 5) AS weekend,
  count(*) FILTER (WHERE x IS NULL OR isodow(x) > 5) = 0 AS valid FROM t, b"""


def pipeline_rollup(spark, d):
    from twintable.plans import infer

    df = load(spark, d, "orders").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    )
    routed = infer.route_types(df).select("pipeline", (F.col("n") == F.col("total_count")).alias("valid"))
    return repair.pipeline_rollup(routed)


ROLLUP_SQL = """
SELECT 'numeric' AS pipeline, 3::BIGINT AS checks, 1::BIGINT AS failed, FALSE AS valid WHERE (SELECT count(*) FROM orders) > 0
UNION ALL SELECT 'temporal', 1, 0, TRUE UNION ALL SELECT 'hybrid', 2, 0, TRUE"""


def derived_columns(spark, d):
    """Rules given out of order, one with a missing source."""
    rules = [
        repair.DerivedColumn("label", ["net", "l_returnflag"], lambda n, f: F.concat_ws("-", f, F.floor(n).cast("string"))),
        repair.DerivedColumn("net", ["l_extendedprice", "l_discount"], lambda p, x: p * (1 - x)),
        repair.DerivedColumn("never", ["not_there"], lambda x: x),
    ]
    out = repair.apply_derived(load(spark, d, "lineitem"), rules)
    return out.select(*[c for c in out.columns if c in ("l_orderkey", "l_linenumber", "net", "label", "never")])


DERIVED_SQL = """
SELECT l_orderkey, l_linenumber, net, l_returnflag || '-' || floor(net)::BIGINT AS label
FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)"""

QUERIES = {
    "repair_integers": (repair_integers, INTEGERS_SQL),
    "repair_emails": (repair_emails, EMAILS_SQL),
    "repair_cities": (repair_cities, CITIES_SQL),
    "repair_genders": (repair_genders, GENDERS_SQL),
    "repair_surnames": (repair_surnames, SURNAMES_SQL),
    "repair_all": (repair_all, ALL_SQL),
    "categorical_checks": (categorical_checks, CHECK_SQL),
    "temporal_checks": (temporal_checks, TEMPORAL_SQL),
    "pipeline_rollup": (pipeline_rollup, ROLLUP_SQL),
    "derived_columns": (derived_columns, DERIVED_SQL),
}
