"""Categorical columns: by frequency, by name, and cities that fit their country."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintable.functions.draw import Draws, pick, pick_from, pick_weighted
from twintable.operators.alias import pick_by_alias
from twintable.operators.columns import has_token
from twintable.operators.frequency import value_frequencies
from twintable.operators.prefix import draw_order, pick_by_span, running_span
from twintable.operators.sets import SMALL_LOOKUP
from twintable.plans.fabricate import lookups

# Up to this many categories a column becomes a comparison tree of literals.
LITERAL_CATEGORIES = 256


def category_counts(
    df: DataFrame, columns: Sequence[str], sizes: Mapping[str, int] | None = None
) -> dict[str, list[tuple[str, int]] | None]:
    """Counts per column, in draw order; None for columns with too many values.

    Distinct counts that are known already save a pass; else a sketch rules out the long columns
    before anything is counted. What reaches the driver is a few hundred values per column.
    """
    if not columns:
        return {}
    if sizes is None:
        seen = df.agg(*[
            F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(f"d{i}") for i, c in enumerate(columns)
        ]).first()
        sizes = {c: seen[i] / 1.5 for i, c in enumerate(columns)}
    short = [c for c in columns if sizes[c] <= LITERAL_CATEGORIES]
    out: dict[str, list[tuple[str, int]] | None] = {c: None for c in columns}
    rows = value_frequencies(df, short).collect() if short else []
    for c in short:
        found = [(r["value"], r["n"]) for r in rows if r["column"] == c]
        if len(found) <= LITERAL_CATEGORIES:
            out[c] = sorted(found, key=lambda vn: draw_order(vn[0]))
    return out


def by_frequency(counts: Sequence[tuple[str, int]], u: Column) -> Column:
    return pick_weighted([v for v, _ in counts], [n for _, n in counts], u)


def by_name(column: str, u: Column) -> Column:
    """Fallback categories chosen by a word in the column name."""
    for word, values in lookups.FALLBACK_CATEGORIES.items():
        if has_token(column, word):
            return pick(values, u)
    return pick(lookups.OTHER_CATEGORIES, u)


def add_long_category(
    rows: DataFrame, reference: DataFrame, column: str, seed: int, method: str = "md5", long_lists: str = "spans"
) -> DataFrame:
    """Adds a column with too many categories for literals, by a join.

    "spans" joins on cumulative counts and draws as a short list would; "alias" joins each draw to one cell of an
    alias table, however much of the weight a single category holds.
    """
    freq = value_frequencies(reference, [column]).select("value", "n")
    u = Draws(seed, column, F.col("row_id"), method)
    if long_lists == "alias":
        return pick_by_alias(rows, u(0), u(1), freq, "value", "n", column)
    if long_lists != "spans":
        raise ValueError(f"long_lists is spans or alias, not {long_lists}")
    return pick_by_span(rows, u(0), freq, "value", "n", column)


def city_table(
    reference: DataFrame | None, country: str | None, city: str | None, spark
) -> DataFrame:
    """(country, city): default pairs and those of the reference, distinct."""
    pairs = lookups.country_city_pairs(spark)
    if reference is not None and country and city:
        seen = reference.select(
            lookups.normalize_country(F.col(f"`{country}`")).alias("country"),
            F.col(f"`{city}`").cast("string").alias("city"),
        ).dropna()
        pairs = pairs.unionByName(seen).distinct()
    return pairs


def add_city(
    rows: DataFrame, country: str, pairs: DataFrame, u: Column, name: str, fallback: Column
) -> DataFrame:
    """Adds a city that is listed for the row's country; ``fallback`` for unknown countries."""
    keyed = rows.withColumn("_country", lookups.normalize_country(F.col(f"`{country}`")))
    if pairs.limit(SMALL_LOOKUP + 1).count() <= SMALL_LOOKUP:
        # size just checked: one array per country
        arrays = pairs.groupBy(F.col("country").alias("_country")).agg(
            F.array_sort(F.collect_list(F.struct(F.md5("city"), "city")))["city"].alias("_cities")
        )
        joined = keyed.join(F.broadcast(arrays), "_country", "left")
        chosen = F.coalesce(pick_from(F.col("_cities"), u), fallback)
        return joined.select(
            *[F.col(f"`{c}`") for c in rows.columns],
            chosen.alias(name),
        )
    # many cities: number them within their country, draw a number, join on (country, number)
    numbered = running_span(pairs.withColumn("_one", F.lit(1)), "_one", "city", ["country"]).select(
        F.col("country").alias("_country"), F.col("city").alias("_city"),
        F.col("span_lo").alias("_number"),
    )
    sizes = numbered.groupBy("_country").agg(F.count("*").alias("_n"))
    drawn = keyed.join(sizes, "_country", "left").withColumn(
        "_number", F.floor(u * F.col("_n")).cast("long")
    )
    joined = drawn.join(numbered, ["_country", "_number"], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns], F.coalesce("_city", fallback).alias(name)
    )
