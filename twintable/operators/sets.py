"""Set operations and lookup joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintable.functions.text import tokens

# A lookup of this many entries or fewer is turned into literals or broadcast.
SMALL_LOOKUP = 10_000


def map_lookup(table: Mapping[str, str], key: Column, default: Column | None = None) -> Column:
    """Look a key up in a short fixed table, without any join.

    The entries become one constant map in the plan.
    """
    if len(table) > SMALL_LOOKUP:
        raise ValueError("table too long for literals; join a DataFrame instead")
    entries = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), key)
    return F.coalesce(found, default) if default is not None else found


def list_lookup(table: Mapping[str, Sequence[str]], key: Column) -> Column:
    """Array of the values a short fixed table holds for a key; NULL if there is none."""
    if sum(len(v) for v in table.values()) > SMALL_LOOKUP:
        raise ValueError("table too long for literals; join a DataFrame instead")
    entries = []
    for k, values in table.items():
        entries += [F.lit(k), F.array(*[F.lit(v) for v in values])]
    return F.try_element_at(F.create_map(*entries), key)


def shared_rows(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of ``b`` that also occur in ``a``; a row with NULL never matches.

    Both sides are made distinct before they meet, so copies of one row cannot pile up.
    """
    left = b.select(*columns).dropna().distinct()
    right = a.select(*columns).dropna().distinct()
    return left.join(right, list(columns), "left_semi")


def unexpected_values(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Distinct values of a column that the expected list (same column name) does not hold."""
    seen = df.select(F.col(f"`{column}`").alias("_v")).filter("_v IS NOT NULL").distinct()
    known = expected.select(F.col(f"`{column}`").alias("_v")).distinct()
    return seen.join(known, "_v", "left_anti").select(F.col("_v").alias(column))


def invalid_pairs(
    df: DataFrame, pairs: DataFrame, parent: str, child: str
) -> DataFrame:
    """Rows whose (parent, child) pair is not listed, for listed parents only."""
    p, c = F.col(f"`{parent}`"), F.col(f"`{child}`")
    known = pairs.select(p.alias("_known")).distinct()
    listed = pairs.select(p.alias("_parent"), c.alias("_child")).distinct()
    return df.join(known, p == F.col("_known"), "left_semi").join(
        listed, (p == F.col("_parent")) & (c == F.col("_child")), "left_anti"
    )


def vocabulary(df: DataFrame, column: str, side: str | None = None) -> DataFrame:
    """([side,] token, n): token counts of a text column.

    Tokens are counted per task before the shuffle; no list of words is ever built per group.
    """
    by = ([side] if side else []) + ["token"]
    return (
        df.filter(F.col(f"`{column}`").isNotNull())
        .select(*([side] if side else []), F.explode(tokens(F.col(f"`{column}`"))).alias("token"))
        .groupBy(*by)
        .agg(F.count("*").alias("n"))
    )
