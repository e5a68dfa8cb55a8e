"""The value-frequency table and everything that is read off it.

One shuffle replaces one distinct-count plan per column. Rows are combined before the
shuffle, so a value that fills a third of the table travels as a few partial counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twintable.functions.numbers import not_nan, plain_text

LONG_VALUE = 64


def value_key(text: Column) -> Column:
    """Grouping key of bounded width: long texts are replaced by their SHA-256.

    Only texts of 64 characters and more are hashed (to 64), so keys never mix.
    """
    return F.when(F.length(text) >= LONG_VALUE, F.sha2(text, 256)).otherwise(text)


def melt(
    df: DataFrame,
    columns: Sequence[str],
    side: str | None = None,
    keys: bool = False,
) -> DataFrame:
    """(column, value[, side]) rows of the non-missing values, as text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    structs = []
    for c in columns:
        v = plain_text(not_nan(F.col(f"`{c}`"), types[c]), types[c])
        if keys and isinstance(types[c], T.StringType):
            v = value_key(v)
        structs.append(F.struct(F.lit(c).alias("column"), v.alias("value")))
    kept = [F.col(side).alias("side")] if side else []
    return (
        df.select(*kept, F.explode(F.array(*structs)).alias("cell"))
        .select(*(["side"] if side else []), "cell.column", "cell.value")
        .filter(F.col("value").isNotNull())
    )


def melt_numbers(df: DataFrame, columns: Sequence[str], side: str | None = None) -> DataFrame:
    """(column, value double[, side]) rows; NULL and NaN are dropped."""
    structs = [
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value"))
        for c in columns
    ]
    kept = [F.col(side).alias("side")] if side else []
    return (
        df.select(*kept, F.explode(F.array(*structs)).alias("cell"))
        .select(*(["side"] if side else []), "cell.column", "cell.value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
    )


def value_frequencies(
    df: DataFrame, columns: Sequence[str], side: str | None = None, keys: bool = False
) -> DataFrame:
    """(column[, side], value, n): how often each value occurs."""
    by = ["column", "value"] + (["side"] if side else [])
    return melt(df, columns, side, keys).groupBy(*by).agg(F.count("*").alias("n"))


def top_values(freq: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent values per column; ties go to the lower value.

    A window with a rank filter keeps only k rows per task before the shuffle
    (group-limit pruning), so a column with billions of values is no bottleneck.
    """
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        freq.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("column", "rank", "value", "n")
    )


def frequency_summary(freq: DataFrame) -> DataFrame:
    """Per column: non-missing count, distinct count and the largest count."""
    return freq.groupBy("column").agg(
        F.sum("n").alias("n_values"),
        F.count("*").alias("n_distinct"),
        F.max("n").alias("top_count"),
    )


def normalized_entropy(freq: DataFrame) -> DataFrame:
    """Shannon entropy per column divided by log2 of the distinct count (1 if a single value)."""
    totals = freq.groupBy("column").agg(
        F.sum("n").alias("n_values"), F.count("*").alias("n_distinct")
    )
    p = F.col("n") / F.col("n_values")
    divisor = F.when(F.col("n_distinct") > 1, F.log2(F.col("n_distinct"))).otherwise(F.lit(1.0))
    # one row per column on the totals side
    return (
        freq.join(F.broadcast(totals), "column")
        .groupBy("column", "n_values", "n_distinct")
        .agg((-F.sum(p * F.log2(p + F.lit(1e-12)))).alias("entropy_bits"))
        .select("column", "n_values", "n_distinct", "entropy_bits",
                (F.col("entropy_bits") / divisor).alias("entropy"))
    )


def present_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a missing key."""
    types = {f.name: f.dataType for f in df.schema.fields}
    for k in keys:
        df = df.filter(not_nan(F.col(f"`{k}`"), types[k]).isNotNull())
    return df


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group sizes on keys; rows with a missing key are left out."""
    return present_rows(df, keys).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("group_size"))


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key combination occurs once.

    Counting first and joining the single-row groups back keeps a hot key from being
    collected into one window partition. Only keys, not rows, go through the count.
    """
    valid = [k for k in keys if k in df.columns] or list(df.columns)
    singles = group_sizes(df, valid).filter(F.col("group_size") == 1).drop("group_size")
    return df.join(singles, on=valid, how="left_semi").select(*df.columns)


def rows_in_rare_groups(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Rows whose group has fewer than k members (rows with a missing key are not listed)."""
    small = group_sizes(df, keys).filter(F.col("group_size") < k).drop("group_size")
    return df.join(small, on=list(keys), how="left_semi").select(*df.columns)


def category_pairs(df: DataFrame, group: str, member: str) -> DataFrame:
    """The set of members of each group, as distinct (group, member) rows.

    Kept as rows, so that a group with very many members is no single cell in one task.
    """
    return (
        df.select(group, member)
        .filter(F.col(group).isNotNull() & F.col(member).isNotNull())
        .distinct()
    )
