"""Single-pass aggregates over many columns at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintable.functions.numbers import not_nan
from twintable.operators.columns import rows_from_wide, rows_per_column
from twintable.operators.quantiles import clean_number


def sample_skewness(c: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population one; NULL below three values, 0 if constant."""
    nd = n.cast("double")
    return F.when(n < 3, F.lit(None)).otherwise(
        F.when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(
            F.skewness(c) * F.sqrt(nd * (nd - 1)) / (nd - 2)
        )
    )


def sample_kurtosis(c: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values, 0 if constant."""
    nd = n.cast("double")
    return F.when(n < 4, F.lit(None)).otherwise(
        F.when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(
            ((nd + 1) * F.kurtosis(c) + 6) * (nd - 1) / ((nd - 2) * (nd - 3))
        )
    )


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: count, min, max, mean, std, variance, shape and sign flags."""
    per_column = []
    for i, name in enumerate(columns):
        c = clean_number(df, name)
        n = F.count(c)
        parts = {
            "n": n,
            "min": F.min(c),
            "max": F.max(c),
            "mean": F.avg(c),
            "std": F.stddev_samp(c),
            "variance": F.var_samp(c),
            "skewness": sample_skewness(c, n),
            "kurtosis": sample_kurtosis(c, n),
            "is_integer": F.bool_and(c % 1 == 0),
            "is_positive": F.bool_and(c > 0),
        }
        row = F.struct(F.lit(name).alias("column"), *[F.col(f"c{i}_{k}").alias(k) for k in parts])
        per_column.append(([v.alias(f"c{i}_{k}") for k, v in parts.items()], [row]))
    return rows_per_column(df, per_column)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, missing cells and completeness, in one scan."""
    columns = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count("*").alias("rows")] + [
        F.count(not_nan(F.col(f"`{c}`"), types[c])).alias(f"c{i}") for i, c in enumerate(columns)
    ]
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("rows").alias("total_count"),
            (F.col("rows") - F.col(f"c{i}")).alias("null_count"),
            F.when(F.col("rows") > 0, F.col(f"c{i}") / F.col("rows")).otherwise(F.lit(0.0))
            .alias("completeness"),
        )
        for i, c in enumerate(columns)
    ]
    return rows_from_wide(df.agg(*aggs), structs)


def frame_totals(df: DataFrame) -> DataFrame:
    """Rows, columns and missing cells of the whole table."""
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [
        F.count_if(not_nan(F.col(f"`{c}`"), types[c]).isNull()) for c in df.columns
    ]
    total = missing[0]
    for m in missing[1:]:
        total = total + m
    return df.agg(
        F.count("*").alias("total_rows"),
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
        total.alias("missing_cells"),
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_a, column_b, corr) over the full matrix, pairwise-complete like pandas.

    Two scans however many columns there are: one for the means, one in which each task multiplies
    the matrix of deviations and that of known cells with each other, a batch of rows at a time. What a
    task hands on is one row of sums per pair of columns.
    """
    names = [f"v{i}" for i in range(len(columns))]
    clean = df.select(*[clean_number(df, c).cast("double").alias(n) for c, n in zip(columns, names)])
    width = 40
    means: dict[str, float] = {}
    for at in range(0, len(names), width):
        means |= clean.agg(*[F.avg(n).alias(n) for n in names[at:at + width]]).first().asDict()
    centre = np.array([means[n] or 0.0 for n in names])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = batch.to_numpy(np.float64)
            known = ~np.isnan(x)
            x = np.where(known, x - centre, 0.0)
            mask = known.astype(np.float64)
            part = np.stack((mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x))
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(centre))
            n, one, square, cross = total
            yield pd.DataFrame({
                "i": i.astype(np.int32), "j": j.astype(np.int32), "n": n[i, j], "sx": one[i, j], "sy": one[j, i],
                "sxx": square[i, j], "syy": square[j, i], "sxy": cross[i, j],
            })

    parts = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    pairs = clean.mapInPandas(sums, "i int, j int, " + ", ".join(f"{p} double" for p in parts))
    pairs = pairs.groupBy("i", "j").agg(*[F.sum(p).alias(p) for p in parts])
    at = F.array(*[F.lit(float(c)) for c in centre])

    def spread(total: str, squares: str, place: str) -> Column:
        value = F.col(squares) - F.col(total) * F.col(total) / F.col("n")
        # below what doubles of this size can tell apart
        least = F.col("n") * F.pow(F.abs(F.get(at, F.col(place))) * 1e-14, F.lit(2.0))
        return F.when(value > least, value)

    dx, dy = spread("sx", "sxx", "i"), spread("sy", "syy", "j")
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(dx * dy)
    r = F.when(F.col("n") > 0, F.when(F.col("i") == F.col("j"), dx / dx).otherwise(r))
    label = F.array(*map(F.lit, columns))
    cells = pairs.withColumn("corr", F.when(~F.isnan(r), r))
    mirrored = cells.select("i", "j", "corr").unionByName(
        cells.filter("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
    return mirrored.select(F.get(label, F.col("i")).alias("column_a"), F.get(label, F.col("j")).alias("column_b"), "corr")


def deterministic_mode(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value of a column (lowest on ties), overall or per group.

    Counts come first, so the final pick sees one row per distinct value and a hot group
    costs no more than its distinct values.
    """
    keys = [F.col(f"`{b}`") for b in by]
    counts = (
        df.filter(F.col(f"`{column}`").isNotNull())
        .groupBy(*keys, F.col(f"`{column}`").alias("_value")).agg(F.count("*").alias("_n"))
    )
    # smallest struct = highest count, then lowest value
    best = F.min(F.struct((-F.col("_n")).alias("rank"), F.col("_value").alias("value")))
    return counts.groupBy(*keys).agg(best.alias("best")).select(
        *keys, F.col("best.value").alias("mode"), (-F.col("best.rank")).alias("n")
    )
