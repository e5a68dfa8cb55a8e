"""Exact quantiles (linear interpolation) that do not need one task to hold a column.

``percentile`` keeps a map of distinct values in the final task and goes over it once for each
quantile. That is fine for a bounded number of both. Beyond the bound the distinct values are counted and
sorted into ranges, and the values at the wanted ranks are picked from the ranges that hold them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twintable.operators.columns import rows_from_wide
from twintable.session import durable

DISTINCT_LIMIT = 1_000_000
#: Quantiles that a task reads off ``DISTINCT_LIMIT`` distinct values; each goes over all of them.
MANY_PROBS = 16
_ACCURACY = 10_000


def clean_number(df: DataFrame, column: str) -> Column:
    """A numeric column as double with NaN as NULL."""
    dtype = df.schema[column].dataType
    c = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(c), c) if isinstance(dtype, (T.DoubleType, T.FloatType)) else c


def quantile_values(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    distinct_limit: int = DISTINCT_LIMIT,
) -> dict[str, list[float | None]]:
    """Exact quantiles on the driver: one short list per column."""
    numbers = {c: clean_number(df, c) for c in columns}
    sizes = df.agg(
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(numbers.values())],
        *[F.approx_count_distinct(v).alias(f"d{i}") for i, v in enumerate(numbers.values())],
    ).first()
    small = [c for i, c in enumerate(columns)
             if sizes[f"d{i}"] <= distinct_limit and sizes[f"d{i}"] * len(probs) <= distinct_limit * MANY_PROBS]
    out: dict[str, list[float | None]] = {}
    # one aggregate holds so many distinct values at most, over all of its columns
    groups: list[list[str]] = []
    held = distinct_limit
    for c in small:
        size = sizes[f"d{columns.index(c)}"]
        if not groups or held + size > distinct_limit:
            groups.append([])
            held = 0
        groups[-1].append(c)
        held += size
    for group in groups:
        row = df.agg(
            *[F.percentile(numbers[c], F.array(*map(F.lit, probs))).alias(f"q{i}")
              for i, c in enumerate(group)]
        ).first()
        for i, c in enumerate(group):
            out[c] = list(row[i]) if row[i] is not None else [None] * len(probs)
    large = {c: sizes[f"n{i}"] for i, c in enumerate(columns) if c not in out}
    if large:
        out.update(_by_rank(df, numbers, large, probs))
    return out


def _by_rank(
    df: DataFrame, numbers: dict[str, Column], counts: dict[str, int], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Quantiles of columns with many values, read off the distinct values in order.

    Only the rows per range, a short list, come to the driver: they tell which range holds each wanted rank.
    """
    cells = [F.struct(F.lit(i).alias("i"), numbers[c].alias("value")) for i, c in enumerate(counts)]
    values = (df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
              .groupBy("i", "value").agg(F.count("*").alias("n")))
    # kept, as ranges are cut by a sample and both reads below must see the same ones
    ordered = durable(values.repartitionByRange("i", "value").sortWithinPartitions("i", "value")
                      .withColumn("part", F.spark_partition_id()))
    places = {c: [(n - 1) * p for p in probs] for c, n in counts.items()}
    ranks = [np.unique([r for x in at for r in (math.floor(x), math.ceil(x))]) for at in places.values()]
    before = [0] * len(ranks)
    wanted: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    for part, i, n in ordered.groupBy("part", "i").agg(F.sum("n").alias("n")).orderBy("part", "i").collect():
        own = ranks[i][(ranks[i] >= before[i]) & (ranks[i] < before[i] + n)]
        if len(own):
            wanted[part, i] = before[i], own
        before[i] += n

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        for batch in batches:
            for (part, i), rows in batch.groupby(["part", "i"], sort=False):
                if (part, i) not in wanted:
                    continue
                start, asked = wanted[part, i]
                upto = seen.get(i, start) + np.cumsum(rows["n"].to_numpy())
                own = asked[(asked >= seen.get(i, start)) & (asked < upto[-1])]
                seen[i] = int(upto[-1])
                yield pd.DataFrame({"i": np.full(len(own), i, np.int32), "rank": own.astype(np.int64),
                                    "value": rows["value"].to_numpy()[np.searchsorted(upto, own, "right")]})

    # two rows a quantile at most
    found = {(i, r): v for i, r, v in ordered.mapInPandas(pick, "i int, rank long, value double").collect()}

    def between(i: int, at: float) -> float:
        low, high = found[i, math.floor(at)], found[i, math.ceil(at)]
        return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high

    return {c: [between(i, at) for at in places[c]] for i, c in enumerate(counts)}


def quantile_table(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    distinct_limit: int = DISTINCT_LIMIT,
) -> DataFrame:
    """(column, prob, value) rows of exact quantiles."""
    found = quantile_values(df, columns, probs, distinct_limit)
    rows = [(c, float(p), v) for c in columns for p, v in zip(probs, found[c])]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def approx_quantile_table(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = _ACCURACY
) -> DataFrame:
    """(column, prob, value) from the sketch alone: one scan, no exactness."""
    wide = df.agg(
        *[F.percentile_approx(clean_number(df, c), list(probs), accuracy).alias(f"q{i}")
          for i, c in enumerate(columns)]
    )
    structs = [
        F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("prob"),
                 F.get(F.col(f"q{i}"), F.lit(j)).alias("value"))
        for i, c in enumerate(columns)
        for j, p in enumerate(probs)
    ]
    return rows_from_wide(wide, structs)
