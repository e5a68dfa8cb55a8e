"""Forward and backward fill over an explicit row order.

A window over the whole table (or over a hot key) is one task. Rows are therefore cut into
ranges of the whole order tuple, whatever its types; each range fills itself, and takes what its own
start lacks from the last known value of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twintable.functions.numbers import not_nan
from twintable.session import durable

ROWS_PER_BUCKET = 1_000_000


def _cut(df: DataFrame, order_by: Sequence[str], rows_per_bucket: int) -> DataFrame:
    """Adds ``_bucket``, which follows the order, and ``_tie``, which orders rows that the order leaves equal.

    A range partitioner samples the order tuples themselves, so a common start of texts, a moment that many rows share, and rows without
    a position are spread like any others. Bounds are drawn anew each time a plan runs, so the cut table is
    checkpointed: all that follows sees the same ranges, after a lost task too.
    """
    n = max(1, df.count() // rows_per_bucket)
    if n == 1:
        return df.withColumns({"_bucket": F.lit(0), "_tie": F.lit(0).cast("long")})
    order = [F.col(f"`{o}`").asc() for o in order_by]
    tied = durable(df).withColumn("_tie", F.monotonically_increasing_id())
    return durable(tied.repartitionByRange(n, *order, F.col("_tie")).withColumn("_bucket", F.spark_partition_id()))


def _fill(df, columns, order_by, partition_by, backward, rows_per_bucket):
    keys = list(partition_by or [])
    types = {f.name: f.dataType for f in df.schema.fields}
    cut = _cut(df, order_by, rows_per_bucket)
    known = {c: not_nan(F.col(f"`{c}`"), types[c]) for c in columns}
    order = [*[F.col(f"`{o}`") for o in order_by], F.col("_tie")]
    stamp = F.struct(*order)
    edge = F.min_by if backward else F.max_by
    carried = cut.groupBy(*keys, "_bucket").agg(
        *[edge(v, F.when(v.isNotNull(), stamp)).alias(f"_edge_{i}")
          for i, v in enumerate(known.values())]
    )
    # A backward fill walks the reversed order: a frame that only grows costs one pass, one
    # that shrinks would be recomputed for every row.
    turn = (lambda c: c.desc()) if backward else (lambda c: c.asc())
    # one row per key and bucket: what the neighbours hand over
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(turn(F.col("_bucket")))
    w = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumns(
        {f"_carry_{i}": F.last(f"_edge_{i}", True).over(w) for i in range(len(columns))}
    ).drop(*[f"_edge_{i}" for i in range(len(columns))])
    # What is handed over enters each bucket as a row before all others: one window does the
    # rest, without joining anything to the table.
    handed = carried.select(
        *keys, "_bucket", F.lit(0).alias("_data"),
        *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(columns)],
    )
    both = cut.withColumn("_data", F.lit(1)).withColumns(known).unionByName(
        handed, allowMissingColumns=True
    )
    span = (
        Window.partitionBy(*keys, "_bucket").orderBy("_data", *map(turn, order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = both.withColumns({c: F.last(F.col(f"`{c}`"), True).over(span) for c in columns})
    return filled.filter(F.col("_data") == 1).select(*df.columns)


def fill_forward(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str],
    partition_by: Sequence[str] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Missing cells take the last known value before them in the given order."""
    return _fill(df, list(columns), list(order_by), partition_by, False, rows_per_bucket)


def fill_backward(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str],
    partition_by: Sequence[str] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Missing cells take the next known value after them in the given order."""
    return _fill(df, list(columns), list(order_by), partition_by, True, rows_per_bucket)
