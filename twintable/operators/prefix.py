"""Running sums within groups without one task per group, and picks by cumulative weight."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets are the first so many hex digits of the order's MD5.
BUCKET_DIGITS = 3
# Cells that a value lists at a time: a hot one touches a share of all cells.
CELLS_A_ROW = 4096


def running_span(
    df: DataFrame, weight: str, order: str, by: Sequence[str] = (), digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Adds ``span_lo`` and ``span_hi``: the half-open stretch of each row in the running weight.

    Rows are ordered by the MD5 of ``order``, as ``draw_order`` does for short lists: any fixed
    order will do for a draw. Sums run inside (group, bucket), where a bucket is a prefix of the
    MD5, so the number of buckets changes nothing; the bucket offsets are a short table.
    """
    keys = list(by)
    placed = df.withColumn("_h", F.md5(F.col(order).cast("string"))).withColumn("_b", F.substring("_h", 1, digits))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = placed.groupBy(*keys, "_b").agg(F.sum(weight).alias("_w")).select(
        *keys, "_b", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*keys, "_b").orderBy("_h", order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    upto = F.col("_offset") + F.sum(weight).over(within)
    joined = placed.join(offsets, [*keys, "_b"])
    return joined.withColumn("span_hi", upto).withColumn(
        "span_lo", F.col("span_hi") - F.col(weight)
    ).drop("_b", "_h", "_offset")


def draw_order(value: str) -> tuple[str, str]:
    """Sort key of a short list in memory that gives the order of ``running_span``."""
    return hashlib.md5(value.encode()).hexdigest(), value


def pick_by_span(
    df: DataFrame, u: Column, values: DataFrame, value: str, weight: str, name: str
) -> DataFrame:
    """Adds ``name``: a value drawn with probability weight / total, for long value lists.

    The running weight is cut into about as many cells as there are values. Each value lists
    the cells it touches, so the draw is an equi-join on the cell. A value with a third of the
    weight lists a third of the cells, some thousands in an array, and the drawn rows spread over
    all cells evenly. ``alias.pick_by_alias`` gives such a value a single cell.
    """
    size = values.agg(F.count("*").alias("n"), F.sum(weight).alias("w")).first()
    cells = max(1, size["n"])
    width = max(1, -(-size["w"] // cells))
    last = F.floor((F.col("span_hi") - 1) / width)
    blocks = running_span(values, weight, value).select(
        F.col(value).alias(name), "span_lo", "span_hi", last.alias("_last"),
        F.explode(
            F.sequence(F.floor(F.col("span_lo") / width), last, F.lit(CELLS_A_ROW).cast("long"))
        ).alias("_first"),
    )
    spans = blocks.select(
        name, "span_lo", "span_hi",
        F.explode(F.sequence("_first", F.least(F.col("_first") + CELLS_A_ROW - 1, "_last"))).alias("_cell"),
    )
    target = F.floor(u * F.lit(float(size["w"]))).cast("long")
    marked = df.withColumn("_target", target).withColumn(
        "_cell", F.floor(F.col("_target") / width)
    )
    inside = (F.col("_target") >= F.col("span_lo")) & (F.col("_target") < F.col("span_hi"))
    return (
        marked.alias("a").join(spans.alias("b"), (F.col("a._cell") == F.col("b._cell")) & inside)
        .select("a.*", name).drop("_cell", "_target")
    )
