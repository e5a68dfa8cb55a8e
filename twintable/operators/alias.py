"""Draws from long weighted lists in one joined row each, by an alias table that is built without a loop.

Every one of n values gets a cell of the same weight W / n. A value lighter than that leaves a gap in its cell, a heavier
one has a surplus, and each gap is filled by one heavy value. Laying all gaps end to end, and all surpluses beside them,
both in a fixed order, tells which heavy value fills which gap: the one whose stretch of surplus holds the start
of the gap. Where a gap runs past the end of that stretch, the heavy value has given away part of its own cell, and
the next heavy value makes up for it. So two running sums and one fill over their common order replace
the usual worklist, and no value, however heavy, has more than one cell of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintable.operators.fill import ROWS_PER_BUCKET, fill_forward
from twintable.operators.prefix import running_span

#: Weights are multiplied by the number of values, so that all shares are whole numbers.
WHOLE = "decimal(38,0)"


def alias_table(
    values: DataFrame, value: str, weight: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> tuple[DataFrame, int, int]:
    """(cells, n, W): one row per value with ``number`` (0 to n - 1), ``value``, ``keep`` and ``other``.

    Out of W draws that meet a cell, ``keep`` give its own value and the rest ``other``. Values are distinct and not
    null, weights whole numbers of at least 0 whose sum W is above 0. The order of cells is fixed by the
    MD5 of the values, so neither partitions nor row order change a draw.
    """
    size = values.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(weight).cast(WHOLE)).alias("w")).first()
    n, total = size["n"], int(size["w"] or 0)
    if total <= 0:
        raise ValueError("weights must add up to more than zero")
    whole = F.lit(str(total)).cast(WHOLE)
    gap = F.col(weight).cast(WHOLE) * F.lit(n).cast(WHOLE) - whole
    split = values.select(
        F.col(value).alias("value"), (gap >= 0).alias("heavy"), F.abs(gap).cast(WHOLE).alias("gap"), F.lit(1).alias("one")
    )
    placed = running_span(split, "one", "value", ["heavy"]).withColumn("place", F.col("span_lo").cast("long"))
    sums = running_span(placed.drop("span_lo", "span_hi", "one"), "gap", "value", ["heavy"]).select(
        "value", "heavy", "gap", F.col("span_lo").alias("lo"), F.col("span_hi").alias("hi"),
        # light values from the front, heavy ones from the back: neither needs to know how many the other has
        F.when(F.col("heavy"), n - 1 - F.col("place")).otherwise(F.col("place")).alias("number"),
    )
    light, heavy = sums.filter("NOT heavy"), sums.filter("heavy")
    unknown = F.lit(None)
    # at the same position the end of a surplus comes first, then the start of one, then the start of a gap
    ends = heavy.select(F.col("hi").alias("at"), F.lit(0).alias("kind"), "number", "value", "hi",
                        unknown.cast(values.schema[value].dataType).alias("giver"), unknown.cast(WHOLE).alias("reach"))
    starts = heavy.filter("gap > 0").select(F.col("lo").alias("at"), F.lit(1).alias("kind"), "number", "value", "hi",
                                            F.col("value").alias("giver"), unknown.cast(WHOLE).alias("reach"))
    gaps = light.select(F.col("lo").alias("at"), F.lit(2).alias("kind"), "number", "value", "hi",
                        unknown.cast(values.schema[value].dataType).alias("giver"), F.col("hi").alias("reach"))
    line = fill_forward(ends.union(starts).union(gaps), ["giver", "reach"], ["at", "kind", "number"],
                        rows_per_bucket=rows_per_bucket)
    filled = line.filter("kind = 2").select(
        "number", "value", (whole - (F.col("reach") - F.col("at"))).cast(WHOLE).alias("keep"), F.col("giver").alias("other"))
    following = heavy.select((F.col("number") + 1).alias("number"), F.col("value").alias("other"))
    given = line.filter("kind = 0").select(
        "number", "value", (whole - F.coalesce(F.col("reach") - F.col("hi"), F.lit(0).cast(WHOLE))).cast(WHOLE).alias("keep"))
    return filled.unionByName(given.join(following, "number", "left")), n, total


def pick_by_alias(
    df: DataFrame, cell: Column, side: Column, values: DataFrame, value: str, weight: str, name: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Adds ``name``: a value drawn with probability weight / sum, from two uniform draws a row.

    The first chooses a cell, the second a side of it. Rows spread evenly over cells whatever the weights, so
    the equi-join has no hot key, and each row meets exactly one cell.
    """
    table, n, total = alias_table(values, value, weight, rows_per_bucket)
    cells = table.select(
        F.col("number").alias("_cell"), (F.col("keep").cast("double") / F.lit(float(total))).alias("_keep"),
        F.col("value").alias("_own"), F.col("other").alias("_other"))
    marked = df.withColumns({"_cell": F.floor(cell * F.lit(float(n))).cast("long"), "_side": side})
    chosen = F.when(F.col("_side") < F.col("_keep"), F.col("_own")).otherwise(F.col("_other"))
    return marked.join(cells, "_cell").select(*[F.col(f"`{c}`") for c in df.columns], chosen.alias(name))
