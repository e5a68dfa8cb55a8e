"""Draws from the user's own lists (names, streets, cities by region), kept as tables of any size.

A pool is the set of distinct values under one key. Values are numbered in their pool by the order of their
MD5, so neither partitions nor row order change a draw.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintable.operators.prefix import running_span
from twintable.session import durable

#: Values up to which a pool is an array; a longer one spreads its draws over more keys than this.
SHORT = 256
#: Rows of a list of pools, and values of all long pools, up to which a side is broadcast.
BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class Pools:
    """sizes: pool, size and, for short pools, their values; members: pool, number (from 0), value of long ones."""

    sizes: DataFrame
    members: DataFrame


def index_pools(table: DataFrame, value: str, pool: str | None = None) -> Pools:
    """Numbers the values of each pool; repeated and null values, and rows without a pool, are left out.

    Without ``pool`` the table is one pool, with the empty key.
    """
    key = F.col(f"`{pool}`").cast("string") if pool else F.lit("")
    own = table.select(key.alias("pool"), F.col(f"`{value}`").cast("string").alias("value")).dropna().distinct()
    numbered = durable(
        running_span(own.withColumn("one", F.lit(1)), "one", "value", ["pool"])
        .select("pool", F.col("span_lo").cast("long").alias("number"), "value")
    )
    counts = numbered.groupBy("pool").agg(F.count("*").alias("size"))
    # no array is longer than SHORT: only the first numbers are gathered
    first = numbered.filter(F.col("number") < SHORT).groupBy("pool").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("number", "value"))), lambda x: x["value"]).alias("values"))
    sizes = counts.join(first, "pool").withColumn("values", F.when(F.col("size") <= SHORT, F.col("values")))
    sizes = durable(sizes)
    return Pools(sizes, numbered.join(_by_size(sizes.filter("values IS NULL").select("pool")), "pool", "left_semi"))


def _by_size(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def draw_from_pools(
    rows: DataFrame, name: str, pools: Pools, u: Column, pool: Column | None = None, default: str | None = None
) -> DataFrame:
    """Adds or replaces ``name``: a value of the row's pool, each equally likely.

    A row whose pool is null or unknown draws from the pool ``default``, and gets NULL if that is not there
    either. A short pool comes along as an array; a draw from a long one is an equi-join on pool and number,
    which spreads the rows of a hot pool evenly.
    """
    keep = [c for c in rows.columns if c != name]
    order = rows.columns if name in rows.columns else [*rows.columns, name]
    sizes = pools.sizes.select(F.col("pool").alias("_pool"), F.col("size").alias("_size"), F.col("values").alias("_values"))
    known = _by_size(sizes)
    asked = rows.select(*[F.col(f"`{c}`") for c in keep], (pool if pool is not None else F.lit("")).cast("string").alias("_asked"),
                        u.alias("_u"))
    found = asked.join(known, F.col("_asked") == F.col("_pool"), "left")
    if default is not None:
        spare = sizes.filter(F.col("_pool") == default).select(*[F.col(c).alias(f"{c}_spare") for c in sizes.columns])
        # one row at most
        found = found.join(F.broadcast(spare), F.col("_pool").isNull(), "left").select(
            *[F.col(f"`{c}`") for c in keep], "_u",
            *[F.when(F.col("_pool").isNull(), F.col(f"{c}_spare")).otherwise(F.col(c)).alias(c) for c in sizes.columns])
    at = F.floor(F.col("_u") * F.col("_size").cast("double")).cast("long")
    # the number is only asked for where the pool is long
    marked = found.withColumn("_number", F.when(F.col("_values").isNull(), at)).withColumn(
        "_short", F.get(F.col("_values"), at.cast("int")))
    long_ones = _by_size(pools.members.select(
        F.col("pool").alias("_of"), F.col("number").alias("_at"), F.col("value").alias("_long")))
    drawn = marked.join(long_ones, (F.col("_pool") == F.col("_of")) & (F.col("_number") == F.col("_at")), "left")
    picked = F.coalesce("_short", "_long")
    return drawn.select(*[picked.alias(c) if c == name else F.col(f"`{c}`") for c in order])
