"""Seeded draws that depend only on (seed, column name, draw number, row id).

``rand(seed)`` depends on the partition layout; these do not, so a fabricated
table is the same with any number of partitions and after any task retry.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(2**52)
_TWO_M53 = 2.0**-53


def uniform(
    seed: int, name: str, row_id: Column, draw: int | Column = 0, method: str = "md5"
) -> Column:
    """Uniform double in [0, 1). ``md5`` can be replayed by any SQL engine, ``xxhash64`` is faster."""
    if method == "md5":
        if isinstance(draw, Column):
            key = F.concat(
                F.lit(f"{seed}|{name}|"), draw.cast("string"), F.lit("|"), row_id.cast("string")
            )
        else:
            key = F.concat(F.lit(f"{seed}|{name}|{draw}|"), row_id.cast("string"))
        return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(_TWO_52)
    if method == "xxhash64":
        step = draw if isinstance(draw, Column) else F.lit(int(draw))
        bits = F.shiftrightunsigned(F.xxhash64(row_id, F.lit(f"{seed}|{name}"), step), 11)
        return bits.cast("double") * F.lit(_TWO_M53)
    raise ValueError(f"unknown draw method: {method}")


class Draws:
    """Draws of one column: ``Draws(seed, 'email', row_id)(0)`` is its first uniform."""

    def __init__(self, seed: int, name: str, row_id: Column, method: str = "md5"):
        self.seed, self.name, self.row_id, self.method = seed, name, row_id, method

    def __call__(self, draw: int | Column = 0) -> Column:
        return uniform(self.seed, self.name, self.row_id, draw, self.method)

    def normal(self, draw: int = 0) -> Column:
        return standard_normal(self(draw), self(draw + 1))


def integer_between(u: Column, low: int, high: int) -> Column:
    """Integer in [low, high], both ends included."""
    return F.lit(int(low)) + F.floor(u * F.lit(float(high - low + 1))).cast("long")


def literal_array(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pick(values: Sequence, u: Column) -> Column:
    """One of a short list of literals, each equally likely."""
    if not values:
        raise ValueError("nothing to pick from")
    return F.get(literal_array(values), F.floor(u * F.lit(float(len(values)))).cast("int"))


def pick_from(array: Column, u: Column) -> Column:
    """One element of an array column, each equally likely; NULL for an empty array."""
    return F.get(array, F.floor(u * F.size(array)).cast("int"))


def pick_weighted(values: Sequence, counts: Sequence[int], u: Column) -> Column:
    """One of the literals with probability count / sum(counts), by inverse CDF.

    Integer thresholds avoid rounding trouble; the comparison tree is O(log n) per row
    and stays inside generated code.
    """
    bounds, running = [], 0
    for c in counts:
        running += int(c)
        bounds.append(running)
    if running <= 0:
        raise ValueError("weights must add up to more than zero")
    target = F.floor(u * F.lit(float(running))).cast("long")

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(values[lo])
        mid = (lo + hi) // 2
        return F.when(target < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds) - 1)


def standard_normal(u1: Column, u2: Column) -> Column:
    """Box-Muller transform of two uniforms."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def exponential(u: Column, scale: float) -> Column:
    return F.lit(-float(scale)) * F.log(F.lit(1.0) - u)


GAMMA_TRIES = 24


def gamma(draws: Draws, shape: float, scale: float) -> Column:
    """Gamma draw by squeeze-free rejection (Marsaglia and Tsang 2000).

    Every try is accepted with probability above 0.95, so two dozen tries leave a
    chance below 1e-31 of taking the last candidate as it is.
    """
    boosted = shape if shape >= 1.0 else shape + 1.0
    d = boosted - 1.0 / 3.0
    c = 1.0 / math.sqrt(9.0 * d)

    def attempt(i: Column) -> Column:
        z = standard_normal(draws(i * 3), draws(i * 3 + 1))
        v = F.pow(F.lit(1.0) + F.lit(c) * z, F.lit(3.0))
        log_v = F.log(F.when(v > 0, v))
        ok = F.log(F.lit(1.0) - draws(i * 3 + 2)) < (
            F.lit(0.5) * z * z + F.lit(d) - F.lit(d) * v + F.lit(d) * log_v
        )
        return F.when((v > 0) & ok, v)

    chosen = F.aggregate(
        F.sequence(F.lit(0), F.lit(GAMMA_TRIES - 1)),
        F.lit(None).cast("double"),
        lambda acc, i: F.when(acc.isNotNull(), acc).otherwise(attempt(i)),
    )
    value = F.lit(d * scale) * F.coalesce(chosen, F.lit(1.0))
    if shape < 1.0:
        value = value * F.pow(F.lit(1.0) - draws(3 * GAMMA_TRIES), F.lit(1.0 / shape))
    return value
