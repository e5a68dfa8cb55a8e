"""Numeric columns: fits, goodness of fit, sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintable.functions import numbers as num
from twintable.functions.draw import Draws, exponential, gamma
from twintable.operators.aggregates import correlation_pairs
from twintable.operators.columns import has_token, rows_from_wide, small_copy
from twintable.operators.ecdf import one_sample_ks
from twintable.operators.quantiles import clean_number, quantile_values

FAMILIES = ["normal", "uniform", "exponential", "lognormal", "gamma"]
# Name words of money columns and their least amount.
MONEY_WORDS = ("amount", "price", "cost", "value", "total", "balance")
MONEY_FLOOR = 10.0


def fit_parameters(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with the closed-form parameters of all five families.

    The gamma shape is the usual approximation of the likelihood solution from mean and mean
    log (Minka 2002). One scan for all columns.
    """
    aggs, structs = [], []
    for i, name in enumerate(columns):
        c = clean_number(df, name)
        log = F.log(F.when(c > 0, c))
        parts = {
            "n": F.count(c), "mean": F.avg(c), "std": F.stddev_pop(c), "min": F.min(c),
            "max": F.max(c), "log_mean": F.avg(log), "log_std": F.stddev_pop(log),
            "pos_mean": F.avg(F.when(c > 0, c)), "is_integer": F.bool_and(c % 1 == 0),
        }
        aggs += [v.alias(f"c{i}_{k}") for k, v in parts.items()]
        structs.append(
            F.struct(F.lit(name).alias("column"), *[F.col(f"c{i}_{k}").alias(k) for k in parts])
        )
    s = F.log(F.col("pos_mean")) - F.col("log_mean")
    shape = (3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)
    return rows_from_wide(df.agg(*aggs), structs).withColumn(
        "gamma_shape", F.when((F.col("min") >= 0) & (s > 1e-12), shape)
    ).withColumn("gamma_scale", F.col("pos_mean") / F.col("gamma_shape"))


def without_outliers(df: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """``remove`` turns values outside the quartile fences into NULL, ``clip`` moves them there."""
    if how not in ("remove", "clip"):
        raise ValueError(f"unknown outlier handling: {how}")
    quartiles = quantile_values(df, columns, [0.25, 0.75])
    changed = {}
    for name, (q1, q3) in quartiles.items():
        if q1 is None:
            continue
        c = clean_number(df, name)
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        changed[name] = F.when(c.between(low, high), c) if how == "remove" else num.clip(c, low, high)
    return df.withColumns(changed) if changed else df


def _cdfs() -> dict[str, Column]:
    """Distribution functions over ``value`` and the parameter columns; NULL where undefined."""
    x = F.col("value")
    spread = F.col("max") - F.col("min")
    return {
        "normal": F.when(F.col("std") > 0, num.normal_cdf((x - F.col("mean")) / F.col("std"))),
        "uniform": F.when(spread > 0, num.unit_interval((x - F.col("min")) / spread)),
        "exponential": F.when(
            F.col("mean") > 0,
            F.when(x > 0, 1 - F.exp(-x / F.col("mean"))).otherwise(F.lit(0.0)),
        ),
        "lognormal": F.when(
            F.col("log_std") > 0,
            F.when(x > 0, num.normal_cdf((F.log(x) - F.col("log_mean")) / F.col("log_std")))
            .otherwise(F.lit(0.0)),
        ),
        "gamma": num.gamma_cdf(x, F.col("gamma_shape"), F.col("gamma_scale")),
    }


def fit_scores(df: DataFrame, columns: Sequence[str], parameters: DataFrame) -> DataFrame:
    """(column, family, ks, score): fit of every family to every column, all in one pass."""
    return one_sample_ks(df, columns, parameters, _cdfs()).select(
        "column", "family", "ks", (1 - F.col("ks")).alias("score")
    )


def best_fit(
    df: DataFrame, columns: Sequence[str], parameters: DataFrame | None = None
) -> DataFrame:
    """Parameters plus ``family`` and ``score``: the family nearest to the data per column.

    A column no family is defined for (a constant) falls back to the normal one.
    """
    if parameters is None:
        parameters = small_copy(fit_parameters(df, columns))
    order = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family"))
    chosen = fit_scores(df, columns, parameters).filter(F.col("score").isNotNull()).groupBy(
        "column"
    ).agg(
        F.max_by("family", F.struct("score", -order)).alias("family"), F.max("score").alias("score")
    )
    return parameters.join(F.broadcast(chosen), "column", "left").fillna({"family": "normal"})


def sample(family: str, p: Mapping, draws: Draws) -> Column:
    """One draw from a fitted family."""
    if family == "normal":
        return F.lit(float(p["mean"])) + F.lit(float(p["std"] or 0.0)) * draws.normal()
    if family == "uniform":
        return F.lit(float(p["min"])) + draws(0) * F.lit(float(p["max"] - p["min"]))
    if family == "exponential":
        return exponential(draws(0), p["mean"])
    if family == "lognormal":
        return F.exp(F.lit(float(p["log_mean"])) + F.lit(float(p["log_std"])) * draws.normal())
    if family == "gamma":
        return gamma(draws, float(p["gamma_shape"]), float(p["gamma_scale"]))
    raise ValueError(f"unknown distribution: {family}")


def numeric_column(
    name: str,
    family: str,
    p: Mapping,
    row_id: Column,
    seed: int,
    is_integer: bool,
    method: str = "md5",
    decimals: int | None = None,
    enforce_range: bool = True,
) -> Column:
    """Draw, money floor, range limit, rounding; integer ids just count on."""
    if is_integer and has_token(name, "id"):
        return row_id + F.lit(1)
    x = sample(family, p, Draws(seed, name, row_id, method))
    if has_token(name, *MONEY_WORDS):
        x = num.money_floor(x, MONEY_FLOOR)
    if enforce_range:
        x = num.clip(x, float(p["min"]), float(p["max"]))
    if is_integer:
        return num.round_half_even(x)
    return F.round(x, decimals) if decimals is not None else x


KNOTS = 257


def correlated_columns(
    df: DataFrame, columns: Sequence[str], row_id: Column, seed: int, method: str = "md5",
    knots: int = KNOTS,
) -> dict[str, Column]:
    """Expressions that keep the correlations of the reference (Gaussian copula).

    The small correlation matrix is factored on the driver; each row mixes its own normals and
    maps them through the empirical quantiles, so the plan stays a projection over the rows.
    """
    index = {c: i for i, c in enumerate(columns)}
    matrix = np.eye(len(columns))
    for r in correlation_pairs(df, columns).collect():
        if r["corr"] is not None:
            matrix[index[r["column_a"]], index[r["column_b"]]] = r["corr"]
    # pairwise-complete matrices need not be positive definite
    values, vectors = np.linalg.eigh(matrix)
    fixed = vectors @ np.diag(np.maximum(values, 1e-9)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    lower = np.linalg.cholesky(fixed / np.outer(scale, scale))
    probs = [i / (knots - 1) for i in range(knots)]
    curve = quantile_values(df, columns, probs)
    normals = [Draws(seed, f"{c}|copula", row_id, method).normal() for c in columns]
    out = {}
    for c, i in index.items():
        if curve[c][0] is None:
            out[c] = F.lit(None).cast("double")
            continue
        mixed = F.lit(0.0)
        for j in range(i + 1):
            mixed = mixed + F.lit(float(lower[i, j])) * normals[j]
        position = num.normal_cdf(mixed) * F.lit(float(knots - 1))
        at = F.least(F.floor(position), F.lit(knots - 2)).cast("int")
        points = F.array(*[F.lit(float(v)) for v in curve[c]])
        low, high = F.get(points, at), F.get(points, at + 1)
        out[c] = low + (high - low) * (position - at)
    return out

