"""Numeric expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_number(c: Column) -> Column:
    """Numeric coercion; what does not parse becomes NULL."""
    return c.try_cast("double")


# A text with one of these is no number: a letter or sign that none has, a sign or gap between digits.
_NO_NUMBER = r"[^0-9A-FXPINTYa-fxpinty+.\x00-\x20\x7F-]|[0-9.][ +-]+[0-9.]"


def text_to_number(c: Column) -> Column:
    """``to_number`` of a text. Most texts that are none never reach the parser, which builds an exception per miss."""
    return F.when(~c.rlike(_NO_NUMBER), to_number(c))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    out = c
    if low is not None:
        out = F.when(c.isNotNull(), F.greatest(out, F.lit(low)))
    if high is not None:
        out = F.when(c.isNotNull(), F.least(out, F.lit(high)))
    return out


def round_half_even(c: Column) -> Column:
    """Nearest integer, ties to even, as a long."""
    return F.rint(c).cast("long")


def money_floor(c: Column, least: float = 10.0) -> Column:
    """Absolute value, but at least ``least``."""
    return F.greatest(F.abs(c), F.lit(least))


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / (F.abs(a) + F.lit(1e-9))


def unit_interval(c: Column) -> Column:
    """Clip a score to [0, 1], keeping NULL."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def not_nan(c: Column, dtype: T.DataType) -> Column:
    """NaN counts as missing in floating columns."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def plain_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a value without exponents, so that patterns see ``12345678.5``."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)  # minus zero equals zero
        wide = F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
        return F.when(F.abs(c).between(1e7, 1e26), wide).otherwise(c.cast("string"))
    return c.cast("string")


# Coefficients of the double-precision rational approximation of the
# normal distribution function (Hart 1968, as given by West 2005).
_HART_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_HART_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function as a native expression."""
    a = F.abs(x)
    top, bottom = F.lit(_HART_TOP[0]), F.lit(_HART_BOTTOM[0])
    for k in _HART_TOP[1:]:
        top = top * a + F.lit(k)
    for k in _HART_BOTTOM[1:]:
        bottom = bottom * a + F.lit(k)
    near = F.exp(-a * a / 2.0) * top / bottom
    tail = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    far = F.exp(-a * a / 2.0) / (tail * F.lit(2.506628274631))
    upper = (
        F.when(a > 37.0, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    )
    return F.when(x > 0, F.lit(1.0) - upper).otherwise(upper)


def gamma_cdf(x: Column, shape: Column, scale: Column) -> Column:
    """Regularized lower incomplete gamma function; Spark has none, so an Arrow batch function.

    NULL where value or parameters are missing.
    """

    @F.pandas_udf("double")
    def evaluate(values: pd.Series, shapes: pd.Series, scales: pd.Series) -> pd.Series:
        a = shapes.to_numpy(dtype=float)
        z = np.maximum(values.to_numpy(dtype=float), 0.0) / scales.to_numpy(dtype=float)
        out = np.full(len(z), np.nan)
        known = ~(np.isnan(a) | np.isnan(z))
        distinct, back = np.unique(np.where(known, a, 1.0), return_inverse=True)
        log_gamma = np.array([math.lgamma(s) for s in distinct])[back]
        out[known & (z == 0)] = 0.0
        large = known & (z > 0) & (a > LARGE_SHAPE)
        low = known & (z > 0) & ~large & (z < a + 1.0)
        high = known & ~large & (z >= a + 1.0)
        with np.errstate(all="ignore"):
            if large.any():
                out[large] = _gamma_uniform(z[large], a[large])
            if low.any():
                out[low] = _gamma_series(z[low], a[low], log_gamma[low])
            if high.any():
                out[high] = 1.0 - _gamma_fraction(z[high], a[high], log_gamma[high])
        return pd.Series(out).where(known)

    return evaluate(x, shape, scale)


#: Above this shape the uniform expansion is exact to double precision; below it the series
#: and the fraction settle within LAST_TERM terms.
LARGE_SHAPE, LAST_TERM = 1e4, 20_000

# Coefficients of the first two terms of Temme's uniform expansion around eta = 0.
_TEMME_0 = (-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835, -139 / 777600, 1 / 25515)
_TEMME_1 = (-1 / 540, -1 / 288, 25 / 12096 + 1 / 1728, -0.00099022633744855967, 0.00020576131687242798)


def _gamma_uniform(z: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Temme's expansion for large shapes: a normal distribution with a small correction."""
    mu = (z - a) / a
    near = np.abs(mu) < 1e-2
    # mu - log(1 + mu), by its series where the difference would cancel
    series = np.zeros_like(mu)
    for k in range(12, 1, -1):
        series = (1.0 / k if k % 2 == 0 else -1.0 / k) + mu * series
    half = np.where(near, mu * mu * series, mu - np.log1p(mu))
    eta = np.sign(mu) * np.sqrt(2.0 * np.maximum(half, 0.0))
    safe_eta, safe_mu = np.where(near, 1.0, eta), np.where(near, 1.0, mu)
    c0 = np.where(near, np.polyval(_TEMME_0[::-1], eta), 1 / safe_mu - 1 / safe_eta)
    c1 = np.where(near, np.polyval(_TEMME_1[::-1], eta),
                  1 / safe_eta**3 - 1 / safe_mu**3 - 1 / safe_mu**2 - 1 / (12 * safe_mu))
    x = -eta * np.sqrt(a / 2.0)
    middle = 0.5 * np.array([math.erfc(v) for v in x])
    return middle - np.exp(-a * np.maximum(half, 0.0)) / np.sqrt(2 * np.pi * a) * (c0 + c1 / a)


def _gamma_series(z: np.ndarray, a: np.ndarray, log_gamma: np.ndarray) -> np.ndarray:
    """Power series, quick below the mode."""
    term = 1.0 / a
    total = term.copy()
    for n in range(1, LAST_TERM):
        term = term * z / (a + n)
        total = total + term
        if (term < total * 1e-16).all():
            break
    else:
        raise ArithmeticError("the series of the gamma distribution did not settle")
    return total * np.exp(-z + a * np.log(z) - log_gamma)


def _gamma_fraction(z: np.ndarray, a: np.ndarray, log_gamma: np.ndarray) -> np.ndarray:
    """Continued fraction of the upper tail, evaluated front to back."""
    tiny = 1e-300
    b = z + 1.0 - a
    c = np.full_like(z, 1.0 / tiny)
    d = 1.0 / b
    h = d.copy()
    for n in range(1, LAST_TERM):
        an = -n * (n - a)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        if (np.abs(d * c - 1.0) < 1e-14).all():
            break
    else:
        raise ArithmeticError("the fraction of the gamma distribution did not settle")
    return h * np.exp(-z + a * np.log(z) - log_gamma)
