"""Numeric column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
_DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def finite(x: Column) -> Column:
    """Double column with NaN and both infinities as null."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def number_from_text(x: Column) -> Column:
    """Text to double; anything that is not a finite decimal number is null."""
    text = x.cast("string")
    return finite(F.when(text.rlike(_DECIMAL_TEXT), text.try_cast("double")))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient; 0 when the denominator is within 1e-12 of zero; null when either is missing."""
    n, d = finite(numerator), finite(denominator)
    return F.when(n.isNotNull() & d.isNotNull(), F.when(F.abs(d) > EPS, finite(n / d)).otherwise(0.0))


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    n, d = finite(numerator), finite(denominator)
    return F.when(F.abs(d) > EPS, n / d)


def variation(std: Column, mean: Column) -> Column:
    """Coefficient of variation."""
    return safe_ratio(std, F.abs(mean))


def robust_scale(x: Column, median: Column, iqr: Column) -> Column:
    return (x - median) / F.when(F.abs(iqr) < 10 * 2.220446049250313e-16, F.lit(1.0)).otherwise(iqr)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def next_up(x: Column) -> Column:
    """Smallest double above ``x``: adds between half and one unit in the last place."""
    return F.when(x == 0.0, F.lit(4.9e-324)).otherwise(x + F.abs(x) * 1.1 * 2.0**-53)


def divide(numerator: Column, denominator: Column, empty: float | None = 0.0) -> Column:
    """Rate whose value is ``empty`` for a zero denominator."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(empty).cast("double"))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def reconstruction_score(errors: Column, mode: str) -> Column:
    """Row score from an array of reconstruction errors: mse, mae or top<k>_mse."""
    squared = F.transform(errors, lambda e: e * e)
    add = lambda a, b: a + b
    if mode == "mse":
        return F.aggregate(squared, F.lit(0.0), add) / F.size(errors)
    if mode == "mae":
        return F.aggregate(F.transform(errors, F.abs), F.lit(0.0), add) / F.size(errors)
    k = int(mode.removeprefix("top").removesuffix("_mse"))
    kept = F.slice(F.sort_array(squared, asc=False), 1, k)
    return F.aggregate(kept, F.lit(0.0), add) / F.least(F.lit(k), F.size(errors))


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0: a series below 2, a continued fraction from there on; exact to 1e-14."""
    two_by_root_pi, root_pi = 2.0 / math.sqrt(math.pi), math.sqrt(math.pi)
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("term"), x.alias("sum")),
        lambda acc, k: F.struct(
            (acc["term"] * 2.0 * x * x / (2.0 * k + 1.0)).alias("term"),
            (acc["sum"] + acc["term"] * 2.0 * x * x / (2.0 * k + 1.0)).alias("sum"),
        ),
        lambda acc: 1.0 - two_by_root_pi * F.exp(-x * x) * acc["sum"],
    )
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / 2.0 / acc)
    return F.when(x < 2.0, grown).otherwise(F.exp(-x * x) / root_pi / fraction)
