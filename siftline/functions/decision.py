"""Decisions, margins and evidence levels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import STRONG_FROM, WEAK_BELOW


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def decide(score: Column, threshold, strict: bool = False) -> Column:
    """1 where the score reaches the threshold (``strict``: exceeds it)."""
    t = _col(threshold)
    return ((score > t) if strict else (score >= t)).cast("int")


def error_type(label: Column, predicted: Column) -> Column:
    return (
        F.when((label == 0) & (predicted == 0), "TN")
        .when((label == 0) & (predicted == 1), "FP")
        .when((label == 1) & (predicted == 0), "FN")
        .when((label == 1) & (predicted == 1), "TP")
    )


def signed_margin(score: Column, threshold) -> Column:
    return score - _col(threshold)


def support_margin(score: Column, threshold) -> Column:
    """Distance from the threshold on the predicted side."""
    t = _col(threshold)
    return F.when(score >= t, score - t).otherwise(t - score)


def strength(percentile: Column) -> Column:
    return F.when(percentile < WEAK_BELOW, "WEAK").when(percentile < STRONG_FROM, "MODERATE").otherwise("STRONG")


def _level(cv: Column, count: Column, high: float, moderate: float, noun: str) -> Column:
    enough = (count >= 3) & cv.isNotNull() & ~F.isnan(cv)
    return (
        F.when(~F.coalesce(enough, F.lit(False)), "INSUFFICIENT_HISTORY")
        .when(cv <= high, f"HIGH_{noun}")
        .when(cv <= moderate, f"MODERATE_{noun}")
        .otherwise(f"LOW_{noun}")
    )


def regularity_level(cv: Column, count: Column) -> Column:
    return _level(cv, count, 0.15, 0.35, "REGULARITY")


def stability_level(cv: Column, count: Column) -> Column:
    return _level(cv, count, 0.20, 0.50, "STABILITY")


def weakest(*percentiles: Column) -> Column:
    return F.least(*percentiles)
