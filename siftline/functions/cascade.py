"""Gated cascades of two or three scores as columns.

A low-confidence positive of the primary score needs confirmation by a second
or third score; a primary negative is rescued only when the others agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .decision import _col
from .numeric import EPS


@dataclass(frozen=True)
class Rule:
    """Thresholds of the three-score cascade: numbers or columns."""

    primary_threshold: object
    positive_filter_cutoff: object
    second_confirm_threshold: object
    third_confirm_threshold: object
    second_rescue_threshold: object
    third_rescue_threshold: object

    @classmethod
    def from_columns(cls) -> "Rule":
        """Rule whose thresholds sit in columns of the same names."""
        return cls(*[F.col(name) for name in cls.__dataclass_fields__])


def three_score(primary: Column, second: Column, third: Column, rule: Rule) -> dict[str, Column]:
    baseline = (primary >= _col(rule.primary_threshold)).cast("int")
    low = (baseline == 1) & (primary <= _col(rule.positive_filter_cutoff) + EPS)
    confirmed = low & (second >= _col(rule.second_confirm_threshold))
    arbiter = low & ~(second >= _col(rule.second_confirm_threshold))
    kept = arbiter & (third >= _col(rule.third_confirm_threshold))
    rescue = (
        (baseline == 0)
        & (second >= _col(rule.second_rescue_threshold))
        & (third >= _col(rule.third_rescue_threshold))
    )
    final = F.when(rescue, 1).when(low, (confirmed | kept).cast("int")).otherwise(baseline)
    # Route names.
    route = (
        F.when(rescue, "JOINT_LITEMV_RF_RESCUE")
        .when(arbiter & (final == 0), "LITEMV_RF_FILTERED_LSTM_POSITIVE")
        .when(arbiter, "RF_ARBITRATED_KEEP_MALICIOUS")
        .when(confirmed, "LITEMV_CONFIRMED_LSTM_POSITIVE")
        .otherwise("LSTM_DIRECT")
    )
    return {
        "baseline": baseline,
        "low_positive_route": low,
        "second_confirms": confirmed,
        "arbiter_route": arbiter,
        "third_keeps": kept,
        "rescue_route": rescue,
        "prediction": final,
        "route": route,
    }


def two_score(
    primary: Column, second: Column, threshold, cutoff, confirm, rescue, enabled: Column | bool = True
) -> dict[str, Column]:
    on = enabled if isinstance(enabled, Column) else F.lit(bool(enabled))
    baseline = (primary >= _col(threshold)).cast("int")
    filtered = on & (baseline == 1) & (primary <= _col(cutoff) + EPS)
    rescued = on & (baseline == 0) & (second >= _col(rescue))
    final = (
        F.when(rescued, 1).when(filtered, (second >= _col(confirm)).cast("int")).otherwise(baseline)
    )
    return {"baseline": baseline, "filter_route": filtered, "rescue_route": rescued, "prediction": final}
