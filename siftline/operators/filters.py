"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.addresses import is_public_ipv4, is_public_ipv6
from ..functions.numeric import number_from_text
from .ordered import bounded_broadcast


def https_tcp(protocol: Column, src_port: Column, dst_port: Column) -> Column:
    """TCP with port 443 on either side; unreadable numbers do not match."""
    n = number_from_text
    return F.coalesce((n(protocol) == 6) & ((n(src_port) == 443) | (n(dst_port) == 443)), F.lit(False))


def benign_text(label: Column) -> Column:
    return F.coalesce(F.upper(F.trim(label.cast("string"))) == "BENIGN", F.lit(False))


def touches_host(
    protocol: Column, src_ip: Column, dst_ip: Column, host: Column, src_port: Column, dst_port: Column
) -> Column:
    """HTTPS over TCP with ``host`` on either side."""
    return https_tcp(protocol, src_port, dst_port) & F.coalesce((src_ip == host) | (dst_ip == host), F.lit(False))


def host_of_capture(capture: Column, marker: str, marked: str, other: str) -> Column:
    """Monitored host of a capture by a marker in its name."""
    return F.when(F.lower(capture).contains(marker), marked).otherwise(other)


def touches_endpoint(
    df: DataFrame, endpoints: DataFrame, capture: str, src: tuple[str, str], dst: tuple[str, str], protocol: str
) -> DataFrame:
    """TCP rows whose source or destination is a configured (capture, ip, port) endpoint."""
    known = endpoints.select(
        F.col("capture").alias("__c"), F.col("ip").alias("__ip"), F.col("port").cast("double").alias("__port")
    ).dropDuplicates()
    known = bounded_broadcast(known)
    rows = df.where(number_from_text(F.col(protocol)) == 6)
    for i, (ip, port) in enumerate((src, dst)):
        side = known.withColumn(f"__hit{i}", F.lit(True))
        rows = rows.join(
            side,
            (F.col(capture) == side["__c"])
            & (F.col(ip).cast("string") == side["__ip"])
            & (number_from_text(F.col(port)) == side["__port"]),
            "left",
        ).drop("__c", "__ip", "__port")
    return rows.where(F.coalesce(F.col("__hit0"), F.col("__hit1"), F.lit(False))).drop("__hit0", "__hit1")


def public_addresses(df: DataFrame, ip: str, category: str, label: str, ipv6: bool = True) -> DataFrame:
    """Distinct public addresses of benign reference rows."""
    benign = (F.trim(F.col(category)) == "Benign") & (number_from_text(F.col(label)) == 0)
    found = df.where(benign & F.col(ip).isNotNull()).select(F.col(ip).alias("ip")).distinct()
    v4 = found.where(is_public_ipv4(F.col("ip")))
    if not ipv6:
        return v4
    return v4.unionByName(found.where(F.col("ip").contains(":")).where(is_public_ipv6(F.col("ip"))))


def benign_only(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label) == 0)


def enough_history(df: DataFrame, history_count: str, k: int = 5) -> DataFrame:
    return df.where(F.col(history_count) >= k)


def errors_only(df: DataFrame, error_type: str, kinds=("FP", "FN")) -> DataFrame:
    return df.where(F.col(error_type).isin(*kinds))


# Escalation reasons.
REASON_TARGETED = "WEAK_LSTM_LITEMV_CONFIRMATION_WITH_STRONG_RF_BENIGN"
REASON_ROUTE = "HYBRID_HARD_ROUTE::"
REASON_LOW_SUPPORT = "UNUSUALLY_LOW_VALIDATION_SUPPORT"


def escalation_reason(mode: str = "all", low_support: bool = False) -> Column:
    """Reason to escalate a row, null for none; reads route, <model>_pred, <model>_strength and weakest_percentile."""
    if mode not in ("all", "final-union", "legacy", "weak-confirmed-only"):
        raise ValueError(f"unknown selection mode {mode}")
    targeted = (
        (F.col("route") == "LITEMV_CONFIRMED_LSTM_POSITIVE")
        & (F.col("lstm_pred") == 1)
        & (F.col("litemv_pred") == 1)
        & (F.col("rf_pred") == 0)
        & (F.col("lstm_strength") == "WEAK")
        & (F.col("litemv_strength") == "WEAK")
        & (F.col("rf_strength") == "STRONG")
    )
    if mode == "weak-confirmed-only":
        return F.when(targeted, REASON_TARGETED)
    reason = F.when(F.col("route").isin(*K.HARD_ROUTES), F.concat(F.lit(REASON_ROUTE), F.col("route")))
    if mode in ("all", "final-union"):
        reason = reason.when(targeted, REASON_TARGETED)
    if low_support:
        reason = reason.when(F.col("weakest_percentile") <= K.LOW_SUPPORT, REASON_LOW_SUPPORT)
    return reason


def hard_cases(df: DataFrame, mode: str = "all", low_support: bool = False) -> DataFrame:
    return df.withColumn("escalation_reason", escalation_reason(mode, low_support)).where(
        F.col("escalation_reason").isNotNull()
    )
