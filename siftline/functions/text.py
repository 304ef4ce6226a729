"""Text column functions and name predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result names.
TARGET_NAME = "COBALT_STRIKE_HTTPS_C2"
NON_TARGET_NAME = "NOT_COBALT_STRIKE_HTTPS_C2"
COPY_MARKER = "__FINAL_TIMEWARP__"


def normalize_source(path: Column) -> Column:
    return F.replace(F.trim(path), F.lit("\\"), F.lit("/"))


def plain_name(name: str) -> str:
    """Lower-case name with runs of blanks as one blank."""
    return " ".join(name.split()).casefold()


def sql_plain_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def is_timing_feature(name: str) -> bool:
    n = plain_name(name)
    return n == "flow duration" or " iat " in f" {n} " or n.startswith(("active ", "idle "))


def is_rate_feature(name: str) -> bool:
    n = plain_name(name)
    return n.endswith("/s") or " rate avg" in n


def feature_kind(name: Column) -> Column:
    """timing, rate, flag or other, from a feature name."""
    n = sql_plain_name(name)
    padded = F.concat(F.lit(" "), n, F.lit(" "))
    timing = (n == "flow duration") | padded.contains(" iat ") | n.startswith("active ") | n.startswith("idle ")
    rate = n.endswith("/s") | n.contains(" rate avg")
    return F.when(timing, "timing").when(rate, "rate").when(n.contains("flag"), "flag").otherwise("other")


def warped_source(source: Column, copy: Column, factor: Column) -> Column:
    return F.format_string("%s" + COPY_MARKER + "%d_s%.6f", source, copy, factor)


def warped_flow_id(flow_id: Column, copy: Column) -> Column:
    return F.format_string("%s" + COPY_MARKER + "%d", flow_id.cast("string"), copy)


def case_id(ordinal: Column) -> Column:
    return F.format_string("case_%05d", ordinal)


def label_name(label: Column) -> Column:
    return F.when(label == 1, TARGET_NAME).otherwise(NON_TARGET_NAME)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)
