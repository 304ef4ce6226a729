"""Column names: cleaning, aliases, feature lists and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import finite, number_from_text, variation


def q(name: str):
    """Column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_name(name: str) -> str:
    return name.replace("﻿", "").strip()


def clean_names(df: DataFrame) -> DataFrame:
    """Names without byte-order marks and outer blanks; a clash is an error."""
    names = [clean_name(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"columns repeated after cleaning: {clash}")
    return df.toDF(*names)


def canonical_names(df: DataFrame, aliases: dict[str, str] = K.COLUMN_ALIASES) -> DataFrame:
    """Alternative spellings become canonical; of columns with one name the first stays."""
    names = [aliases.get(c.strip(), c.strip()) for c in df.columns]
    marked = [n if n not in names[:i] else f"__repeat{i}" for i, n in enumerate(names)]
    return df.toDF(*marked).drop(*[m for m in marked if m.startswith("__repeat")])


def resolve_alias(columns: Sequence[str], aliases: Sequence[str], role: str) -> str:
    """First alias present; otherwise the column equal to an alias in letters and digits."""
    for alias in aliases:
        if alias in columns:
            return alias
    bare = lambda s: "".join(ch.lower() for ch in s if ch.isalnum())
    by_bare = {bare(c): c for c in columns}
    for alias in aliases:
        if bare(alias) in by_bare:
            return by_bare[bare(alias)]
    raise ValueError(f"no column for {role} among {list(aliases)}")


def first_present(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    return next((a for a in aliases if a in columns), None)


def drop_manifest(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """Every dropped feature with its category and whether the input has it."""
    rows = []
    for category, reason, names in (
        ("non_predictive", "raw non-predictive field", K.NON_PREDICTIVE_COLUMNS),
        ("constant", "constant column", K.CONSTANT_COLUMNS),
        ("correlated", "correlation or redundancy", K.CORRELATED_COLUMNS),
    ):
        rows += [(n, category, reason, n in columns) for n in names]
    return spark.createDataFrame(rows, "feature string, category string, reason string, present boolean")


def feature_view(df: DataFrame, features: Sequence[str], metadata: Sequence[str], label: str) -> DataFrame:
    """Metadata, numeric features and label, in that order."""
    kept = [m for m in metadata if m in df.columns]
    return df.select(*[q(m) for m in kept], *[finite(q(f)).alias(f) for f in features], q(label).cast("int").alias(label))


def select_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Baseline feature projection of a canonical flow table and the dropped names."""
    chosen = K.selected_features(df.columns)
    dropped = [c for c in K.candidate_features(df.columns) if c not in chosen]
    return feature_view(df, chosen, K.METADATA_COLUMNS, K.LABEL), dropped


def harden(df: DataFrame) -> DataFrame:
    """Drops the environment-dependent features of the baseline view."""
    features = K.candidate_features(df.columns)
    missing = [b for b in K.BRITTLE_COLUMNS if b not in features]
    if missing:
        raise ValueError(f"columns to harden away are missing: {missing}")
    kept = set(K.hardened_features(features))
    return df.drop(*[f for f in features if f not in kept])


def numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles; text that is no finite number becomes null."""
    return df.withColumns({f: number_from_text(q(f)) for f in features})


def forest_base(df: DataFrame) -> DataFrame:
    """Adds the variation of forward lengths and the canonical total length, all base features numeric."""
    total = resolve_alias(df.columns, K.ROLE_ALIASES["total forward length"], "total forward length")
    df = df.withColumn(K.TOTAL_LENGTH, number_from_text(q(total)))
    df = numeric(df, K.FOREST_BASE_10)
    return df.withColumn(K.LENGTH_CV, variation(q("Fwd Packet Length Std"), q("Fwd Packet Length Mean")))


def representation(df: DataFrame, name: str, ids: Sequence[str] = (K.SOURCE, K.LABEL)) -> DataFrame:
    """Named feature projection: all57, base10, base12 or history32."""
    features = {
        "all57": lambda: K.selected_features(df.columns),
        "base10": lambda: K.FOREST_BASE_10,
        "base12": lambda: K.FOREST_BASE_12,
        "history32": lambda: K.forest_features(),
    }[name]()
    return df.select(*[q(i) for i in ids], *[finite(q(f)).alias(f) for f in features])
