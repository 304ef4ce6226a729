"""Data-quality checks; each returns a frame of violations that is empty when all is well."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..functions.draws import draw
from ..functions.numeric import finite, number_from_text
from .ordered import Ordered, scalars, unpivot


def schema_violations(spark: SparkSession, columns: Sequence[str], expected: Sequence[str], ordered: bool = True) -> DataFrame:
    """Missing, unexpected, repeated and (``ordered``) misplaced column names."""
    rows = [("missing", c, expected.index(c)) for c in expected if c not in columns]
    if ordered:
        rows += [("unexpected", c, i) for i, c in enumerate(columns) if c not in expected]
    rows += [("repeated", c, i) for i, c in enumerate(columns) if c in columns[:i]]
    if ordered and not rows:
        rows += [("misplaced", c, i) for i, (c, e) in enumerate(zip(columns, expected)) if c != e]
    return spark.createDataFrame(rows, "kind string, column string, position int")


def unparsed_timestamps(df: DataFrame, column: str, parsed: Column | None = None, examples: int = 10) -> DataFrame:
    """Total of unreadable timestamps and the first ``examples`` distinct texts with their counts."""
    reading = times.parse_mixed(F.col(column)) if parsed is None else parsed
    bad = df.where(reading.isNull()).groupBy(F.col(column).alias("example")).agg(F.count(F.lit(1)).alias("n"))
    total = bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit("total").alias("kind"), F.lit(None).cast("string").alias("example"), "n"
    )
    shown = bad.orderBy(F.col("example").asc_nulls_last()).limit(examples)
    return total.unionByName(shown.select(F.lit("example").alias("kind"), "example", "n"))


def label_domain(df: DataFrame, label: str) -> DataFrame:
    """Label values outside {0, 1} and their row counts."""
    value = number_from_text(F.col(label))
    return (
        df.groupBy(F.col(label).cast("string").alias("value"), value.alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("v").isNull() | ~F.col("v").isin(0.0, 1.0))
        .select("value", "n")
    )


def mixed_sources(df: DataFrame, source: str, label: str) -> DataFrame:
    """Sources holding more than one label."""
    return (
        df.groupBy(source)
        .agg(F.min(label).alias("min_label"), F.max(label).alias("max_label"), F.count(F.lit(1)).alias("n"))
        .where(F.col("min_label") != F.col("max_label"))
    )


def time_regressions(df: DataFrame, source: str, ts: str, row_id: str, rows_per_slice: int | None = None) -> DataFrame:
    """Rows earlier than the row stored just before them in the same source."""
    o = Ordered(df.select(source, ts, row_id), [source], [row_id], halo=1, rows_per_slice=rows_per_slice)
    o.add({"previous": F.lag(ts).over(o.window())})
    return o.done().where(F.col("previous") > F.col(ts))


def feature_gaps(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature the nulls and the non-numeric or non-finite values, in one pass."""
    pairs = []
    for f in features:
        c = F.col(f"`{f}`")
        pairs.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.count_if(c.isNull()).alias("n_null"),
                F.count_if(c.isNotNull() & number_from_text(c).isNull()).alias("n_invalid"),
            )
        )
    counts = df.agg(F.array(*pairs).alias("f")).select(F.inline("f"))
    return counts.where((F.col("n_null") > 0) | (F.col("n_invalid") > 0))


def empty_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features without a single usable value."""
    pairs = [
        F.struct(F.lit(f).alias("feature"), F.count(number_from_text(F.col(f"`{f}`"))).alias("n_valid")) for f in features
    ]
    return df.agg(F.array(*pairs).alias("f")).select(F.inline("f")).where(F.col("n_valid") == 0)


def fold_violations(df: DataFrame, source: str, label: str, fold: str) -> DataFrame:
    """Sources in several folds, and folds whose test or train side lacks a class."""
    cells = df.groupBy(source, label, fold).agg(F.count(F.lit(1)).alias("n"))
    crossing = (
        cells.groupBy(source)
        .agg((F.min(fold) != F.max(fold)).alias("bad"), F.sum("n").alias("n"))
        .where("bad")
        .select(F.lit("source_crosses_folds").alias("kind"), F.col(source).cast("string").alias("item"), "n")
    )
    sides = cells.groupBy(fold).agg(
        F.sum(F.when(F.col(label) == 0, F.col("n")).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias("n1"),
    )
    totals = sides.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    both = scalars(totals)
    one_sided = sides.where(
        (F.col("n0") == 0) | (F.col("n1") == 0) | (F.col("n0") == both["t0"]) | (F.col("n1") == both["t1"])
    ).select(
        F.lit("fold_side_lacks_class").alias("kind"), F.col(fold).cast("string").alias("item"), (F.col("n0") + F.col("n1")).alias("n")
    )
    return crossing.unionByName(one_sided)


def coverage_violations(rows: DataFrame, predictions: DataFrame, row_id: str) -> DataFrame:
    """Row ids that do not have exactly one prediction."""
    tagged = rows.select(row_id, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        predictions.select(row_id, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    counts = tagged.groupBy(row_id).agg(F.sum("a").alias("n_rows"), F.sum("b").alias("n_predictions"))
    return counts.where((F.col("n_rows") != 1) | (F.col("n_predictions") != 1))


def manifest_mismatches(rows: DataFrame, manifest: DataFrame, row_id: str, checked: Sequence[str]) -> DataFrame:
    """Row ids found on one side only, or whose ``checked`` columns differ."""
    left = rows.select(row_id, F.struct(*checked).alias("__l"))
    right = manifest.select(row_id, F.struct(*checked).alias("__r"))
    kind = (
        F.when(F.col("__l").isNull(), "not_in_rows")
        .when(F.col("__r").isNull(), "not_in_manifest")
        .when(~F.col("__l").eqNullSafe(F.col("__r")), "values_differ")
    )
    return left.join(right, row_id, "full").select(row_id, kind.alias("kind")).where(F.col("kind").isNotNull())


def prediction_mismatches(df: DataFrame, score: str, threshold: str, stored: str, strict: bool = False) -> DataFrame:
    """Rows whose stored decision is not the recomputed one."""
    hit = (F.col(score) > F.col(threshold)) if strict else (F.col(score) >= F.col(threshold))
    return df.where(~F.col(stored).eqNullSafe(hit.cast("int")))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def dataset_checks(df: DataFrame, dataset: str, source: str, label: str, ts: str, row_id: str, features: Sequence[str]) -> DataFrame:
    """Violation counts of all row checks per dataset."""
    base = df.groupBy(dataset).agg(
        F.count_if(F.col(ts).isNull()).alias("missing_timestamp"),
        F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)).alias("label_domain"),
        F.count_if(F.col(source).isNull()).alias("missing_source"),
        *[F.count_if(finite(F.col(f"`{f}`")).isNull()).alias(f"invalid {f}") for f in features],
    )
    checks = [c for c in base.columns if c != dataset]
    out = unpivot(base, [dataset], checks, "check", "n").select(dataset, "check", F.col("n").cast("long").alias("n"))
    per_source = df.groupBy(dataset, source).agg((F.min(label) != F.max(label)).cast("long").alias("bad"))
    mixed = per_source.groupBy(dataset).agg(F.sum("bad").alias("n")).select(dataset, F.lit("mixed_source").alias("check"), "n")
    o = Ordered(df.select(dataset, source, ts, row_id), [dataset, source], [row_id], halo=1)
    o.add({"__p": F.lag(ts).over(o.window())})
    late = o.done().groupBy(dataset).agg(F.count_if(F.col("__p") > F.col(ts)).alias("n"))
    return out.unionByName(mixed).unionByName(late.select(dataset, F.lit("time_regression").alias("check"), "n"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-insensitive fingerprint of the rows: count, xor and sum of row hashes."""
    hashed = df.select(draw(*[F.col(c) for c in columns]).alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("hash_xor"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum")
    )


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise when a check found something; looks at a few rows only."""
    found = violations.take(5)
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")


def violation_counts(checks: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
