"""Decision thresholds from a validation curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import close, next_up
from .metrics import curve, rates
from .ordered import exact_quantiles, scalars


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds per-key columns of ``right``; without keys they are scalars.

    A key may own most of a curve; adaptive execution splits its rows, since
    the other side has one row for each key.
    """
    if keys:
        return left.join(right.select(*keys, *columns), list(keys))
    got = scalars(right.select(*columns))
    return left.withColumns({c: got[c] for c in columns})


def _fbeta(beta: float):
    b2 = beta * beta
    p, r = F.col("precision"), F.col("recall")
    d = b2 * p + r
    return F.when(d > 0, (1 + b2) * p * r / d).otherwise(0.0)


def best_fbeta(points: DataFrame, keys: Sequence[str], beta: float) -> DataFrame:
    """Threshold of the best F-beta; of nearly equal ones the highest recall, then the lowest threshold."""
    scored = points.withColumn("__f", _fbeta(beta))
    best = scored.groupBy(*keys).agg(F.max("__f").alias("__best"))
    near = _join(scored, best, keys, ["__best"]).where(close(F.col("__f"), F.col("__best")))
    return near.groupBy(*keys).agg(F.max_by("score", F.struct(F.col("recall"), -F.col("score"))).alias("threshold"))


def recall_at_fpr(points: DataFrame, keys: Sequence[str], cap: float) -> DataFrame:
    """Best recall among ROC corners with FPR at most ``cap``; ties prefer low FPR, then a high threshold.

    Without such a corner the threshold lies just above the highest score.
    """
    top = points.groupBy(*keys).agg(next_up(F.max("score")).alias("__none"))
    fit = points.where(F.col("corner") & (F.col("fpr") <= cap))
    best = fit.groupBy(*keys).agg(F.max("recall").alias("__tpr"))
    near = _join(fit, best, keys, ["__tpr"]).where(close(F.col("recall"), F.col("__tpr")))
    low = near.groupBy(*keys).agg(F.min("fpr").alias("__fpr"))
    chosen = _join(near, low, keys, ["__fpr"]).where(close(F.col("fpr"), F.col("__fpr")))
    chosen = chosen.groupBy(*keys).agg(F.max("score").alias("__t"))
    if keys:
        out = top.join(chosen, list(keys), "left")
        return out.select(*keys, F.coalesce("__t", "__none").alias("threshold"))
    return top.select(F.coalesce(scalars(chosen)["__t"], F.col("__none")).alias("threshold"))


def benign_quantile(df: DataFrame, keys: Sequence[str], label: str, score: str, quantile: float) -> DataFrame:
    benign = df.where(F.col(label) == 0)
    return exact_quantiles(benign, keys, score, [quantile]).select(*keys, F.col("q")[0].alias("threshold"))


def best_f1(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best F1 within 1e-12; ties by recall, precision, low FPR, then high threshold."""
    scored = points.withColumn("__f", _fbeta(1.0))
    best = scored.groupBy(*keys).agg(F.max("__f").alias("__best"))
    near = _join(scored, best, keys, ["__best"]).where(
        close(F.col("__f"), F.col("__best"), 1e-12, 1e-12)
    )
    order = F.struct(F.col("__f"), F.col("recall"), F.col("precision"), -F.col("fpr"), F.col("score"))
    return near.groupBy(*keys).agg(F.max_by("score", order).alias("threshold"))


def evaluate_thresholds(points: DataFrame, thresholds: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Counts and rates of several thresholds (keys, method, threshold), from the curve instead of the rows."""
    if keys:
        pairs = points.join(thresholds, list(keys))
    else:
        listed = scalars(thresholds.agg(F.collect_list(F.struct("method", "threshold")).alias("l")))["l"]
        pairs = points.withColumn("__l", listed).select("*", F.inline("__l")).drop("__l")
    hit = (F.col("score") > F.col("threshold")) if strict else (F.col("score") >= F.col("threshold"))
    count = lambda c, on: F.sum(F.when(on, F.col(c)).otherwise(0)).cast("long")
    counts = pairs.groupBy(*keys, "method", "threshold").agg(
        count("neg", ~hit).alias("tn"), count("neg", hit).alias("fp"), count("pos", ~hit).alias("fn"), count("pos", hit).alias("tp")
    )
    return rates(counts)


def _methods(parts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    out = None
    for i, (name, df) in enumerate(parts.items()):
        part = df.select(*keys, F.lit(i).alias("__i"), F.lit(name).alias("method"), "threshold")
        out = part if out is None else out.unionByName(part)
    return out


def calibrate(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Candidates by F1, F2 and recall at an FPR cap; the row with ``selected`` wins on F2, F1, recall, FPR, precision."""
    points = curve(df, keys, label, score, reuse=True)
    candidates = _methods(
        {
            "validation_f1": best_fbeta(points, keys, 1.0),
            "validation_f2": best_fbeta(points, keys, 2.0),
            "recall_at_fpr_cap": recall_at_fpr(points, keys, K.FPR_CAP),
        },
        keys,
    )
    rated = evaluate_thresholds(points, candidates.drop("__i"), keys)
    order = F.struct(
        F.col("f2"), F.col("f1"), F.col("recall_tpr"), -F.col("fpr"), F.col("precision"),
        -F.array_position(F.array(*[F.lit(m) for m in ("validation_f1", "validation_f2", "recall_at_fpr_cap")]), F.col("method")),
    )
    best = rated.groupBy(*keys).agg(F.max_by("method", order).alias("__best"))
    return _join(rated, best, keys, ["__best"]).withColumn("selected", F.col("method") == F.col("__best")).drop("__best")


def report_thresholds(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Anomaly-score rule: the F1 threshold is selected, the others (first of equal ones) are for the record."""
    points = curve(df, keys, label, score, reuse=True)
    parts = {"validation_f1": best_fbeta(points, keys, 1.0)}
    for p in K.REPORT_BENIGN_QUANTILES:
        parts[f"benign_q{p:g}"] = benign_quantile(df, keys, label, score, p)
    parts["validation_f2"] = best_fbeta(points, keys, 2.0)
    for cap in K.REPORT_FPR_CAPS:
        parts[f"recall_at_fpr_{cap:g}"] = recall_at_fpr(points, keys, cap)
    candidates = distinct_thresholds(_methods(parts, keys), keys)
    rated = evaluate_thresholds(points, candidates, keys, strict=True)
    return rated.withColumn("selected", F.col("method") == "validation_f1")


def distinct_thresholds(candidates: DataFrame, keys: Sequence[str], digits: int = 12) -> DataFrame:
    """First method of each threshold rounded to ``digits``; needs the candidate order in ``__i``."""
    return (
        candidates.groupBy(*keys, F.round("threshold", digits).alias("__r"))
        .agg(F.min_by(F.struct("method", "threshold"), "__i").alias("m"))
        .select(*keys, "m.method", "m.threshold")
    )
