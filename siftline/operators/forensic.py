"""Error ledgers and their summaries by source, feature and model."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decision import error_type
from ..functions.numeric import divide, erfc, finite
from .columns import q
from .ordered import Ordered, exact_quantiles, unpivot


def ledger(
    df: DataFrame, *, label: str, predicted: str, score: str, threshold: str, keep: Sequence[str] = (), **constants: str
) -> DataFrame:
    """Predictions with error type and margins; ``constants`` become leading text columns."""
    return df.select(
        *[F.lit(v).alias(k) for k, v in constants.items()],
        *keep,
        F.col(label).alias("label"),
        F.col(predicted).alias("predicted"),
        error_type(F.col(label), F.col(predicted)).alias("error_type"),
        F.col(score).cast("double").alias("score"),
        F.col(threshold).cast("double").alias("threshold"),
        (F.col(score) - F.col(threshold)).alias("signed_margin"),
        F.abs(F.col(score) - F.col(threshold)).alias("abs_margin"),
    )


def errors_by_source(led: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """Counts and rates per source, with its share of all FP and FN of the keys."""
    count = lambda kind: F.count_if(F.col("error_type") == kind)
    per = led.groupBy(*keys, source).agg(*[count(k).alias(k.lower()) for k in ("TN", "FP", "FN", "TP")])
    totals = per.groupBy(*keys).agg(F.sum("fp").alias("__fp"), F.sum("fn").alias("__fn"))
    benign, malicious = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    return (
        per.join(totals, list(keys))
        .withColumns(
            {
                "rows": benign + malicious,
                "source_fpr": divide(F.col("fp"), benign, None),
                "source_fnr": divide(F.col("fn"), malicious, None),
                "source_error_rate": (F.col("fp") + F.col("fn")) / (benign + malicious),
                "share_of_fp": divide(F.col("fp"), F.col("__fp")),
                "share_of_fn": divide(F.col("fn"), F.col("__fn")),
            }
        )
        .drop("__fp", "__fn")
    )


def representative_errors(led: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Per kind of error the row nearest to and farthest from the threshold, one row if they coincide."""
    row = F.struct(*[c for c in led.columns if c not in keys])
    near = F.min_by(row, F.struct(F.col("abs_margin"), F.col(row_id)))
    far = F.max_by(row, F.struct(F.col("abs_margin"), -F.col(row_id)))
    picks = (
        led.where(F.col("error_type").isin("FP", "FN"))
        .groupBy(*keys, F.col("error_type").alias("__e"))
        .agg(near.alias("near"), far.alias("far"))
    )
    same = F.col(f"near.{row_id}") == F.col(f"far.{row_id}")
    tagged = lambda kind, r: F.struct(F.lit(kind).alias("kind"), F.col(r).alias("r"))
    chosen = F.when(same, F.array(tagged("borderline_and_high_confidence", "near"))).otherwise(
        F.array(tagged("borderline", "near"), tagged("high_confidence", "far"))
    )
    return picks.select(*keys, F.explode(chosen).alias("p")).select(*keys, F.col("p.kind").alias("representative_kind"), "p.r.*")


def overlap_counts(overlap: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    return overlap.groupBy(*keys, label, "wrong_models", "models_wrong").agg(F.count(F.lit(1)).alias("n"))


def overlap_histogram(overlap: DataFrame, keys: Sequence[str], label: str, models: int) -> DataFrame:
    """Rows by number of wrong models from 1 to ``models``, one column per class; empty levels included."""
    per = overlap.groupBy(*keys, "models_wrong").agg(
        F.count_if(F.col(label) == 0).alias("benign_errors"), F.count_if(F.col(label) == 1).alias("malicious_errors")
    )
    grid = per.select(*keys).distinct() if keys else per.limit(1).select()
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(models))).alias("models_wrong"))
    return grid.join(per, [*keys, "models_wrong"], "left").na.fill(0, ["benign_errors", "malicious_errors"])


# -- feature contrasts ---------------------------------------------------------

COMPARISONS = [("FP", "TN"), ("FN", "TP")]


def _contrast_rows(led: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    kind = F.col("error_type")
    comparison = F.when(kind.isin("FP", "TN"), "FP_vs_TN").when(kind.isin("FN", "TP"), "FN_vs_TP")
    base = led.withColumns({"comparison": comparison, "is_error": kind.isin("FP", "FN").cast("int")})
    long = unpivot(base, [*keys, "comparison", "is_error"], features)
    return long.withColumn("value", finite(F.col("value"))).where(F.col("value").isNotNull())


def rank_statistics(
    rows: DataFrame, keys: Sequence[str], group: str, value: str, rows_per_slice: int | None = None
) -> DataFrame:
    """Mann-Whitney U of group 1 against group 0 with mid-ranks, from counts per distinct value."""
    counts = rows.groupBy(*keys, value).agg(F.count_if(F.col(group) == 1).alias("n1"), F.count_if(F.col(group) == 0).alias("n0"))
    t = F.col("n1") + F.col("n0")
    o = Ordered(counts, keys, [value], rows_per_slice=rows_per_slice, aggregated=True).running({"__cum": t})
    mid = F.col("__cum") - t + (t + 1) / 2
    td = t.cast("double")
    out = o.done().groupBy(*keys).agg(
        F.sum("n1").alias("n_error"),
        F.sum("n0").alias("n_reference"),
        F.sum(F.col("n1") * mid).alias("rank_sum"),
        F.sum(td * td * td - td).alias("tie_sum"),
    )
    n1, n0 = F.col("n_error").cast("double"), F.col("n_reference").cast("double")
    out = out.withColumn("u", F.col("rank_sum") - n1 * (n1 + 1) / 2)
    return out.withColumn("effect", F.when((n1 > 0) & (n0 > 0), 2 * F.col("u") / (n1 * n0) - 1))


def rank_p_values(stats: DataFrame) -> DataFrame:
    """Adds the two-sided asymptotic p-value with tie and continuity correction."""
    n1, n0 = F.col("n_error").cast("double"), F.col("n_reference").cast("double")
    n = n1 + n0
    spread = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.when(n > 1, F.col("tie_sum") / (n * (n - 1))).otherwise(0.0)))
    top = F.greatest(F.col("u"), n1 * n0 - F.col("u"))
    z = F.when((n1 > 0) & (n0 > 0) & (spread > 0), (top - n1 * n0 / 2 - 0.5) / spread)
    return stats.withColumn("p_value", F.when(z.isNotNull(), F.least(F.lit(1.0), erfc(F.greatest(z, F.lit(0.0)) / math.sqrt(2.0)))))


def false_discovery(df: DataFrame, keys: Sequence[str], p_value: str, item: str, out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q-values per key; rows without a p-value get none.

    A key holds one row per tested feature, so its window stays small.
    """
    by_p = Window.partitionBy(*keys).orderBy(F.col(p_value).asc_nulls_last(), item)
    m = F.count(p_value).over(Window.partitionBy(*keys))
    raw = F.when(F.col(p_value).isNotNull(), F.col(p_value) * m / F.row_number().over(by_p))
    onward = by_p.rowsBetween(0, Window.unboundedFollowing)
    return (
        df.withColumn("__raw", raw)
        .withColumn(out, F.when(F.col(p_value).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min("__raw").over(onward)))))
        .drop("__raw")
    )


def feature_quartiles(led: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Quartiles of wrong and right rows per feature and comparison, with their median shift."""
    rows = _contrast_rows(led, keys, features)
    dims = [*keys, "comparison", "feature"]
    stats = exact_quantiles(rows, [*dims, "is_error"], "value", [0.25, 0.5, 0.75])
    side = lambda flag, name: stats.where(F.col("is_error") == flag).select(
        *dims,
        F.col("n").cast("long").alias(f"{name}_n"),
        *[F.col("q")[i].alias(f"{name}_{s}") for i, s in enumerate(("q1", "median", "q3"))],
    )
    both = side(1, "error").join(side(0, "reference"), dims)
    shift = F.col("error_median") - F.col("reference_median")
    iqr = F.col("reference_q3") - F.col("reference_q1")
    return both.withColumns({"median_difference": shift, "robust_shift": F.when(iqr > 0, shift / iqr)})


def feature_contrasts(led: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Quartiles, rank-biserial effect, p- and q-value and direction per feature and comparison."""
    dims = [*keys, "comparison", "feature"]
    ranks = rank_p_values(rank_statistics(_contrast_rows(led, keys, features), dims, "is_error", "value"))
    out = feature_quartiles(led, keys, features).join(ranks.select(*dims, "u", "effect", "p_value"), dims)
    out = false_discovery(out, [*keys, "comparison"], "p_value", "feature")
    direction = F.when(F.col("effect") > 0, "ErrorHigher").when(F.col("effect") < 0, "ErrorLower").otherwise("NoDirectionalEffect")
    return out.withColumns(
        {"abs_effect": F.abs("effect"), "significant": F.coalesce(F.col("q_value") < 0.05, F.lit(False)), "direction": direction}
    )


def top_effects(contrasts: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` strongest features per key and comparison."""
    order = Window.partitionBy(*keys, "comparison").orderBy(F.col("abs_effect").desc(), "feature")
    ranked = contrasts.where(F.col("effect").isNotNull()).withColumn("effect_rank", F.row_number().over(order))
    return ranked.where(F.col("effect_rank") <= n)


def source_matrix(by_source: DataFrame, source: str, model: str, models: Sequence[str]) -> DataFrame:
    """Sources with errors: error count and highest error rate per model, and the kind of their errors."""
    cells = [
        F.sum(F.when(F.col(model) == m, F.col("fp") + F.col("fn")).otherwise(0)).alias(f"{m}_errors") for m in models
    ] + [F.coalesce(F.max(F.when(F.col(model) == m, F.col("source_error_rate"))), F.lit(0.0)).alias(f"{m}_rate") for m in models]
    out = by_source.groupBy(source).agg(*cells, F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    kind = F.when((F.col("fp") > 0) & (F.col("fn") == 0), "FP").when((F.col("fn") > 0) & (F.col("fp") == 0), "FN")
    return out.where(F.col("fp") + F.col("fn") > 0).withColumn("kind", kind.otherwise("FP+FN"))


def error_positions(led: DataFrame, keys: Sequence[str], source: str, position: str) -> DataFrame:
    """Errors per source and kind with the range and median of their positions."""
    errors = led.where(F.col("error_type").isin("FP", "FN"))
    dims = [*keys, "error_type", source]
    counts = errors.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n_errors"), F.min(position).alias("min_position"), F.max(position).alias("max_position")
    )
    mid = exact_quantiles(errors, dims, position, [0.5]).select(*dims, F.col("q")[0].alias("median_position"))
    return counts.join(mid, dims, "left")


def model_overview(ledgers: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in ledgers.items():
        part = df.withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
