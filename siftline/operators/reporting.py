"""Summaries over runs, folds, stages and models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import divide
from .columns import q
from .metrics import confusion_aggregates, rates
from .ordered import exact_quantiles


def value_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))


def transfer_by_source(
    df: DataFrame, keys: Sequence[str], source: str, label: str, predicted: str, scores: Sequence[str], medians: bool = False
) -> DataFrame:
    """Rows, label (-1 if mixed), predicted positives, errors and mean scores per source."""
    dims = [*keys, source]
    out = df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("rows"),
        F.when(F.min(label) == F.max(label), F.min(label)).otherwise(-1).cast("int").alias("actual_label"),
        F.count_if(F.col(predicted) == 1).alias("predicted_positive"),
        F.count_if(F.col(predicted) != F.col(label)).alias("errors"),
        *[F.avg(s).alias(f"mean_{s}") for s in scores],
    )
    for s in scores if medians else ():
        mid = exact_quantiles(df, dims, s, [0.5]).select(*dims, F.col("q")[0].alias(f"median_{s}"))
        out = out.join(mid, dims, "left")
    return out


def stage_deltas(df: DataFrame, keys: Sequence[str], stage: str, order: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric changes from each stage to the next, and signed improvements (lower is better for fpr, fp, fn).

    A key has one row per stage.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(stage))
    w = Window.partitionBy(*keys).orderBy("__rank")
    ranked = df.withColumn("__rank", rank).where(F.col("__rank") > 0)
    before = F.lag(stage).over(w)
    deltas = {f"delta_{m}": F.col(m) - F.lag(m).over(w) for m in metrics}
    follows = F.lag("__rank").over(w) == F.col("__rank") - 1
    out = ranked.select(*keys, before.alias("from_stage"), F.col(stage).alias("to_stage"), follows.alias("__f"), *[c.alias(n) for n, c in deltas.items()])
    sign = lambda m: -1 if m in ("fpr", "fnr", "fp", "fn") else 1
    return out.where("__f").drop("__f").withColumns({f"{m}_improvement": sign(m) * F.col(f"delta_{m}") for m in metrics})


def variant_deltas(df: DataFrame, keys: Sequence[str], variant: str, first: str, second: str, metrics: Sequence[str]) -> DataFrame:
    """Metrics of two variants side by side and their difference."""
    pick = lambda v, m: F.max(F.when(F.col(variant) == v, F.col(m)))
    out = df.where(F.col(variant).isin(first, second)).groupBy(*keys).agg(
        *[pick(v, m).alias(f"{v}_{m}") for v in (first, second) for m in metrics],
        (F.count_if(F.col(variant) == first) == 1).alias("__a"),
        (F.count_if(F.col(variant) == second) == 1).alias("__b"),
    )
    return out.where("__a AND __b").drop("__a", "__b").withColumns(
        {f"delta_{m}": q(f"{second}_{m}") - q(f"{first}_{m}") for m in metrics}
    )


def equal_weight_summary(runs: DataFrame, config: str, dataset: str, metrics: Sequence[str]) -> DataFrame:
    """Metrics per configuration with every dataset counting the same: mean, min, max of the dataset means, run std."""
    per = runs.groupBy(config, dataset).agg(*[F.avg(m).alias(m) for m in metrics])
    over = per.groupBy(config).agg(
        F.count(F.lit(1)).alias("datasets"),
        *[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))],
    )
    spread = runs.groupBy(config).agg(F.count(F.lit(1)).alias("runs"), *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics])
    return over.join(spread, config)


def rank_rows(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), out: str = "selection_rank") -> DataFrame:
    """Rank of the rows of a result table (one row per configuration); rank 1 is selected."""
    spec = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    return df.withColumn(out, F.row_number().over(spec)).withColumn("selected", F.col(out) == 1)


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Row with the smallest order tuple per key, by aggregation instead of sorting."""
    kept = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("m"))
    return best.where(F.col("m").isNotNull()).select(*keys, "m.*")


def importance_summary(importance: DataFrame, keys: Sequence[str], feature: str, value: str) -> DataFrame:
    """Mean and sample std of each feature's importance over folds."""
    return importance.groupBy(*keys, feature).agg(
        F.avg(value).alias("importance_mean"), F.stddev_samp(value).alias("importance_std")
    )


def temporal_share(importance: DataFrame, keys: Sequence[str], fold: str, is_temporal: Column, value: str) -> DataFrame:
    """Importance of the temporal features summed per fold: mean, population std, min, max."""
    per = importance.groupBy(*keys, fold).agg(F.sum(F.when(is_temporal, F.col(value)).otherwise(0.0)).alias("share"))
    return per.groupBy(*keys).agg(
        F.avg("share").alias("share_mean"), F.stddev_pop("share").alias("share_std"),
        F.min("share").alias("share_min"), F.max("share").alias("share_max"),
    )


def history_coverage(df: DataFrame, keys: Sequence[str], label: str, count: str, levels: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Median history and share of rows with at least some history, per label."""
    dims = [*keys, label]
    shares = df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg((q(count) >= k).cast("int")).alias(f"share_ge_{k}") for k in levels]
    )
    mid = exact_quantiles(df, dims, count, [0.5]).select(*dims, F.col("q")[0].alias("median_history"))
    return shares.join(mid, dims)


def comparison_grid(results: Mapping[tuple[str, str], DataFrame], spark: SparkSession, models: Sequence[str], datasets: Sequence[str]) -> DataFrame:
    """Every model and dataset with its metrics, or status ``missing``."""
    grid = spark.createDataFrame([(m, d) for m in models for d in datasets], "model string, dataset string")
    rows = None
    for (m, d), df in results.items():
        part = df.withColumns({"model": F.lit(m), "dataset": F.lit(d), "status": F.lit("ok")})
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    out = grid if rows is None else grid.join(rows, ["model", "dataset"], "left")
    return out.withColumn("status", F.coalesce("status", F.lit("missing")) if rows is not None else F.lit("missing"))


def component_records(df: DataFrame, keys: Sequence[str], label: str, predictions: Mapping[str, str], source: str) -> DataFrame:
    """Metrics of every component and the number of rows and sources it saw."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("int").alias("p")) for m, c in predictions.items()])
    long = df.select(*keys, source, label, F.explode(pairs).alias("x")).select(*keys, source, label, "x.model", "x.p")
    per = long.groupBy(*keys, "model", source).agg(F.count(F.lit(1)).alias("rows"), *confusion_aggregates(F.col(label), F.col("p")))
    total = per.groupBy(*keys, "model").agg(
        F.sum("rows").alias("evaluation_rows"), F.count(F.lit(1)).alias("evaluation_sources"),
        *[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")],
    )
    return rates(total, names=["accuracy", "precision", "recall_tpr", "fpr", "fnr", "f1", "f2"])


def arbitration_report(cases: DataFrame, all_rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Escalation rate, error coverage, proposals and accepted overrides per key.

    ``cases`` holds hybrid_pred, recommended_action, final_pred and override_accepted.
    """
    y, h, f = F.col(label), F.col("hybrid_pred"), F.col("final_pred")
    action = F.col("recommended_action")
    raw = F.when(action == "OVERRIDE_TO_C2", 1).when(action == "OVERRIDE_TO_NON_C2", 0).otherwise(h)
    per = cases.withColumn("raw", raw).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("escalated_cases"),
        F.count_if(y == 0).alias("escalated_benign"),
        F.count_if(y == 1).alias("escalated_malicious"),
        F.count_if(h != y).alias("escalated_errors"),
        F.count_if(F.col("raw") != h).alias("proposals"),
        F.count_if((F.col("raw") != h) & (F.col("raw") == y)).alias("raw_corrected"),
        F.count_if((F.col("raw") != h) & (h == y)).alias("raw_introduced"),
        F.count_if("override_accepted").alias("accepted_overrides"),
        F.count_if((f != h) & (f == y)).alias("accepted_corrected"),
        F.count_if((f != h) & (h == y)).alias("accepted_introduced"),
    )
    whole = all_rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("test_rows"), F.count_if(F.col("hybrid_pred") != F.col(label)).alias("total_errors")
    )
    zero = [c for c in per.columns if c not in keys]
    out = whole.join(per, list(keys), "left").na.fill(0, zero)
    return out.withColumns(
        {
            "escalation_rate": divide(F.col("escalated_cases"), F.col("test_rows")),
            "error_coverage": divide(F.col("escalated_errors"), F.col("total_errors")),
            "proposal_accuracy": divide(F.col("raw_corrected"), F.col("proposals"), None),
            "raw_net_benefit": F.col("raw_corrected") - F.col("raw_introduced"),
            "accepted_net_benefit": F.col("accepted_corrected") - F.col("accepted_introduced"),
        }
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max of runtime columns, one row each."""
    from .ordered import unpivot

    long = unpivot(df, [], columns, "column", "value")
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75]).select(
        "column", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    )
    return basic.join(quartiles, "column", "left")
