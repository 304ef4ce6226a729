"""Confusion counts, rates, tie-exact curves and areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import divide
from ..session import cut_lineage
from .ordered import Ordered, lookup_hint, scalars, unpivot

METRICS = ["accuracy", "balanced_accuracy", "precision", "recall_tpr", "specificity_tnr", "fpr", "fnr", "f1", "f2", "mcc"]


def confusion_aggregates(label: Column, predicted: Column, weight: Column | None = None) -> list[Column]:
    """tn, fp, fn, tp as aggregate columns; ``weight`` counts pre-aggregated rows."""
    w = F.lit(1) if weight is None else weight
    cell = lambda y, p: F.sum(F.when((label == y) & (predicted == p), w).otherwise(0)).cast("long")
    return [cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")]


def confusion(df: DataFrame, keys: Sequence[str], label: str, predicted: str) -> DataFrame:
    return df.groupBy(*keys).agg(*confusion_aggregates(F.col(label), F.col(predicted)))


def confusion_matrix(df: DataFrame, keys: Sequence[str], label: str, predicted: str) -> DataFrame:
    """Two rows per key, one column per predicted class, with row shares."""
    out = df.groupBy(*keys, label).agg(
        F.count_if(F.col(predicted) == 0).alias("predicted_0"), F.count_if(F.col(predicted) == 1).alias("predicted_1")
    )
    n = F.col("predicted_0") + F.col("predicted_1")
    return out.withColumns({"share_0": divide(F.col("predicted_0"), n), "share_1": divide(F.col("predicted_1"), n)})


def rates(counts: DataFrame, empty: float | None = 0.0, names: Sequence[str] = METRICS) -> DataFrame:
    """Adds metric columns to confusion counts; ``empty`` is the specificity, FPR and FNR without such rows."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    recall, specificity = divide(tp, tp + fn), divide(tn, tn + fp)
    present = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    fbeta = lambda b2: divide((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)
    root = F.sqrt((tp + fp) * (tp + fn)) * F.sqrt((tn + fp) * (tn + fn))
    every = {
        "accuracy": divide(tp + tn, tp + tn + fp + fn),
        "balanced_accuracy": divide(recall + specificity, present),
        "precision": divide(tp, tp + fp),
        "recall_tpr": recall,
        "specificity_tnr": divide(tn, tn + fp, empty),
        "fpr": divide(fp, fp + tn, empty),
        "fnr": divide(fn, fn + tp, empty),
        "f1": fbeta(1.0),
        "f2": fbeta(4.0),
        "mcc": divide(tp * tn - fp * fn, root),
    }
    return counts.withColumns({n: every[n] for n in names})


def score_counts(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score; everything later works on these."""
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def curve(
    df: DataFrame, keys: Sequence[str], label: str, score: str, rows_per_slice: int | None = None, reuse: bool = False
) -> DataFrame:
    """One row per distinct score, taken as threshold: tps, fps, precision, recall, fpr.

    ``corner`` marks the points left when ROC points on a straight line are
    dropped: the ends, and points whose step differs from the next lower score.
    A large curve that will be read several times (``reuse``) is checkpointed.
    """
    counts = score_counts(df, keys, label, score)
    o = Ordered(counts, keys, ["score"], halo=1, rows_per_slice=rows_per_slice, aggregated=True)
    below_pos, below_neg = F.lag("pos").over(o.window()), F.lag("neg").over(o.window())
    o.add({"__lp": below_pos, "__ln": below_neg})
    o.running({"__cp": F.col("pos"), "__cn": F.col("neg")}).totals({"p": F.col("pos"), "n": F.col("neg")})
    out = o.done()
    tps = F.col("p") - F.col("__cp") + F.col("pos")
    fps = F.col("n") - F.col("__cn") + F.col("neg")
    ends = F.col("__lp").isNull() | ((F.col("__cp") == F.col("p")) & (F.col("__cn") == F.col("n")))
    bends = (F.col("__lp") != F.col("pos")) | (F.col("__ln") != F.col("neg"))
    out = out.withColumns({"tps": tps, "fps": fps, "corner": ends | bends}).drop("__lp", "__ln", "__cp", "__cn")
    out = out.withColumns(
        {
            "precision": F.col("tps") / (F.col("tps") + F.col("fps")),
            "recall": divide(F.col("tps"), F.col("p"), None),
            "fpr": divide(F.col("fps"), F.col("n"), None),
        }
    )
    return cut_lineage(out) if reuse and o.sliced else out


def areas(curve_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC area with ties at half and average precision; null when a class is absent."""
    p, n, pos, neg, tps = (F.col(c).cast("double") for c in ("p", "n", "pos", "neg", "tps"))
    out = curve_df.groupBy(*keys).agg(
        F.max("p").alias("p"),
        F.max("n").alias("n"),
        F.sum(neg * (tps - pos / 2)).alias("__u"),
        F.sum(pos * F.col("precision")).alias("__a"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return out.select(
        *keys,
        F.when(both, F.col("__u") / (p * n)).alias("roc_auc"),
        F.when(both, F.col("__a") / p).alias("pr_auc"),
    )


def full_metrics(
    df: DataFrame, keys: Sequence[str], label: str, score: str, predicted: str, empty: float | None = 0.0,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Confusion counts, rates and both areas per key."""
    counts = rates(confusion(df, keys, label, predicted), empty)
    area = areas(curve(df, keys, label, score, rows_per_slice), keys)
    if keys:
        return counts.join(area, list(keys))
    got = scalars(area)
    return counts.withColumns({"roc_auc": got["roc_auc"], "pr_auc": got["pr_auc"]})


def histogram(df: DataFrame, label: str, score: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over each class's own range: label, bin, low, high, n (empty bins included)."""
    ranges = df.groupBy(label).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    spans = ranges.withColumn("__w", width)
    b = F.when(F.col("__w") == 0, 0).otherwise(
        F.least(F.floor((F.col(score) - F.col("__lo")) / F.col("__w")), F.lit(bins - 1))
    )
    counts = (
        df.select(label, score)
        .join(lookup_hint(df, [label])(spans), label)
        .groupBy(label, b.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = spans.select(label, "__lo", "__w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, [label, "bin"], "left").select(
        label,
        "bin",
        (F.col("__lo") + F.col("bin") * F.col("__w")).alias("low"),
        (F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def composition(df: DataFrame, split: str, label: str, source: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, share and class make-up per split."""
    cols = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == 0).alias("benign"),
        F.count_if(F.col(label) == 1).alias("malicious"),
    ]
    if source is None:
        per = df.groupBy(*keys, split).agg(*cols)
    else:
        first = df.groupBy(*keys, split, source).agg(*cols)
        per = first.groupBy(*keys, split).agg(
            F.sum("rows").alias("rows"), F.sum("benign").alias("benign"), F.sum("malicious").alias("malicious"),
            F.count(F.lit(1)).alias("sources"),
        )
    if keys:
        totals = per.groupBy(*keys).agg(F.sum("rows").alias("__t"))
        per = per.join(totals, list(keys))
    else:
        per = per.withColumn("__t", scalars(per.agg(F.sum("rows").alias("t")))["t"])
    return per.withColumns(
        {
            "row_fraction": F.col("rows") / F.col("__t"),
            "malicious_percent": divide(100.0 * F.col("malicious"), F.col("rows")),
        }
    ).drop("__t")


def source_table(df: DataFrame, source: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per source its lowest label, number of distinct labels and rows."""
    cells = df.groupBy(*keys, source, label).agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(*keys, source).agg(
        F.min(label).alias("label"), F.count(label).alias("n_labels"), F.sum("n").alias("rows")
    )


def banner(df: DataFrame, dataset: str, source: str, label: str, ts: str) -> DataFrame:
    """Rows by class, distinct sources and time range per dataset."""
    per = df.groupBy(dataset, source).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == 0).alias("benign"),
        F.count_if(F.col(label) == 1).alias("malicious"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )
    return per.groupBy(dataset).agg(
        F.sum("rows").alias("rows"), F.sum("benign").alias("benign"), F.sum("malicious").alias("malicious"),
        F.count(F.lit(1)).alias("sources"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )


def changed_decisions(df: DataFrame, keys: Sequence[str], label: str, before: str, after: str) -> DataFrame:
    """Corrected and introduced errors of both kinds, and all changed decisions."""
    y, b, a = F.col(label), F.col(before), F.col(after)
    return df.groupBy(*keys).agg(
        F.count_if((y == 0) & (b == 1) & (a == 0)).alias("corrected_fp"),
        F.count_if((y == 0) & (b == 0) & (a == 1)).alias("introduced_fp"),
        F.count_if((y == 1) & (b == 0) & (a == 1)).alias("rescued_fn"),
        F.count_if((y == 1) & (b == 1) & (a == 0)).alias("introduced_fn"),
        F.count_if(b != a).alias("changed"),
    )


def fold_stability(folds: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population std, min and max of each metric over folds."""
    long = unpivot(folds, keys, metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
