"""Median imputation, signed-log robust scaling and class weights: fit to a small table, transform by it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import number_from_text, robust_scale, signed_log1p
from .columns import q
from .ordered import bounded_broadcast, exact_quantiles, scalars, unpivot


def medians(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Null-skipping median per feature (and key): keys, feature, n, median."""
    long = unpivot(df, keys, features)
    out = exact_quantiles(long, [*keys, "feature"], "value", [0.5])
    return out.select(*keys, "feature", F.col("n").cast("long").alias("n"), F.col("q")[0].alias("median"))


def collect_state(table: DataFrame, features: Sequence[str]) -> dict[str, dict]:
    """Per-feature statistics on the driver; a table of one row per feature."""
    rows = {r["feature"]: r.asDict() for r in table.limit(len(features) + 1).collect()}
    missing = [f for f in features if f not in rows]
    if missing:
        raise ValueError(f"no usable value in {missing}")
    return rows


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({f: F.coalesce(q(f).cast("double"), F.lit(float(v))) for f, v in values.items()})


def robust_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Median and quartiles of signed-log values: feature, median, iqr."""
    logged = df.select(*[signed_log1p(q(f)).alias(f) for f in features])
    out = exact_quantiles(unpivot(logged, [], features), ["feature"], "value", [0.25, 0.5, 0.75])
    return out.select("feature", F.col("q")[1].alias("center"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


@dataclass
class RobustPreprocessor:
    """Fitted state: impute by median, compress by signed log, scale by median and quartile range."""

    features: list[str]
    state: dict[str, dict]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str]) -> "RobustPreprocessor":
        """Fits on exactly the rows of ``df``; the caller decides that scope."""
        features = list(features)
        numeric = df.select(*[number_from_text(q(f)).alias(f) for f in features])
        fill = collect_state(medians(numeric, features), features)
        filled = impute(numeric, {f: fill[f]["median"] for f in features})
        scale = collect_state(robust_stats(filled, features), features)
        state = {f: {"median": fill[f]["median"], "center": scale[f]["center"], "iqr": scale[f]["iqr"]} for f in features}
        return cls(features, state)

    def transform(self, df: DataFrame) -> DataFrame:
        """Same rows with every feature imputed and scaled; other columns as they are."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"input lacks fitted features {missing}")
        out = {}
        for f, s in self.state.items():
            value = F.coalesce(number_from_text(q(f)), F.lit(s["median"]))
            out[f] = robust_scale(signed_log1p(value), F.lit(s["center"]), F.lit(s["iqr"]))
        return df.withColumns(out)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f, s["median"], s["center"], s["iqr"]) for i, (f, s) in enumerate(self.state.items())]
        return spark.createDataFrame(rows, "position int, feature string, median double, center double, iqr double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("errorifexists").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RobustPreprocessor":
        rows = spark.read.parquet(path).orderBy("position").collect()
        return cls([r["feature"] for r in rows], {r["feature"]: {k: r[k] for k in ("median", "center", "iqr")} for r in rows})


def fold_impute(df: DataFrame, fold: str, features: Sequence[str], folds: Sequence[int]) -> DataFrame:
    """Rows of every fold imputed by the medians of all other folds (columns ``<feature>_imputed``)."""
    other = F.array([F.lit(f) for f in folds])
    train = df.select(
        F.explode(F.array_except(other, F.array(F.col(fold)))).alias("__fold"), *[q(f) for f in features]
    )
    fitted = medians(train, features, ["__fold"])
    wide = fitted.groupBy("__fold").pivot("feature", list(features)).agg(F.first("median"))
    wide = wide.select(F.col("__fold").alias("__f"), *[q(f).alias(f"__m_{f}") for f in features])
    joined = df.join(bounded_broadcast(wide), df[fold] == F.col("__f"), "left")
    return joined.withColumns({f"{f}_imputed": F.coalesce(q(f), q(f"__m_{f}")) for f in features}).drop(
        "__f", *[f"__m_{f}" for f in features]
    )


def benign_baseline(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Median and quartile range of signed-log benign values; a zero range counts as 1."""
    benign = df.where(F.col(label) == 0).select(*[signed_log1p(number_from_text(q(f))).alias(f) for f in features])
    out = exact_quantiles(unpivot(benign, [], features), ["feature"], "value", [0.25, 0.5, 0.75])
    iqr = F.col("q")[2] - F.col("q")[0]
    return out.select(
        "feature", F.col("q")[1].alias("median"), F.when(F.abs(iqr) > 1e-12, iqr).otherwise(1.0).alias("iqr")
    )


def class_weights(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Balanced weight per class: n / (classes * n_class)."""
    per = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        total = scalars(per.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("c")))
        return per.select(label, "n", (total["t"] / (total["c"] * F.col("n"))).alias("weight"))
    totals = per.groupBy(*keys).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("c"))
    return per.join(totals, list(keys)).select(*keys, label, "n", (F.col("t") / (F.col("c") * F.col("n"))).alias("weight"))

