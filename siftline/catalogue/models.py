"""Fit and transform (L) and training jobs (B7, B8, B12)."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.decision import decide
from ..operators import alignment, columns, metrics, models, prep, reporting, sequence, splits, temporal
from ..plans import jobs
from ..session import cut_lineage, stored
from .base import FEATURES, SCORES, T1, flows, items, query, r, sql_log, sql_number, table
from .temporal import history

RAW = sql_number("bytes_per_s_raw")
STATIC = ["fwd_len_mean", "fwd_len_std", "flow_iat_std"]
FIT_FEATURES = ["fwd_len_mean", "flow_iat_std", "bytes_per_s_raw"]


def _l1_sql(select):
    parts, outs = [], []
    for f, e in (("fwd_len_mean", "fwd_len_mean"), ("flow_iat_std", "flow_iat_std"), ("bytes_per_s_raw", f"({RAW})")):
        parts.append(f"m_{f} AS (SELECT median({e}) AS m FROM flows WHERE split = 'train')")
        filled = f"coalesce({e}, (SELECT m FROM m_{f}))"
        parts.append(f"s_{f} AS (SELECT median(x) AS c, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS q FROM (SELECT {sql_log(filled)} AS x FROM flows WHERE split = 'train'))")
        outs.append(f"{r(f'({sql_log(filled)} - (SELECT c FROM s_{f})) / (SELECT CASE WHEN q = 0 THEN 1 ELSE q END FROM s_{f})')} AS {f}")
    return f"WITH {', '.join(parts)} SELECT row_id, {', '.join(outs)} FROM flows {select}"


@query("L1", _l1_sql(""))
def l1(spark, d):
    df = flows(spark, d)
    fitted = prep.RobustPreprocessor.fit(df.where("split = 'train'"), FIT_FEATURES)
    return fitted.transform(df).select("row_id", *FIT_FEATURES)


@query("L1_stored", _l1_sql("WHERE split = 'test'"))
def l1_stored(spark, d):
    """State saved, loaded and applied to test rows."""
    from ..session import scratch_path

    df, path = flows(spark, d), scratch_path(spark, "prep")
    prep.RobustPreprocessor.fit(df.where("split = 'train'"), FIT_FEATURES).save(spark, path)
    return prep.RobustPreprocessor.load(spark, path).transform(df.where("split = 'test'")).select("row_id", *FIT_FEATURES)


@query("L2", _l1_sql("WHERE split = 'validation'"))
def l2(spark, d):
    """Fit on train; transform, select and lock the column order on validation."""
    df = flows(spark, d)
    fitted = prep.RobustPreprocessor.fit(df.where("split = 'train'"), FIT_FEATURES)
    ready = fitted.transform(df.where("split = 'validation'").drop("rf_probability"))
    return ready.select("row_id", *[columns.q(f) for f in fitted.features])


@query("L3", f"""WITH g AS (SELECT *, CAST(floor(user_id / 5) AS BIGINT) % 3 + 1 AS fold, {RAW} AS rate FROM flows), m AS (SELECT k, median(rate) AS m FROM g, (VALUES (1), (2), (3)) AS t(k) WHERE fold <> k GROUP BY k)
SELECT row_id, CAST(fold AS INT) AS fold, {r('coalesce(rate, m)')} AS rate_imputed FROM g JOIN m ON m.k = g.fold""")
def l3(spark, d):
    df = flows(spark, d).withColumn("fold", (F.floor(F.col("user_id") / 5) % 3 + 1).cast("int"))
    df = columns.numeric(df, ["bytes_per_s_raw"]).withColumnRenamed("bytes_per_s_raw", "rate")
    return prep.fold_impute(df, "fold", ["rate"], [1, 2, 3]).select("row_id", "fold", "rate_imputed")


FOREST_FEATURES = [*STATIC, "InterFlow Delta", *K.rolling_names(FEATURES)]


@query("L4")
def l4(spark, d):
    df = stored(history(spark, d), "history")
    forest = models.Forest.fit(df.where("split = 'train'"), FOREST_FEATURES, "label")
    return forest.score(df.where("split = 'test'")).select("row_id", "label", "rf_probability")


@query("L5")
def l5(spark, d):
    out = jobs.forest_job(
        flows(spark, d), source="source_file", src_ip="src_ip", dst_ip="dst_ip", ts="ts", row_id="row_id", label="label",
        static=STATIC, rolling=FEATURES, folds=3,
    )
    return out["oof"]


def nested_rows(spark, d):
    """Both data sets with five outer folds by source and three inner ones across them."""
    df = flows(spark, d).withColumns({
        "outer": (F.floor(F.col("user_id") / 10) % 5 + 1).cast("int"),
        "inner": (F.floor(F.col("user_id") / 10) % 3 + 1).cast("int"),
    })
    df = cut_lineage(df.select("row_id", "dataset", "label", "outer", "inner", *STATIC))
    return {ds: df.where(F.col("dataset") == ds) for ds in ("dsA", "dsB")}


def inner_runs(spark, d, grid):
    return models.tune(
        nested_rows(spark, d), grid, features=STATIC, label="label", outer="outer", inner="inner", outer_folds=5, inner_folds=3, keep=["row_id"]
    )


@query("L6")
def l6(spark, d):
    """The focused grid on two data sets, five outer and three inner folds; equal-weight ranking."""
    runs = cut_lineage(inner_runs(spark, d, models.forest_grid("focused")))
    summary = reporting.equal_weight_summary(runs, "config_id", "dataset", ["pr_auc", "recall_tpr", "f1"])
    order = [F.col("pr_auc_mean").desc(), F.col("pr_auc_min").desc(), F.col("recall_tpr_mean").desc(), F.col("f1_mean").desc(), F.col("pr_auc_std"), F.col("config_id")]
    return reporting.rank_rows(summary, order)


@query("L6_nested")
def l6_nested(spark, d):
    """Metrics on the outer folds, each scored with the configuration that its own inner folds chose; two depths of a smaller forest."""
    grid = models.one_factor_grid({**K.FOREST, "numTrees": 64}, {"maxDepth": [10]})
    frames = nested_rows(spark, d)
    runs = cut_lineage(models.tune(
        frames, grid, features=STATIC, label="label", outer="outer", inner="inner", outer_folds=5, inner_folds=3, keep=["row_id"]
    ))
    chosen = {r["outer_fold"]: r["config_id"] for r in models.chosen_by_outer_fold(runs).collect()}  # a row per fold
    oof = models.nested_out_of_fold(frames, grid, chosen, features=STATIC, label="label", outer="outer", keep=["row_id"])
    return metrics.full_metrics(cut_lineage(oof), ["dataset", "outer", "config_id"], "label", "rf_probability", "predicted", empty=None)


@query("L7")
def l7(spark, d):
    df = flows(spark, d)
    forest = models.IsolationForest.fit(df.where("split = 'train' AND label = 0"), STATIC, "row_id")
    return forest.score(df.where("split <> 'train'")).select("row_id", "label", "anomaly_score")


def wide_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.when(F.col("label") < 8, 0).otherwise(1).alias("label"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


@query("L8")
def l8(spark, d):
    df = wide_embeddings(spark, d)
    fitted = models.Reconstruction.fit(df, [f"e{i}" for i in range(64)], "label")
    return fitted.score(df).select("vec_id", "label", "anomaly_score")


@query("L9", f"""WITH p AS (SELECT row_id, avg(CAST(CAST(fwd_len_mean AS FLOAT) AS DOUBLE)) OVER (PARTITION BY split, source_file ORDER BY ts, row_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v FROM flows) SELECT row_id, round(v, 3) AS probability FROM p""")
def l9(spark, d):
    """Sequences scored in batches by a supplied function, here the mean of the unpadded steps."""
    def scorer(block):
        import numpy as np

        real = np.where(block[:, :, 0] > -1e5, block[:, :, 0].astype(float), np.nan)
        return np.nanmean(real, axis=1)

    seq = sequence.sliding_sequences(flows(spark, d), ["split", "source_file"], "ts", "row_id", ["fwd_len_mean"], 20)
    return sequence.score_sequences(seq, scorer, ["row_id"]).withColumn("probability", F.round("probability", 3))


@query("L10")
def l10(spark, d):
    return jobs.arbiter_scores(
        flows(spark, d), split="split", source="source_file", src_ip="src_ip", dst_ip="dst_ip", ts="ts", row_id="row_id", label="label",
        static=STATIC, rolling=FEATURES,
    ).select("row_id", "split", "source_file", "position", "label", "rf_probability")


def _transfer_sql():
    return _l1_sql("WHERE dataset = 'dsB'").replace("WHERE split = 'train'", "WHERE dataset = 'dsA'")


@query("L11", _transfer_sql())
def l11(spark, d):
    """State of one dataset applied to all rows of the other."""
    df = flows(spark, d)
    fitted = prep.RobustPreprocessor.fit(df.where("dataset = 'dsA'"), FIT_FEATURES)
    return fitted.transform(df.where("dataset = 'dsB'")).select("row_id", *FIT_FEATURES)


@query("L11_forest")
def l11_forest(spark, d):
    df = stored(history(spark, d), "history")
    got = jobs.forest_transfer(df.where("dataset = 'dsA'"), df.where("dataset = 'dsB'"), FOREST_FEATURES, "label")
    return metrics.full_metrics(got, ["dataset"], "label", "rf_probability", "predicted")


@query("B7")
def b7(spark, d):
    """Training table of the sequence scorer: scaled rows and warped copies as sequences with sample weights."""
    from ..operators.augment import sample_weights, timewarp

    df = flows(spark, d).where("split = 'train'")
    fitted = prep.RobustPreprocessor.fit(df, FIT_FEATURES)
    copies = timewarp(df, source="source_file", label="label", timing=["flow_iat_std"], rates=["bytes_per_s_raw"])
    copies = copies.select(*df.columns, F.lit(True).alias("augmented"))
    rows = fitted.transform(df.withColumn("augmented", F.lit(False)).unionByName(copies.withColumn("bytes_per_s_raw", F.col("bytes_per_s_raw").cast("string"))))
    seq = sequence.sliding_sequences(rows, ["source_file"], "ts", "row_id", FIT_FEATURES, 20, stride=5)
    weighted = sample_weights(seq, prep.class_weights(df, "label"), "label")
    return weighted.select("row_id", "source_file", "label", "augmented", "position", "sequence_length", "sample_weight")


@query("B8")
def b8(spark, d):
    got = jobs.one_class_job(flows(spark, d), split="split", label="label", row_id="row_id", features=FIT_FEATURES)
    return got["metrics"]


@query("B8_reconstruction")
def b8_reconstruction(spark, d):
    got = jobs.one_class_job(
        flows(spark, d), split="split", label="label", row_id="row_id", features=FIT_FEATURES, detector="reconstruction"
    )
    return got["metrics"]


@query("B12")
def b12(spark, d):
    """Inner-fold metrics of the focused grid with their stability."""
    df = flows(spark, d).withColumn("inner", (F.floor(F.col("user_id") / 10) % 3 + 1).cast("int"))
    df = cut_lineage(df.select("row_id", "label", "inner", *STATIC))
    oof, _ = models.out_of_fold_grid(
        df, models.forest_grid("focused"), features=STATIC, label="label", fold="inner", folds=3, keep=["row_id"]
    )
    folds = metrics.full_metrics(cut_lineage(oof), ["config_id", "inner"], "label", "rf_probability", "predicted", empty=None)
    return metrics.fold_stability(folds, ["f1", "recall_tpr", "pr_auc"], ["config_id"])
