"""Aggregations (A) and calibration (C)."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.decision import decide, error_type
from ..operators import augment, calibrate, forensic, metrics, prep, reporting
from ..operators.ordered import exact_quantiles, unpivot
from .base import (
    FEATURES, SCORES, SQL_DECISIONS, T1, T2, T3, flows, items, query, r, sql_confusion, sql_error_type, sql_log, sql_metrics,
    sql_number, sql_rates, table,
)
from .temporal import SQL_FOLDS, SQL_POSITION, fold_results, history, sql_history

ITEM_FEATURES = ["quantity", "price", "discount", "tax"]
RAW = sql_number("bytes_per_s_raw")


def predicted(spark, d):
    return flows(spark, d).withColumns(
        {f"{m}_pred": decide(F.col(f"{m}_probability"), t) for m, t in (("lstm", T1), ("litemv", T2), ("rf", T3))}
    )


def model_rows(spark, d):
    """One row per flow and model: score, threshold, decision."""
    df = predicted(spark, d)
    each = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.col(f"{m}_probability").alias("score"), F.lit(t).alias("threshold"), F.col(f"{m}_pred").alias("predicted"))
            for m, t in (("lstm", T1), ("litemv", T2), ("rf", T3))
        ]
    )
    return df.select("*", F.explode(each).alias("m")).select(*df.columns, "m.*")


SQL_MODELS = " UNION ALL ".join(
    f"SELECT *, '{m}' AS model, {m}_probability AS score, CAST({t} AS DOUBLE) AS threshold, CAST({m}_probability >= {t} AS INT) AS predicted FROM flows"
    for m, t in (("lstm", T1), ("litemv", T2), ("rf", T3))
)


def model_ledger(spark, d):
    df = model_rows(spark, d)
    return df.withColumns(
        {
            "error_type": error_type(F.col("label"), F.col("predicted")),
            "signed_margin": F.col("score") - F.col("threshold"),
            "abs_margin": F.abs(F.col("score") - F.col("threshold")),
        }
    )


SQL_LEDGER = f"SELECT *, {sql_error_type()} AS error_type, score - threshold AS signed_margin, abs(score - threshold) AS abs_margin FROM ({SQL_MODELS})"


@query("A1", "SELECT dataset, source_file, min(label) AS label, count(DISTINCT label) AS n_labels, count(*) AS rows FROM flows GROUP BY ALL")
def a1(spark, d):
    return metrics.source_table(flows(spark, d), "source_file", "label", ["dataset"])


@query("A2", f"""WITH c AS (SELECT dataset, split, count(*) AS rows, count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label = 1) AS malicious, count(DISTINCT source_file) AS sources FROM flows GROUP BY 1, 2)
SELECT dataset, split, CAST(rows AS BIGINT) AS rows, benign, malicious, sources, {r('CAST(rows AS DOUBLE) / sum(rows) OVER (PARTITION BY dataset)')} AS row_fraction, {r('100.0 * malicious / rows')} AS malicious_percent FROM c""")
def a2(spark, d):
    return metrics.composition(flows(spark, d), "split", "label", "source_file", ["dataset"])


A3_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count({e}) AS n, {r(f'median({e})')} AS median FROM flows"
    for f, e in (("fwd_len_mean", "fwd_len_mean"), ("flow_iat_std", "flow_iat_std"), ("rate", f"({RAW})"))
)


def _a3(spark, d, **options):
    from ..functions.numeric import number_from_text

    df = flows(spark, d).withColumn("rate", number_from_text(F.col("bytes_per_s_raw")))
    long = unpivot(df, [], ["fwd_len_mean", "flow_iat_std", "rate"])
    out = exact_quantiles(long, ["feature"], "value", [0.5], **options)
    return out.select("feature", F.col("n").cast("long").alias("n"), F.col("q")[0].alias("median"))


@query("A3", A3_SQL)
def a3(spark, d):
    return _a3(spark, d)


@query("A3_bracketed", A3_SQL)
def a3_bracketed(spark, d):
    """The same medians under their second name: sketch brackets, then exact ranks inside them."""
    return _a3(spark, d)


A4_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {r(f'median({sql_log(f)})')} AS center, {r(f'quantile_cont({sql_log(f)}, 0.75) - quantile_cont({sql_log(f)}, 0.25)')} AS iqr FROM items"
    for f in ITEM_FEATURES
)


@query("A4", A4_SQL)
def a4(spark, d):
    return prep.robust_stats(items(spark, d), ITEM_FEATURES)


@query("A5", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {r('m')} AS median, {r('CASE WHEN abs(i) > 1e-12 THEN i ELSE 1.0 END')} AS iqr FROM (SELECT median(x) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS i FROM (SELECT {sql_log(e)} AS x FROM flows WHERE label = 0))"
    for f, e in (("fwd_len_mean", "fwd_len_mean"), ("flow_iat_std", "flow_iat_std"), ("bytes_per_s_raw", f"({RAW})"))
))
def a5(spark, d):
    return prep.benign_baseline(flows(spark, d), "label", ["fwd_len_mean", "flow_iat_std", "bytes_per_s_raw"])


@query("A6", f"SELECT dataset, model, {sql_confusion('predicted')} FROM ({SQL_MODELS}) GROUP BY 1, 2")
def a6(spark, d):
    return metrics.confusion(model_rows(spark, d), ["dataset", "model"], "label", "predicted")


@query("A7", f"WITH c AS (SELECT dataset, split, model, {sql_confusion('predicted')} FROM ({SQL_MODELS}) GROUP BY 1, 2, 3) SELECT dataset, split, model, tn, fp, fn, tp, {sql_rates()} FROM c")
def a7(spark, d):
    return metrics.rates(metrics.confusion(model_rows(spark, d), ["dataset", "split", "model"], "label", "predicted"))


def sql_curve(rows: str, keys: str) -> str:
    """CTEs s (counts per score) and k (curve points, threshold at or above the score)."""
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""WITH s AS (SELECT {lead}score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM ({rows}) GROUP BY {lead}score),
k0 AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n,
  lead(pos) OVER w AS lower_pos, lead(neg) OVER w AS lower_neg, row_number() OVER w AS i FROM s WINDOW w AS ({part} ORDER BY score DESC)),
k AS (SELECT *, CAST(tps AS DOUBLE) / (tps + fps) AS precision, CAST(tps AS DOUBLE) / p AS recall, CAST(fps AS DOUBLE) / n AS fpr,
  (i = 1 OR lower_pos IS NULL OR lower_pos <> pos OR lower_neg <> neg) AS corner FROM k0)"""


@query("A8", f"{sql_curve(SQL_MODELS, 'dataset, model')} SELECT dataset, model, {r('sum(CAST(neg AS DOUBLE) * (tps - pos / 2)) / (max(p) * CAST(max(n) AS DOUBLE))')} AS roc_auc FROM k GROUP BY 1, 2")
def a8(spark, d):
    return metrics.areas(metrics.curve(model_rows(spark, d), ["dataset", "model"], "label", "score"), ["dataset", "model"]).drop("pr_auc")


@query("A8_pairs", f"""SELECT {r("sum(CASE WHEN b.x > a.x THEN 1.0 WHEN b.x = a.x THEN 0.5 ELSE 0.0 END * a.n * b.n) / (max(a.t) * CAST(max(b.t) AS DOUBLE))")} AS roc_auc
FROM (SELECT rf_probability AS x, count(*) AS n, sum(count(*)) OVER () AS t FROM flows WHERE label = 0 GROUP BY 1) a, (SELECT rf_probability AS x, count(*) AS n, sum(count(*)) OVER () AS t FROM flows WHERE label = 1 GROUP BY 1) b""")
def a8_pairs(spark, d):
    """One global curve in slices, against the definition over all pairs."""
    return metrics.areas(metrics.curve(flows(spark, d), [], "label", "rf_probability"), []).drop("pr_auc")


@query("A9", f"{sql_curve(SQL_MODELS, 'dataset, model')} SELECT dataset, model, {r('sum(pos * precision) / max(p)')} AS pr_auc FROM k GROUP BY 1, 2")
def a9(spark, d):
    keys = ["dataset", "model"]
    return metrics.areas(metrics.curve(model_rows(spark, d), keys, "label", "score"), keys).drop("roc_auc")


@query("A10", f"{sql_curve(SQL_MODELS, 'dataset, model')} SELECT dataset, model, {r('score')} AS score, CAST(tps AS BIGINT) AS tps, CAST(fps AS BIGINT) AS fps, {r('precision')} AS precision, {r('recall')} AS recall, {r('fpr')} AS fpr, corner FROM k")
def a10(spark, d):
    got = metrics.curve(model_rows(spark, d), ["dataset", "model"], "label", "score")
    return got.select("dataset", "model", "score", "tps", "fps", "precision", "recall", "fpr", "corner")


@query("A11", f"""WITH e AS (SELECT model, source_file, {sql_confusion('predicted')} FROM ({SQL_MODELS}) GROUP BY 1, 2)
SELECT model, source_file, tn, fp, fn, tp, tn + fp + fn + tp AS rows, {r('CASE WHEN tn + fp <> 0 THEN CAST(fp AS DOUBLE) / (tn + fp) END')} AS source_fpr, {r('CASE WHEN fn + tp <> 0 THEN CAST(fn AS DOUBLE) / (fn + tp) END')} AS source_fnr,
{r('CAST(fp + fn AS DOUBLE) / (tn + fp + fn + tp)')} AS source_error_rate, {r('CAST(fp AS DOUBLE) / sum(fp) OVER (PARTITION BY model)')} AS share_of_fp, {r('CAST(fn AS DOUBLE) / sum(fn) OVER (PARTITION BY model)')} AS share_of_fn FROM e""")
def a11(spark, d):
    return forensic.errors_by_source(model_ledger(spark, d), ["model"], "source_file")


@query("A12", f"""SELECT dataset, source_file, count(*) AS rows, CAST(CASE WHEN min(label) = max(label) THEN min(label) ELSE -1 END AS INT) AS actual_label,
count(*) FILTER (WHERE lstm_pred = 1) AS predicted_positive, count(*) FILTER (WHERE lstm_pred <> label) AS errors, {r('avg(lstm_probability)')} AS mean_lstm_probability, {r('avg(rf_probability)')} AS mean_rf_probability,
{r('median(lstm_probability)')} AS median_lstm_probability, {r('median(rf_probability)')} AS median_rf_probability FROM (SELECT *, {SQL_DECISIONS} FROM flows) GROUP BY 1, 2""")
def a12(spark, d):
    return reporting.transfer_by_source(
        predicted(spark, d), ["dataset"], "source_file", "label", "lstm_pred", ["lstm_probability", "rf_probability"], medians=True
    )


@query("A14", f"""WITH w AS (SELECT label, concat_ws('|', CASE WHEN lstm_pred <> label THEN 'lstm' END, CASE WHEN litemv_pred <> label THEN 'litemv' END, CASE WHEN rf_pred <> label THEN 'rf' END) AS names,
CAST(lstm_pred <> label AS INT) + CAST(litemv_pred <> label AS INT) + CAST(rf_pred <> label AS INT) AS k FROM (SELECT *, {SQL_DECISIONS} FROM flows))
SELECT label, CASE WHEN names = '' THEN 'none' ELSE names END AS wrong_models, k AS models_wrong, count(*) AS n FROM w GROUP BY ALL""")
def a14(spark, d):
    return forensic.overlap_counts(overlap(spark, d), [], "label")


def overlap(spark, d):
    from ..operators.alignment import error_overlap

    led = model_ledger(spark, d)
    parts = {m: led.where(F.col("model") == m).select("row_id", "error_type") for m in ("lstm", "litemv", "rf")}
    return error_overlap(flows(spark, d).select("row_id", "source_file", "label"), parts, "row_id", "error_type")


def item_ledger(spark, d):
    df = items(spark, d).withColumn("predicted", decide(F.col("score"), 0.5))
    return df.withColumn("error_type", error_type(F.col("label"), F.col("predicted")))


SQL_ITEM_LONG = (
    "WITH l AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CASE WHEN (label = 0) THEN 'FP_vs_TN' ELSE 'FN_vs_TP' END AS comparison, CAST(CAST(score >= 0.5 AS INT) <> label AS INT) AS e, {f} AS v FROM items"
        for f in ITEM_FEATURES
    ) + ")"
)


@query("A15", f"""{SQL_ITEM_LONG}, q AS (SELECT comparison, feature, e, count(*) AS n, quantile_cont(v, 0.25) AS q1, median(v) AS m, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY ALL)
SELECT a.comparison, a.feature, a.n AS error_n, b.n AS reference_n, {r('a.q1')} AS error_q1, {r('a.m')} AS error_median, {r('a.q3')} AS error_q3, {r('b.q1')} AS reference_q1, {r('b.m')} AS reference_median, {r('b.q3')} AS reference_q3,
{r('a.m - b.m')} AS median_difference, {r('CASE WHEN b.q3 - b.q1 > 0 THEN (a.m - b.m) / (b.q3 - b.q1) END')} AS robust_shift FROM q a JOIN q b ON a.comparison = b.comparison AND a.feature = b.feature AND a.e = 1 AND b.e = 0""")
def a15(spark, d):
    return forensic.feature_quartiles(item_ledger(spark, d), [], ITEM_FEATURES)


@query("A16", f"""{SQL_ITEM_LONG}, rk AS (SELECT comparison, feature, e, rank() OVER (PARTITION BY comparison, feature ORDER BY v) + (count(*) OVER (PARTITION BY comparison, feature, v) - 1) / 2 AS k FROM l),
s AS (SELECT comparison, feature, count(*) FILTER (WHERE e = 1) AS n_error, count(*) FILTER (WHERE e = 0) AS n_reference, sum(k) FILTER (WHERE e = 1) AS rs FROM rk GROUP BY 1, 2)
SELECT comparison, feature, n_error, n_reference, {r('rs - CAST(n_error AS DOUBLE) * (n_error + 1) / 2', 1)} AS u, {r('2 * (rs - CAST(n_error AS DOUBLE) * (n_error + 1) / 2) / (CAST(n_error AS DOUBLE) * n_reference) - 1')} AS effect FROM s""")
def a16(spark, d):
    rows = forensic._contrast_rows(item_ledger(spark, d), [], ITEM_FEATURES)
    got = forensic.rank_statistics(rows, ["comparison", "feature"], "is_error", "value")
    return got.select("comparison", "feature", "n_error", "n_reference", F.round("u", 1).alias("u"), "effect")


# The p-value of z by the rational series below 2 and the continued fraction from there on, x = z / sqrt(2).
_SQL_ERFC = (
    "CASE WHEN x < 2 THEN 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 61), lambda n: x * exp(n * ln(greatest(2 * x * x, 1e-300)) "
    "- list_sum(list_transform(range(0, n + 1), lambda m: ln(2.0 * m + 1)))))) "
    "ELSE exp(-x * x) / sqrt(pi()) / list_reduce(list_prepend(x, list_transform(range(120, 0, -1), lambda k: CAST(k AS DOUBLE))), lambda a, k: x + k / 2 / a) END"
)


@query("A16_p", f"""{SQL_ITEM_LONG}, q AS (SELECT comparison, feature, e, count(*) AS n, quantile_cont(v, 0.25) AS q1, median(v) AS m, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY ALL),
rk AS (SELECT comparison, feature, e, v, rank() OVER (PARTITION BY comparison, feature ORDER BY v) + (count(*) OVER (PARTITION BY comparison, feature, v) - 1) / 2 AS k FROM l),
ties AS (SELECT comparison, feature, sum(t * t * t - t) AS tie_sum FROM (SELECT comparison, feature, CAST(count(*) AS DOUBLE) AS t FROM l GROUP BY comparison, feature, v) GROUP BY 1, 2),
s AS (SELECT comparison, feature, CAST(count(*) FILTER (WHERE e = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE e = 0) AS DOUBLE) AS n0, sum(k) FILTER (WHERE e = 1) AS rs FROM rk GROUP BY 1, 2),
u AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u, n1 + n0 AS n FROM s JOIN ties USING (comparison, feature)),
z AS (SELECT *, greatest(0, (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * ((n + 1) - tie_sum / (n * (n - 1))))) / sqrt(2) AS x FROM u),
p AS (SELECT *, 2 * u / (n1 * n0) - 1 AS effect, least(1.0, {_SQL_ERFC}) AS p_value FROM z),
raw AS (SELECT *, row_number() OVER w AS i, p_value * count(p_value) OVER (PARTITION BY comparison) / row_number() OVER w AS raw FROM p WINDOW w AS (PARTITION BY comparison ORDER BY p_value, feature)),
f AS (SELECT *, least(1.0, greatest(0.0, min(raw) OVER (PARTITION BY comparison ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS q_value FROM raw)
SELECT a.comparison, a.feature, a.n AS error_n, b.n AS reference_n, {r('a.q1')} AS error_q1, {r('a.m')} AS error_median, {r('a.q3')} AS error_q3, {r('b.q1')} AS reference_q1, {r('b.m')} AS reference_median, {r('b.q3')} AS reference_q3,
{r('a.m - b.m')} AS median_difference, {r('CASE WHEN b.q3 - b.q1 > 0 THEN (a.m - b.m) / (b.q3 - b.q1) END')} AS robust_shift, {r('f.u')} AS u, {r('f.effect')} AS effect, {r('f.p_value')} AS p_value, {r('f.q_value')} AS q_value,
{r('abs(f.effect)')} AS abs_effect, f.q_value < 0.05 AS significant, CASE WHEN f.effect > 0 THEN 'ErrorHigher' WHEN f.effect < 0 THEN 'ErrorLower' ELSE 'NoDirectionalEffect' END AS direction
FROM q a JOIN q b ON a.comparison = b.comparison AND a.feature = b.feature AND a.e = 1 AND b.e = 0 JOIN f ON f.comparison = a.comparison AND f.feature = a.feature""")
def a16_p(spark, d):
    return forensic.feature_contrasts(item_ledger(spark, d), [], ITEM_FEATURES)


@query("R4", f"""{SQL_ITEM_LONG}, rk AS (SELECT comparison, feature, e, rank() OVER (PARTITION BY comparison, feature ORDER BY v) + (count(*) OVER (PARTITION BY comparison, feature, v) - 1) / 2 AS k FROM l),
s AS (SELECT comparison, feature, count(*) FILTER (WHERE e = 1) AS n1, count(*) FILTER (WHERE e = 0) AS n0, sum(k) FILTER (WHERE e = 1) AS rs FROM rk GROUP BY 1, 2),
t AS (SELECT comparison, feature, 2 * (rs - CAST(n1 AS DOUBLE) * (n1 + 1) / 2) / (CAST(n1 AS DOUBLE) * n0) - 1 AS effect FROM s)
SELECT comparison, feature, {r('effect')} AS effect, k AS effect_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY comparison ORDER BY abs(effect) DESC, feature) AS INT) AS k FROM t) WHERE k <= 2""")
def r4(spark, d):
    rows = forensic._contrast_rows(item_ledger(spark, d), [], ITEM_FEATURES)
    stats = forensic.rank_statistics(rows, ["comparison", "feature"], "is_error", "value").withColumn("abs_effect", F.abs("effect"))
    return forensic.top_effects(stats, [], 2).select("comparison", "feature", "effect", "effect_rank")


@query("R5", f"""WITH l AS ({SQL_LEDGER}), p AS (SELECT *, row_number() OVER (PARTITION BY model, error_type ORDER BY abs_margin, row_id) AS a, row_number() OVER (PARTITION BY model, error_type ORDER BY abs_margin DESC, row_id) AS z FROM l WHERE error_type IN ('FP', 'FN'))
SELECT model, error_type, row_id, {r('abs_margin')} AS abs_margin, CASE WHEN a = 1 AND z = 1 THEN 'borderline_and_high_confidence' WHEN a = 1 THEN 'borderline' ELSE 'high_confidence' END AS representative_kind FROM p WHERE a = 1 OR z = 1""")
def r5(spark, d):
    led = model_ledger(spark, d).select("model", "error_type", "row_id", "abs_margin")
    return forensic.representative_errors(led, ["model"], "row_id")


@query("A17", f"""SELECT dataset, count(*) FILTER (WHERE label = 0 AND b = 1 AND a = 0) AS corrected_fp, count(*) FILTER (WHERE label = 0 AND b = 0 AND a = 1) AS introduced_fp,
count(*) FILTER (WHERE label = 1 AND b = 0 AND a = 1) AS rescued_fn, count(*) FILTER (WHERE label = 1 AND b = 1 AND a = 0) AS introduced_fn, count(*) FILTER (WHERE a <> b) AS changed FROM (SELECT dataset, label, lstm_pred AS b, rf_pred AS a FROM (SELECT *, {SQL_DECISIONS} FROM flows)) GROUP BY 1""")
def a17(spark, d):
    return metrics.changed_decisions(predicted(spark, d), ["dataset"], "label", "lstm_pred", "rf_pred")


STAGES = ["lstm", "litemv", "rf"]
DELTA_METRICS = ["precision", "recall_tpr", "fpr", "f1", "fp", "fn", "tp"]


@query("A18", f"""WITH c AS (SELECT dataset, model, {sql_confusion('predicted')} FROM ({SQL_MODELS}) GROUP BY 1, 2),
m AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in sql_metrics().items())}, CASE model WHEN 'lstm' THEN 1 WHEN 'litemv' THEN 2 ELSE 3 END AS k FROM c),
x AS (SELECT dataset, lag(model) OVER w AS from_stage, model AS to_stage, {', '.join(f"{m} - lag({m}) OVER w AS d_{m}" for m in DELTA_METRICS)} FROM m WINDOW w AS (PARTITION BY dataset ORDER BY k))
SELECT dataset, from_stage, to_stage, {', '.join(f"{r(f'd_{m}') if m not in ('fp', 'fn', 'tp') else f'd_{m}'} AS delta_{m}, {'-' if m in ('fpr', 'fp', 'fn') else ''}{r(f'd_{m}') if m not in ('fp', 'fn', 'tp') else f'd_{m}'} AS {m}_improvement" for m in DELTA_METRICS)} FROM x WHERE from_stage IS NOT NULL""")
def a18(spark, d):
    table_ = metrics.rates(metrics.confusion(model_rows(spark, d), ["dataset", "model"], "label", "predicted"))
    return reporting.stage_deltas(table_, ["dataset"], "model", STAGES, DELTA_METRICS)


@query("A18_pair", f"""WITH c AS (SELECT dataset, model, {sql_confusion('predicted')} FROM ({SQL_MODELS}) GROUP BY 1, 2), m AS (SELECT dataset, model, {', '.join(f'{e} AS {n}' for n, e in sql_metrics().items())} FROM c)
SELECT a.dataset, {r('a.f1')} AS lstm_f1, {r('b.f1')} AS rf_f1, {r('b.f1 - a.f1')} AS delta_f1, {r('a.fpr')} AS lstm_fpr, {r('b.fpr')} AS rf_fpr, {r('b.fpr - a.fpr')} AS delta_fpr FROM m a JOIN m b ON a.dataset = b.dataset AND a.model = 'lstm' AND b.model = 'rf'""")
def a18_pair(spark, d):
    table_ = metrics.rates(metrics.confusion(model_rows(spark, d), ["dataset", "model"], "label", "predicted"))
    return reporting.variant_deltas(table_, ["dataset"], "model", "lstm", "rf", ["f1", "fpr"])


@query("A19", f"""{SQL_FOLDS}, l AS ({' UNION ALL '.join(f"SELECT dataset, '{m}' AS metric, {m} AS v FROM f" for m in ('f1', 'fpr', 'mcc'))})
SELECT dataset, metric, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round(min(v), 5) AS min, round(max(v), 5) AS max FROM l GROUP BY 1, 2""")
def a19(spark, d):
    got = metrics.fold_stability(fold_results(spark, d), ["f1", "fpr", "mcc"], ["dataset"])
    return got.select("dataset", "metric", *[F.round(c, 5).alias(c) for c in ("mean", "std", "min", "max")])


@query("A20", f"""{SQL_FOLDS}, p AS (SELECT dst_ip, dataset, avg(f1) AS f1, avg(fpr) AS fpr FROM f GROUP BY 1, 2), o AS (SELECT dst_ip, count(*) AS datasets, {', '.join(f"{a}({m}) AS {m}_{n}" for m in ('f1', 'fpr') for n, a in (('mean', 'avg'), ('min', 'min'), ('max', 'max')))} FROM p GROUP BY 1),
s AS (SELECT dst_ip, count(*) AS runs, stddev_pop(f1) AS f1_std, stddev_pop(fpr) AS fpr_std FROM f GROUP BY 1)
SELECT dst_ip, datasets, runs, {', '.join(f"round({m}_{n}, 5) AS {m}_{n}" for m in ('f1', 'fpr') for n in ('mean', 'min', 'max', 'std'))} FROM o JOIN s USING (dst_ip)""")
def a20(spark, d):
    got = reporting.equal_weight_summary(fold_results(spark, d), "dst_ip", "dataset", ["f1", "fpr"])
    return got.select("dst_ip", "datasets", "runs", *[F.round(f"{m}_{n}", 5).alias(f"{m}_{n}") for m in ("f1", "fpr") for n in ("mean", "min", "max", "std")])


IMPORTANCE = "CAST((l_quantity + l_linenumber * 3) % 17 AS DOUBLE) / 170"


@query("A21", f"""WITH i AS (SELECT l_returnflag AS feature, l_suppkey % 5 AS fold, avg({IMPORTANCE}) AS v FROM lineitem GROUP BY 1, 2)
SELECT feature, {r('avg(v)')} AS importance_mean, {r('stddev_samp(v)')} AS importance_std FROM i GROUP BY 1""")
def a21(spark, d):
    return reporting.importance_summary(_importance(spark, d), [], "feature", "importance")


def _importance(spark, d):
    v = ((F.col("l_quantity") + F.col("l_linenumber") * 3) % 17).cast("double") / 170
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("feature"), (F.col("l_suppkey") % 5).alias("fold")).agg(F.avg(v).alias("importance"))


@query("A21_share", f"""WITH i AS (SELECT l_returnflag AS feature, l_suppkey % 5 AS fold, avg({IMPORTANCE}) AS v FROM lineitem GROUP BY 1, 2), p AS (SELECT fold, sum(CASE WHEN feature IN ('A', 'N') THEN v ELSE 0 END) AS s FROM i GROUP BY 1)
SELECT {r('avg(s)')} AS share_mean, {r('stddev_pop(s)')} AS share_std, {r('min(s)')} AS share_min, {r('max(s)')} AS share_max FROM p""")
def a21_share(spark, d):
    return reporting.temporal_share(_importance(spark, d), [], "fold", F.col("feature").isin("A", "N"), "importance")


@query("A22", f"""{sql_history((5,))} SELECT dataset, label, count(*) AS rows, {r('median(history_count)')} AS median_history, {', '.join(f"{r(f'avg(CAST(history_count >= {k} AS INT))')} AS share_ge_{k}" for k in (1, 3, 5, 10))} FROM h GROUP BY 1, 2""")
def a22(spark, d):
    return reporting.history_coverage(history(spark, d), ["dataset"], "label", "Endpoint History Count")


@query("A24", f"""WITH c AS (SELECT dataset, label, count(*) AS n FROM flows WHERE split = 'train' GROUP BY 1, 2) SELECT dataset, label, n, {r('CAST(sum(n) OVER (PARTITION BY dataset) AS DOUBLE) / (count(*) OVER (PARTITION BY dataset) * n)')} AS weight FROM c""")
def a24(spark, d):
    return prep.class_weights(flows(spark, d).where("split = 'train'"), "label", ["dataset"])


@query("A25", f"""WITH c AS (SELECT label, count(*) AS n FROM flows GROUP BY 1), w AS (SELECT label, CAST(sum(n) OVER () AS DOUBLE) / (2 * n) AS w FROM c) SELECT row_id, {r('CASE WHEN f.label = 1 THEN w / 3.0 ELSE w END')} AS sample_weight FROM flows f JOIN w ON f.label = w.label""")
def a25(spark, d):
    df = flows(spark, d)
    return augment.sample_weights(df, prep.class_weights(df, "label"), "label").select("row_id", "sample_weight")


@query("A26", f"""WITH e AS (SELECT model, source_file, {sql_confusion('predicted')} FROM ({SQL_MODELS}) GROUP BY 1, 2)
SELECT source_file, {', '.join(f"CAST(sum(CASE WHEN model = '{m}' THEN fp + fn ELSE 0 END) AS BIGINT) AS {m}_errors, {r(f'''max(CASE WHEN model = '{m}' THEN CAST(fp + fn AS DOUBLE) / (tn + fp + fn + tp) ELSE 0 END)''')} AS {m}_rate" for m in STAGES)},
CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CASE WHEN sum(fp) > 0 AND sum(fn) = 0 THEN 'FP' WHEN sum(fn) > 0 AND sum(fp) = 0 THEN 'FN' ELSE 'FP+FN' END AS kind FROM e GROUP BY 1 HAVING sum(fp) + sum(fn) > 0""")
def a26(spark, d):
    by_source = forensic.errors_by_source(model_ledger(spark, d), ["model"], "source_file")
    return forensic.source_matrix(by_source, "source_file", "model", STAGES)


@query("A27", f"""SELECT model, label, count(*) FILTER (WHERE predicted = 0) AS predicted_0, count(*) FILTER (WHERE predicted = 1) AS predicted_1, {r('avg(CAST(predicted = 0 AS INT))')} AS share_0, {r('avg(CAST(predicted = 1 AS INT))')} AS share_1 FROM ({SQL_MODELS}) GROUP BY 1, 2""")
def a27(spark, d):
    return metrics.confusion_matrix(model_rows(spark, d), ["model"], "label", "predicted")


@query("A27_overlap", f"""WITH w AS (SELECT label, CAST(lstm_pred <> label AS INT) + CAST(litemv_pred <> label AS INT) + CAST(rf_pred <> label AS INT) AS k FROM (SELECT *, {SQL_DECISIONS} FROM flows))
SELECT CAST(g.k AS INT) AS models_wrong, count(*) FILTER (WHERE label = 0) AS benign_errors, count(*) FILTER (WHERE label = 1) AS malicious_errors FROM (SELECT unnest([1, 2, 3]) AS k) g LEFT JOIN w ON g.k = w.k GROUP BY 1""")
def a27_overlap(spark, d):
    return forensic.overlap_histogram(overlap(spark, d), [], "label", 3)


@query("A28", f"""WITH c AS (SELECT dataset, {sql_confusion(f'CAST(lstm_probability >= {T1} AS INT)')} FROM flows GROUP BY 1), g AS (SELECT m AS model, ds AS dataset FROM (SELECT unnest(['lstm', 'IF']) AS m), (SELECT unnest(['dsA', 'dsB']) AS ds))
SELECT model, g.dataset, CASE WHEN model = 'lstm' THEN 'ok' ELSE 'missing' END AS status, CASE WHEN model = 'lstm' THEN {r(sql_metrics()['f1'])} END AS f1 FROM g JOIN c ON g.dataset = c.dataset""")
def a28(spark, d):
    df = predicted(spark, d)
    part = lambda ds: metrics.rates(metrics.confusion(df.where(F.col("dataset") == ds), [], "label", "lstm_pred"), names=["f1"]).select("f1")
    return reporting.comparison_grid({("lstm", ds): part(ds) for ds in ("dsA", "dsB")}, spark, ["lstm", "IF"], ["dsA", "dsB"])


@query("A30", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'median({c})')} AS q50, {r(f'quantile_cont({c}, 0.75)')} AS q75 FROM flows"
    for c in ("fwd_len_mean", "flow_iat_std")
))
def a30(spark, d):
    return reporting.describe(flows(spark, d), ["fwd_len_mean", "flow_iat_std"])


@query("A31", f"""WITH g AS (SELECT label, min(lstm_probability) AS lo, (max(lstm_probability) - min(lstm_probability)) / 50 AS w FROM flows GROUP BY 1), b AS (SELECT f.label, least(CAST(floor((lstm_probability - lo) / w) AS INT), 49) AS bin, count(*) AS n FROM flows f JOIN g ON f.label = g.label GROUP BY 1, 2)
SELECT g.label, CAST(x.bin AS INT) AS bin, {r('lo + x.bin * w')} AS low, {r('lo + (x.bin + 1) * w')} AS high, coalesce(n, 0) AS n FROM g CROSS JOIN (SELECT unnest(range(50)) AS bin) x LEFT JOIN b ON b.label = g.label AND b.bin = x.bin""")
def a31(spark, d):
    return metrics.histogram(flows(spark, d), "label", "lstm_probability")


@query("A33", "SELECT dataset, count(*) AS rows, count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label = 1) AS malicious, count(DISTINCT source_file) AS sources, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM flows GROUP BY 1")
def a33(spark, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    got = metrics.banner(flows(spark, d), "dataset", "source_file", "label", "ts")
    return got.withColumns({"first_us": us("first_ts"), "last_us": us("last_ts")}).drop("first_ts", "last_ts")


# -- calibration -----------------------------------------------------------------------


SQL_VALIDATION = f"SELECT * FROM ({SQL_MODELS}) WHERE split = 'validation'"
CURVE = sql_curve(SQL_VALIDATION, "dataset, model")


def _points(spark, d):
    return metrics.curve(model_rows(spark, d).where("split = 'validation'"), ["dataset", "model"], "label", "score")


def sql_fbeta(beta):
    b2 = beta * beta
    return f"CASE WHEN {b2} * precision + recall > 0 THEN (1 + {b2}) * precision * recall / ({b2} * precision + recall) ELSE 0.0 END"


def sql_best_fbeta(name, beta, keys="dataset, model", source="k"):
    return f"""{name}0 AS (SELECT *, {sql_fbeta(beta)} AS f FROM {source}), {name}1 AS (SELECT *, max(f) OVER (PARTITION BY {keys}) AS best FROM {name}0),
{name} AS (SELECT {keys}, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY recall DESC, score) AS o FROM {name}1 WHERE abs(f - best) <= 1e-8 + 1e-5 * abs(best)) WHERE o = 1)"""


def sql_recall_cap(name, cap, keys="dataset, model", source="k"):
    return f"""{name}e AS (SELECT *, max(recall) OVER (PARTITION BY {keys}) AS bt FROM {source} WHERE corner AND fpr <= {cap}), {name}f AS (SELECT *, min(fpr) OVER (PARTITION BY {keys}) AS mf FROM {name}e WHERE abs(recall - bt) <= 1e-8 + 1e-5 * abs(bt)),
{name}g AS (SELECT {keys}, max(score) AS t FROM {name}f WHERE abs(fpr - mf) <= 1e-8 + 1e-5 * abs(mf) GROUP BY {keys}), {name} AS (SELECT {keys}, coalesce(t, top) AS threshold FROM (SELECT {keys}, max(score) + abs(max(score)) * 1.1 * power(CAST(2 AS DOUBLE), -53) AS top FROM {source} GROUP BY {keys}) LEFT JOIN {name}g USING ({keys}))"""


@query("C1", f"""{CURVE}, {sql_best_fbeta('b1', 1.0)}, {sql_best_fbeta('b2', 2.0)} SELECT dataset, model, {r('b1.threshold')} AS f1_threshold, {r('b2.threshold')} AS f2_threshold FROM b1 JOIN b2 USING (dataset, model)""")
def c1(spark, d):
    points, keys = _points(spark, d), ["dataset", "model"]
    one = calibrate.best_fbeta(points, keys, 1.0).withColumnRenamed("threshold", "f1_threshold")
    return one.join(calibrate.best_fbeta(points, keys, 2.0).withColumnRenamed("threshold", "f2_threshold"), keys)


@query("C2", f"""{CURVE}, {sql_recall_cap('c1', 0.02)}, {sql_recall_cap('c2', 0.2)} SELECT dataset, model, {r('c1.threshold')} AS at_002, {r('c2.threshold')} AS at_020 FROM c1 JOIN c2 USING (dataset, model)""")
def c2(spark, d):
    points, keys = _points(spark, d), ["dataset", "model"]
    one = calibrate.recall_at_fpr(points, keys, 0.02).withColumnRenamed("threshold", "at_002")
    return one.join(calibrate.recall_at_fpr(points, keys, 0.2).withColumnRenamed("threshold", "at_020"), keys)


@query("C3", f"""SELECT dataset, model, {r('quantile_cont(score, 0.95)')} AS q95, {r('quantile_cont(score, 0.995)')} AS q995 FROM ({SQL_VALIDATION}) WHERE label = 0 GROUP BY 1, 2""")
def c3(spark, d):
    df, keys = model_rows(spark, d).where("split = 'validation'"), ["dataset", "model"]
    one = calibrate.benign_quantile(df, keys, "label", "score", 0.95).withColumnRenamed("threshold", "q95")
    return one.join(calibrate.benign_quantile(df, keys, "label", "score", 0.995).withColumnRenamed("threshold", "q995"), keys)


def sql_rated(candidates, op=">="):
    hit = f"v.score {op} c.threshold"
    return f"""rated AS (SELECT dataset, model, method, threshold, tn, fp, fn, tp, {', '.join(f'{e} AS {n}' for n, e in sql_metrics().items())} FROM (
SELECT c.dataset, c.model, c.method, c.threshold, count(*) FILTER (WHERE v.label = 0 AND NOT {hit}) AS tn, count(*) FILTER (WHERE v.label = 0 AND {hit}) AS fp, count(*) FILTER (WHERE v.label = 1 AND NOT {hit}) AS fn, count(*) FILTER (WHERE v.label = 1 AND {hit}) AS tp
FROM {candidates} c JOIN ({SQL_VALIDATION}) v ON c.dataset = v.dataset AND c.model = v.model GROUP BY 1, 2, 3, 4))"""


@query("C4", f"""{CURVE}, {sql_best_fbeta('b1', 1.0)}, {sql_best_fbeta('b2', 2.0)}, {sql_recall_cap('c2', 0.02)},
cand AS (SELECT dataset, model, 1 AS i, 'validation_f1' AS method, threshold FROM b1 UNION ALL SELECT dataset, model, 2, 'validation_f2', threshold FROM b2 UNION ALL SELECT dataset, model, 3, 'recall_at_fpr_cap', threshold FROM c2), {sql_rated('cand')},
o AS (SELECT r.*, row_number() OVER (PARTITION BY r.dataset, r.model ORDER BY f2 DESC, f1 DESC, recall_tpr DESC, fpr, precision DESC, i) AS k FROM rated r JOIN cand USING (dataset, model, method))
SELECT dataset, model, method, {r('threshold')} AS threshold, tn, fp, fn, tp, {r('f1')} AS f1, {r('f2')} AS f2, {r('mcc')} AS mcc, k = 1 AS selected FROM o""")
def c4(spark, d):
    got = calibrate.calibrate(model_rows(spark, d).where("split = 'validation'"), ["dataset", "model"], "label", "score")
    return got.select("dataset", "model", "method", "threshold", "tn", "fp", "fn", "tp", "f1", "f2", "mcc", "selected")


@query("C5", f"""{CURVE}, {sql_best_fbeta('b1', 1.0)}, {sql_best_fbeta('b2', 2.0)}, {', '.join(sql_recall_cap(f'cap{i}', c) for i, c in enumerate(K.REPORT_FPR_CAPS))},
ben AS (SELECT dataset, model, {', '.join(f'quantile_cont(score, {p}) AS q{i}' for i, p in enumerate(K.REPORT_BENIGN_QUANTILES))} FROM ({SQL_VALIDATION}) WHERE label = 0 GROUP BY 1, 2),
cand AS (SELECT dataset, model, 0 AS i, 'validation_f1' AS method, threshold FROM b1 {' '.join(f"UNION ALL SELECT dataset, model, {i + 1}, 'benign_q{p:g}', q{i} FROM ben" for i, p in enumerate(K.REPORT_BENIGN_QUANTILES))}
UNION ALL SELECT dataset, model, 6, 'validation_f2', threshold FROM b2 {' '.join(f"UNION ALL SELECT dataset, model, {i + 7}, 'recall_at_fpr_{c:g}', threshold FROM cap{i}" for i, c in enumerate(K.REPORT_FPR_CAPS))}),
dd AS (SELECT dataset, model, method, threshold FROM (SELECT *, row_number() OVER (PARTITION BY dataset, model, round(threshold, 12) ORDER BY i) AS o FROM cand) WHERE o = 1), {sql_rated('dd', '>')}
SELECT dataset, model, method, {r('threshold')} AS threshold, tn, fp, fn, tp, {r('f1')} AS f1, {r('fpr')} AS fpr, method = 'validation_f1' AS selected FROM rated""")
def c5(spark, d):
    got = calibrate.report_thresholds(model_rows(spark, d).where("split = 'validation'"), ["dataset", "model"], "label", "score")
    return got.select("dataset", "model", "method", "threshold", "tn", "fp", "fn", "tp", "f1", "fpr", "selected")


@query("C6", f"""{CURVE}, f0 AS (SELECT *, {sql_fbeta(1.0)} AS f FROM k), f1 AS (SELECT *, max(f) OVER (PARTITION BY dataset, model) AS best FROM f0)
SELECT dataset, model, {r('score')} AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY dataset, model ORDER BY f DESC, recall DESC, precision DESC, fpr, score DESC) AS o FROM f1 WHERE abs(f - best) <= 1e-12 + 1e-12 * abs(best)) WHERE o = 1""")
def c6(spark, d):
    return calibrate.best_f1(_points(spark, d), ["dataset", "model"])


@query("B9", f"""{CURVE}, {sql_best_fbeta('b1', 1.0)} SELECT t.dataset, t.model, {r('b1.threshold')} AS threshold, {sql_confusion('CAST(t.score >= b1.threshold AS INT)')} FROM ({SQL_MODELS}) t JOIN b1 ON t.dataset = b1.dataset AND t.model = b1.model WHERE t.split = 'test' GROUP BY 1, 2, 3""")
def b9(spark, d):
    """Thresholds recalibrated on stored validation scores, applied to stored test scores."""
    keys = ["dataset", "model"]
    rows = model_rows(spark, d)
    found = calibrate.best_fbeta(_points(spark, d), keys, 1.0).withColumn("method", F.lit("validation_f1"))
    test = metrics.curve(rows.where("split = 'test'"), keys, "label", "score")
    return calibrate.evaluate_thresholds(test, found, keys).select(*keys, "threshold", "tn", "fp", "fn", "tp")


@query("B10", f"""{CURVE}, {sql_best_fbeta('b1', 1.0)}, {sql_recall_cap('cap', 0.02)}, ben AS (SELECT dataset, model, quantile_cont(score, 0.95) AS threshold FROM ({SQL_VALIDATION}) WHERE label = 0 GROUP BY 1, 2),
cand AS (SELECT dataset, model, 'f1' AS method, threshold FROM b1 UNION ALL SELECT dataset, model, 'cap', threshold FROM cap UNION ALL SELECT dataset, model, 'q95', threshold FROM ben), {sql_rated('cand', '>')}
SELECT dataset, model, method, {r('f1')} AS f1, {r('fpr')} AS fpr FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(f1, 9) DESC, round(fpr, 9), model, method) AS o FROM rated) WHERE o = 1""")
def b10(spark, d):
    """Score by threshold-method grid, best row per dataset."""
    keys = ["dataset", "model"]
    validation = model_rows(spark, d).where("split = 'validation'")
    points = metrics.curve(validation, keys, "label", "score")
    parts = {
        "f1": calibrate.best_fbeta(points, keys, 1.0),
        "cap": calibrate.recall_at_fpr(points, keys, 0.02),
        "q95": calibrate.benign_quantile(validation, keys, "label", "score", 0.95),
    }
    grid = calibrate._methods(parts, keys).drop("__i")
    rated = calibrate.evaluate_thresholds(points, grid, keys, strict=True)
    order = [-F.round("f1", 9), F.round("fpr", 9), F.col("model"), F.col("method")]
    return reporting.best_row(rated, ["dataset"], order).select("dataset", "model", "method", "f1", "fpr")
