"""Joins and sets (J, U), cascade rules (H), composed reports (B)."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.cascade import Rule, three_score, two_score
from ..functions.decision import decide, error_type
from ..operators import alignment, forensic, metrics, models, prep, quality, reporting, rules, splits, temporal
from ..plans import jobs
from .base import (
    FEATURES, SCORES, SQL_DECISIONS, T1, T2, T3, flows, query, r, sql_confusion, sql_error_type, sql_log, sql_metrics, sql_number,
    sql_rates, table,
)
from .metrics import SQL_MODELS, model_ledger, model_rows, overlap, predicted
from .temporal import SQL_POSITION

# A frozen rule for the queries that only apply one.
FROZEN = Rule(T1, 0.75, 0.6, 0.6, 0.8, 0.7)
SQL_FROZEN = f"""SELECT *, CASE WHEN base = 0 AND litemv_probability >= 0.8 AND rf_probability >= 0.7 THEN 1 WHEN low THEN CAST(litemv_probability >= 0.6 OR rf_probability >= 0.6 AS INT) ELSE base END AS prediction,
CASE WHEN base = 0 AND litemv_probability >= 0.8 AND rf_probability >= 0.7 THEN 'JOINT_LITEMV_RF_RESCUE' WHEN low AND litemv_probability >= 0.6 THEN 'LITEMV_CONFIRMED_LSTM_POSITIVE'
WHEN low AND rf_probability >= 0.6 THEN 'RF_ARBITRATED_KEEP_MALICIOUS' WHEN low THEN 'LITEMV_RF_FILTERED_LSTM_POSITIVE' ELSE 'LSTM_DIRECT' END AS route
FROM (SELECT *, CAST(lstm_probability >= {T1} AS INT) AS base, lstm_probability >= {T1} AND lstm_probability <= 0.75 + 1e-12 AS low FROM flows)"""


def frozen(df):
    got = three_score(*[F.col(s) for s in SCORES], FROZEN)
    return df.withColumns({"baseline": got["baseline"], "prediction": got["prediction"], "route": got["route"]})


# -- joins and sets -----------------------------------------------------------------------


def score_frames(spark, d):
    df = temporal.source_positions(flows(spark, d), ["split", "source_file"], "ts", "row_id")
    keys = ["source_file", "position", "label"]
    return {m: df.select(*keys, f"{m}_probability") for m in ("lstm", "litemv", "rf")}


@query("J1", f"""WITH p AS (SELECT *, {SQL_POSITION} AS position FROM flows) SELECT source_file, position, label, {r('lstm_probability')} AS lstm_probability, {r('litemv_probability')} AS litemv_probability, {r('rf_probability')} AS rf_probability FROM p""")
def j1(spark, d):
    return alignment.align_scores(score_frames(spark, d), ["source_file", "position"], "label")


@query("J1_checks", f"""WITH p AS (SELECT *, {SQL_POSITION} AS position FROM flows) SELECT source_file, position, CAST(1 AS BIGINT) AS n_lstm, CAST(CASE WHEN position % 10 = 3 THEN 0 ELSE 1 END AS BIGINT) AS n_litemv, CAST(1 AS BIGINT) AS n_rf, position % 7 = 5 AS labels_differ FROM p WHERE position % 10 = 3 OR position % 7 = 5""")
def j1_checks(spark, d):
    frames = score_frames(spark, d)
    frames["litemv"] = frames["litemv"].where("position % 10 <> 3")
    flipped = F.when(F.col("position") % 7 == 5, 1 - F.col("label")).otherwise(F.col("label"))
    frames["rf"] = frames["rf"].withColumn("label", flipped)
    return alignment.alignment_violations(frames, ["source_file", "position"], "label")


@query("J2", """WITH a AS (SELECT row_id, lstm_probability AS p, row_number() OVER (PARTITION BY source_file, dst_ip, CAST(ts AS DATE), label ORDER BY -row_id) AS k, source_file, dst_ip, CAST(ts AS DATE) AS dy, label FROM flows),
b AS (SELECT row_id, row_number() OVER (PARTITION BY source_file, dst_ip, CAST(ts AS DATE), label ORDER BY row_id) AS k, source_file, dst_ip, CAST(ts AS DATE) AS dy, label FROM flows)
SELECT a.row_id AS prediction_id, b.row_id AS row_id FROM a LEFT JOIN b USING (source_file, dst_ip, dy, label, k)""")
def j2(spark, d):
    df = flows(spark, d).withColumn("day", F.date_trunc("day", "ts"))
    cols = ["source_file", "dst_ip", "day", "label"]
    predictions = df.select(F.col("row_id").alias("prediction_id"), (-F.col("row_id")).alias("o"), *cols)
    got = alignment.match_occurrences(
        predictions, df.select("row_id", *cols), source="source_file", ts="day", label="label", prediction_order="o", row_id="row_id", flow_id="dst_ip",
    )
    return got.select("prediction_id", "row_id")


@query("J3", f"WITH p AS (SELECT *, {SQL_POSITION} AS position FROM flows) SELECT source_file, position, {r('lstm_probability')} AS lstm_probability, {r('fwd_len_mean')} AS fwd_len_mean, CAST(fwd_len_std AS INT) AS fwd_len_std FROM p")
def j3(spark, d):
    rows = temporal.source_positions(flows(spark, d), ["split", "source_file"], "ts", "row_id")
    return alignment.attach(
        score_frames(spark, d)["lstm"].drop("label"), rows, ["source_file", "position"], ["fwd_len_mean", "fwd_len_std"]
    )


@query("J4", "SELECT split, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM flows GROUP BY 1")
def j4(spark, d):
    df = flows(spark, d)
    manifest = df.select("row_id", "split")
    got = alignment.apply_manifest(df.drop("split"), manifest, "row_id", "split")
    return got.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


@query("J5", f"""WITH w AS (SELECT row_id, source_file, label, {', '.join(f"{sql_error_type('label', f'{m}_pred')} AS {m}_error_type" for m in ('lstm', 'litemv', 'rf'))},
concat_ws('|', CASE WHEN lstm_pred <> label THEN 'lstm' END, CASE WHEN litemv_pred <> label THEN 'litemv' END, CASE WHEN rf_pred <> label THEN 'rf' END) AS names,
CAST(lstm_pred <> label AS INT) + CAST(litemv_pred <> label AS INT) + CAST(rf_pred <> label AS INT) AS models_wrong FROM (SELECT *, {SQL_DECISIONS} FROM flows))
SELECT row_id, source_file, label, lstm_error_type, litemv_error_type, rf_error_type, models_wrong, CASE WHEN names = '' THEN 'none' ELSE names END AS wrong_models FROM w""")
def j5(spark, d):
    return overlap(spark, d)


@query("J6", "SELECT row_id, dataset FROM flows WHERE split = 'test'")
def j6(spark, d):
    df = flows(spark, d)
    return alignment.restrict(df.select("row_id", "dataset"), df.where("split = 'test'"), ["row_id"])


@query("J7", "SELECT row_id, split FROM flows")
def j7(spark, d):
    df = flows(spark, d)
    assignment = df.groupBy("source_file").agg(F.min("split").alias("split"))
    return alignment.map_sources(df.drop("split"), assignment, "source_file", ["split"]).select("row_id", "split")


@query("J8", f"""WITH l AS (SELECT model, source_file, position, {sql_error_type()} AS error_type FROM (SELECT m.*, p.position FROM ({SQL_MODELS}) m JOIN (SELECT row_id, {SQL_POSITION} AS position FROM flows) p USING (row_id)))
SELECT model, error_type, source_file, count(*) AS n_errors, min(position) AS min_position, max(position) AS max_position, {r('median(position)')} AS median_position FROM l WHERE error_type IN ('FP', 'FN') GROUP BY 1, 2, 3""")
def j8(spark, d):
    led = temporal.source_positions(model_ledger(spark, d), ["model", "split", "source_file"], "ts", "row_id")
    return forensic.error_positions(led, ["model"], "source_file", "position")


ACTION = "CASE row_id % 4 WHEN 0 THEN 'KEEP_HYBRID' WHEN 1 THEN 'OVERRIDE_TO_C2' ELSE 'OVERRIDE_TO_NON_C2' END"
FINAL = "CASE WHEN row_id % 8 = 1 THEN 1 WHEN row_id % 8 = 2 THEN 0 ELSE prediction END"
SQL_CASES = f"WITH f AS ({SQL_FROZEN}), c AS (SELECT *, {ACTION} AS action, {FINAL} AS final FROM f WHERE route <> 'LSTM_DIRECT')"


def arbitration_tables(spark, d):
    """All rows with the frozen decision, the escalated ones, and an output row per escalated key."""
    rows = frozen(flows(spark, d)).withColumn("hybrid_pred", F.col("prediction"))
    escalated = rows.where("route <> 'LSTM_DIRECT'").select("row_id").dropDuplicates()
    outputs = rows.where("route <> 'LSTM_DIRECT'").select(
        "row_id", F.expr(ACTION).alias("recommended_action"), F.expr(FINAL).cast("int").alias("final_pred"),
        (F.expr(FINAL) != F.col("prediction")).alias("override_accepted"),
    )
    return rows, escalated, outputs


@query("J9", f"""{SQL_CASES} SELECT row_id, dataset, label, CAST(prediction AS INT) AS hybrid_pred, action AS recommended_action, CAST(final AS INT) AS final_pred, final <> prediction AS override_accepted FROM c""")
def j9(spark, d):
    rows, escalated, outputs = arbitration_tables(spark, d)
    joined = alignment.attach(escalated, rows, ["row_id"], ["dataset", "label", "hybrid_pred"])
    return alignment.attach(joined, outputs, ["row_id"], ["recommended_action", "final_pred", "override_accepted"])


@query("J10", f"{SQL_CASES} SELECT f.row_id, CAST(coalesce(c.final, f.prediction) AS INT) AS final_pred FROM f LEFT JOIN c ON c.row_id = f.row_id")
def j10(spark, d):
    rows, _, outputs = arbitration_tables(spark, d)
    return alignment.override(rows.select("row_id", "prediction"), outputs, ["row_id"], "prediction", "final_pred", "final").select(
        "row_id", F.col("final").alias("final_pred")
    )


@query("A29", f"""{SQL_CASES}, x AS (SELECT *, CASE action WHEN 'OVERRIDE_TO_C2' THEN 1 WHEN 'OVERRIDE_TO_NON_C2' THEN 0 ELSE prediction END AS raw FROM c),
a AS (SELECT dataset, count(*) AS test_rows, count(*) FILTER (WHERE prediction <> label) AS total_errors FROM f GROUP BY 1),
b AS (SELECT dataset, count(*) AS escalated_cases, count(*) FILTER (WHERE label = 0) AS escalated_benign, count(*) FILTER (WHERE label = 1) AS escalated_malicious, count(*) FILTER (WHERE prediction <> label) AS escalated_errors, count(*) FILTER (WHERE raw <> prediction) AS proposals,
count(*) FILTER (WHERE raw <> prediction AND raw = label) AS raw_corrected, count(*) FILTER (WHERE raw <> prediction AND prediction = label) AS raw_introduced, count(*) FILTER (WHERE final <> prediction) AS accepted_overrides,
count(*) FILTER (WHERE final <> prediction AND final = label) AS accepted_corrected, count(*) FILTER (WHERE final <> prediction AND prediction = label) AS accepted_introduced FROM x GROUP BY 1)
SELECT *, {r('CAST(escalated_cases AS DOUBLE) / test_rows')} AS escalation_rate, {r('CAST(escalated_errors AS DOUBLE) / total_errors')} AS error_coverage, {r('CAST(raw_corrected AS DOUBLE) / proposals')} AS proposal_accuracy, raw_corrected - raw_introduced AS raw_net_benefit, accepted_corrected - accepted_introduced AS accepted_net_benefit FROM a JOIN b USING (dataset)""")
def a29(spark, d):
    rows, _, _ = arbitration_tables(spark, d)
    return reporting.arbitration_report(j9(spark, d), rows, ["dataset"], "label")


@query("J11", f"""WITH v AS (SELECT dst_ip, fwd_len_mean FROM flows WHERE split = 'validation') SELECT row_id, {r('(SELECT CAST(count(*) FILTER (WHERE v.fwd_len_mean <= t.fwd_len_mean) AS DOUBLE) / count(*) FROM v WHERE v.dst_ip = t.dst_ip)')} AS share FROM flows t WHERE split = 'test'""")
def j11(spark, d):
    df = flows(spark, d)
    return alignment.support_percentiles(
        df.where("split = 'validation'"), df.where("split = 'test'"), ["dst_ip"], "fwd_len_mean", "share"
    ).select("row_id", "share")


@query("U1", "SELECT split, count(*) AS n FROM flows GROUP BY 1")
def u1(spark, d):
    df = flows(spark, d)
    parts = [df.where(F.col("split") == s) for s in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1].select(*reversed(df.columns))).unionByName(parts[2]).groupBy("split").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("U2", "WITH a AS (SELECT DISTINCT user_id FROM flows WHERE dst_ip = 'click'), b AS (SELECT DISTINCT user_id FROM flows WHERE dst_ip = 'view') SELECT user_id, CASE WHEN a.user_id IS NULL THEN 'right_only' WHEN b.user_id IS NULL THEN 'left_only' ELSE 'both' END AS side FROM a FULL JOIN b USING (user_id)")
def u2(spark, d):
    return alignment.set_difference(*_two_sets(spark, d), "user_id")


def _two_sets(spark, d):
    df = flows(spark, d)
    return tuple(df.where(F.col("dst_ip") == x).select("user_id").distinct() for x in ("click", "view"))


@query("U3", f"WITH a AS (SELECT DISTINCT user_id FROM flows WHERE dst_ip = 'click'), b AS (SELECT DISTINCT user_id FROM flows WHERE dst_ip = 'view'), c AS (SELECT a.user_id IS NOT NULL AND b.user_id IS NOT NULL AS x FROM a FULL JOIN b ON a.user_id = b.user_id) SELECT count(*) FILTER (WHERE x) AS n_both, count(*) AS n_union, {r('CAST(count(*) FILTER (WHERE x) AS DOUBLE) / count(*)')} AS jaccard FROM c")
def u3(spark, d):
    return alignment.jaccard(*_two_sets(spark, d), "user_id")


# -- rule search -------------------------------------------------------------------------------


V = f"(SELECT * FROM flows WHERE split = 'validation')"
_quant = lambda col, qs: "[" + ", ".join(f"quantile_cont({col}, {p})" for p in qs) + "]"
SQL_CANDIDATES = f"""WITH v AS (SELECT *, lstm_probability >= {T1} AS pos FROM flows WHERE split = 'validation'),
qs AS (SELECT dataset, list_concat([CAST({T1} AS DOUBLE)], {_quant('lstm_probability', K.CUTOFF_QUANTILES)}) AS qa, list_concat([CAST(0 AS DOUBLE), CAST({T2} AS DOUBLE), CAST(1 AS DOUBLE)], {_quant('litemv_probability', K.CONFIRM_QUANTILES)}) AS qb, list_concat([CAST(0 AS DOUBLE), CAST({T3} AS DOUBLE), CAST(1 AS DOUBLE)], {_quant('rf_probability', K.CONFIRM_QUANTILES)}) AS qc FROM v WHERE pos GROUP BY dataset),
ca AS (SELECT DISTINCT dataset, x AS a FROM (SELECT dataset, unnest(qa) AS x FROM qs) WHERE x >= {T1} - 1e-12), cb AS (SELECT DISTINCT dataset, x AS b FROM (SELECT dataset, unnest(qb) AS x FROM qs) WHERE x BETWEEN -1e-12 AND 1 + 1e-12), cc AS (SELECT DISTINCT dataset, x AS c FROM (SELECT dataset, unnest(qc) AS x FROM qs) WHERE x BETWEEN -1e-12 AND 1 + 1e-12),
rs AS (SELECT dataset, greatest({T2}, coalesce(m2 + abs(m2) * 1.1 * power(CAST(2 AS DOUBLE), -53), {T2})) AS rb, greatest({T3}, coalesce(m3 + abs(m3) * 1.1 * power(CAST(2 AS DOUBLE), -53), {T3})) AS rc FROM (SELECT dataset, max(litemv_probability) FILTER (WHERE NOT pos AND label = 0) AS m2, max(rf_probability) FILTER (WHERE NOT pos AND label = 0) AS m3 FROM v GROUP BY 1))"""


def validation(spark, d):
    return flows(spark, d).where("split = 'validation'")


@query("H1", f"{SQL_CANDIDATES} SELECT dataset, {r('a')} AS cutoff FROM ca")
def h1(spark, d):
    return rules.cutoff_candidates(validation(spark, d), ["dataset"], SCORES[0], T1).select("dataset", F.explode("cutoffs").alias("cutoff"))


@query("H2", f"{SQL_CANDIDATES} SELECT dataset, 'litemv' AS model, {r('b')} AS threshold FROM cb UNION ALL SELECT dataset, 'rf', {r('c')} FROM cc")
def h2(spark, d):
    df = validation(spark, d)
    part = lambda m, s, t: rules.confirm_candidates(df, ["dataset"], SCORES[0], T1, s, t, "x").select(
        "dataset", F.lit(m).alias("model"), F.explode("x").alias("threshold")
    )
    return part("litemv", SCORES[1], T2).unionByName(part("rf", SCORES[2], T3))


@query("H3", f"{SQL_CANDIDATES} SELECT dataset, {r('rb')} AS litemv_probability_rescue, {r('rc')} AS rf_probability_rescue FROM rs")
def h3(spark, d):
    return rules.rescue_thresholds(validation(spark, d), ["dataset"], "label", SCORES[0], T1, {SCORES[1]: T2, SCORES[2]: T3})


@query("H4", f"SELECT row_id, CAST(base AS INT) AS baseline, CAST(prediction AS INT) AS prediction FROM ({SQL_FROZEN})")
def h4(spark, d):
    return frozen(flows(spark, d)).select("row_id", "baseline", "prediction")


@query("H5", f"""SELECT row_id, CAST(base AS INT) AS baseline, low AS filter_route, base = 0 AND rf_probability >= 0.9 AS rescue_route, CAST(CASE WHEN base = 0 AND rf_probability >= 0.9 THEN 1 WHEN low THEN CAST(rf_probability >= 0.6 AS INT) ELSE base END AS INT) AS prediction FROM ({SQL_FROZEN})""")
def h5(spark, d):
    got = two_score(F.col(SCORES[0]), F.col(SCORES[2]), T1, 0.75, 0.6, 0.9)
    return flows(spark, d).select("row_id", *[got[c].alias(c) for c in ("baseline", "filter_route", "rescue_route", "prediction")])


@query("H6", f"SELECT row_id, route FROM ({SQL_FROZEN})")
def h6(spark, d):
    return frozen(flows(spark, d)).select("row_id", "route")


@query("A13", f"SELECT dataset, route, count(*) AS n FROM ({SQL_FROZEN}) GROUP BY 1, 2")
def a13(spark, d):
    return reporting.value_counts(frozen(flows(spark, d)), ["dataset"], "route")


_low = f"v.pos AND v.lstm_probability <= ca.a + 1e-12"
_res = "NOT v.pos AND v.litemv_probability >= rs.rb AND v.rf_probability >= rs.rc"
_pred = f"CASE WHEN {_res} THEN 1 WHEN {_low} THEN CAST(v.litemv_probability >= cb.b OR v.rf_probability >= cc.c AS INT) ELSE CAST(v.pos AS INT) END"
SQL_SEARCH = f"""{SQL_CANDIDATES},
g AS (SELECT v.dataset, a, b, c, any_value(rb) AS rb, any_value(rc) AS rc, count(*) FILTER (WHERE {_low}) AS low_positive_routed_rows, count(*) FILTER (WHERE {_low} AND v.litemv_probability >= b) AS second_confirmed_rows, count(*) FILTER (WHERE {_low} AND v.litemv_probability < b) AS arbiter_rows,
count(*) FILTER (WHERE {_res}) AS rescue_routed_rows, count(*) FILTER (WHERE ({_pred}) <> CAST(v.pos AS INT)) AS total_changed_rows, count(*) FILTER (WHERE label = 0 AND ({_pred}) = 0) AS tn, count(*) FILTER (WHERE label = 0 AND ({_pred}) = 1) AS fp, count(*) FILTER (WHERE label = 1 AND ({_pred}) = 0) AS fn, count(*) FILTER (WHERE label = 1 AND ({_pred}) = 1) AS tp
FROM v JOIN ca ON v.dataset = ca.dataset JOIN cb ON v.dataset = cb.dataset JOIN cc ON v.dataset = cc.dataset JOIN rs ON v.dataset = rs.dataset GROUP BY 1, 2, 3, 4),
b0 AS (SELECT dataset, {sql_confusion('CAST(pos AS INT)')} FROM v GROUP BY 1), bm AS (SELECT dataset, {', '.join(f'{e} AS {n}0' for n, e in sql_metrics().items() if n in ('f1', 'fpr', 'fnr'))} FROM b0),
s AS (SELECT g.*, {', '.join(f'{e} AS {n}' for n, e in sql_metrics().items() if n in ('f1', 'fpr', 'fnr'))} FROM g),
t AS (SELECT s.*, fpr <= fpr0 + 1e-12 AND fnr <= fnr0 + 1e-12 AND f1 > f10 + 1e-12 AS safe FROM s JOIN bm USING (dataset))"""
RULE_OUT = f"dataset, {r('a')} AS positive_filter_cutoff, {r('b')} AS second_confirm_threshold, {r('c')} AS third_confirm_threshold, {r('rb')} AS second_rescue_threshold, {r('rc')} AS third_rescue_threshold"
RULE_COLUMNS = ["dataset", "positive_filter_cutoff", "second_confirm_threshold", "third_confirm_threshold", "second_rescue_threshold", "third_rescue_threshold"]
COUNT_COLUMNS = ["low_positive_routed_rows", "second_confirmed_rows", "arbiter_rows", "rescue_routed_rows", "total_changed_rows", "tn", "fp", "fn", "tp"]


def searched(spark, d):
    return rules.search_three_score(validation(spark, d), ["dataset"], "label", SCORES, [T1, T2, T3])


@query("H7", f"{SQL_SEARCH} SELECT {RULE_OUT}, {', '.join(COUNT_COLUMNS)}, {r('f1')} AS f1, {r('fpr')} AS fpr, {r('fnr')} AS fnr, safe FROM t")
def h7(spark, d):
    return searched(spark, d).select(*RULE_COLUMNS, *COUNT_COLUMNS, "f1", "fpr", "fnr", "safe")


SQL_BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, fpr, fnr, total_changed_rows, arbiter_rows, a, b, c) AS k FROM t WHERE safe) WHERE k = 1"


@query("H7_selected", f"{SQL_SEARCH} SELECT {RULE_OUT}, total_changed_rows, fp, fn, {r('f1')} AS f1 FROM ({SQL_BEST})")
def h7_selected(spark, d):
    return rules.select_rule(searched(spark, d), ["dataset"]).select(*RULE_COLUMNS, "total_changed_rows", "fp", "fn", "f1")


@query("H8", f"{SQL_SEARCH} SELECT d.dataset, k.dataset IS NOT NULL AS enabled, coalesce(total_changed_rows, 0) AS changed FROM (SELECT DISTINCT dataset FROM t) d LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, fpr, fnr, total_changed_rows, arbiter_rows, a, b, c) AS k FROM t WHERE safe AND dataset = 'dsA') WHERE k = 1) k ON d.dataset = k.dataset")
def h8(spark, d):
    """Fallback to the disabled rule for a dataset without any safe rule."""
    found = searched(spark, d).withColumn("safe", F.col("safe") & (F.col("dataset") == "dsA"))
    got = rules.select_rule(found, ["dataset"], disabled_fallback=True)
    return got.select("dataset", "enabled", F.coalesce("total_changed_rows", F.lit(0)).alias("changed"))


SQL_DECIDED = f"""{SQL_SEARCH}, best AS ({SQL_BEST}), dec AS (SELECT f.*, CAST(lstm_probability >= {T1} AS INT) AS lstm_pred, CAST(litemv_probability >= {T2} AS INT) AS litemv_pred, CAST(rf_probability >= {T3} AS INT) AS rf_pred,
CASE WHEN lstm_probability < {T1} AND litemv_probability >= rb AND rf_probability >= rc THEN 1 WHEN lstm_probability >= {T1} AND lstm_probability <= a + 1e-12 THEN CAST(litemv_probability >= b OR rf_probability >= c AS INT) ELSE CAST(lstm_probability >= {T1} AS INT) END AS hybrid FROM flows f JOIN best ON f.dataset = best.dataset WHERE f.split = 'test')"""


@query("H9", f"""{SQL_DECIDED}, u AS ({' UNION ALL '.join(f"SELECT dataset, '{m}' AS model, label, {c} AS p FROM dec" for m, c in (('LSTM', 'lstm_pred'), ('LITEMV', 'litemv_pred'), ('RF', 'rf_pred'), ('LSTM_LITEMV_RF', 'hybrid')))}), k AS (SELECT dataset, model, {sql_confusion('p')} FROM u GROUP BY 1, 2) SELECT *, {sql_rates()} FROM k""")
def h9(spark, d):
    df = flows(spark, d)
    got = jobs.cascade_job(
        df.where("split = 'validation'"), df.where("split = 'test'"), keys=["dataset"], label="label", scores=SCORES, thresholds=[T1, T2, T3]
    )
    return got["metrics"]


@query("H9_two", f"""{SQL_CANDIDATES}, g AS (SELECT v.dataset, a, c, any_value(rc) AS rc, count(*) FILTER (WHERE pos AND lstm_probability <= a + 1e-12) AS filter_routed_rows,
count(*) FILTER (WHERE label = 0 AND p2 = 0) AS tn, count(*) FILTER (WHERE label = 0 AND p2 = 1) AS fp, count(*) FILTER (WHERE label = 1 AND p2 = 0) AS fn, count(*) FILTER (WHERE label = 1 AND p2 = 1) AS tp FROM (
SELECT v.*, ca.a, cc.c, rs.rc, CASE WHEN NOT pos AND rf_probability >= rs.rc THEN 1 WHEN pos AND lstm_probability <= ca.a + 1e-12 THEN CAST(rf_probability >= cc.c AS INT) ELSE CAST(pos AS INT) END AS p2 FROM v JOIN ca ON v.dataset = ca.dataset JOIN cc ON v.dataset = cc.dataset JOIN rs ON v.dataset = rs.dataset) v GROUP BY 1, 2, 3)
SELECT dataset, {r('a')} AS positive_filter_cutoff, {r('c')} AS second_confirm_threshold, {r('rc')} AS second_rescue_threshold, filter_routed_rows, tn, fp, fn, tp, {r(sql_metrics()['f1'])} AS f1 FROM g""")
def h9_two(spark, d):
    got = rules.search_two_score(validation(spark, d), ["dataset"], "label", SCORES[0], SCORES[2], T1, T3)
    return got.select("dataset", "positive_filter_cutoff", "second_confirm_threshold", "second_rescue_threshold", "filter_routed_rows", "tn", "fp", "fn", "tp", "f1")


@query("H9_choice", f"""WITH p AS (SELECT dataset, label, lstm_pred AS "LSTM", litemv_pred AS "LSTM_LITEMV", rf_pred AS "LSTM_RF", prediction AS "LSTM_LITEMV_RF" FROM (SELECT *, {SQL_DECISIONS} FROM ({SQL_FROZEN}))),
u AS ({' UNION ALL '.join(f'SELECT dataset, {chr(39)}{m}{chr(39)} AS model, {lv} AS lv, label, "{m}" AS p FROM p' for m, lv in rules.COMPLEXITY.items())}), k AS (SELECT dataset, model, lv, {sql_confusion('p')} FROM u GROUP BY 1, 2, 3), m AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in sql_metrics().items() if n in ('f1', 'fpr', 'fnr'))} FROM k)
SELECT dataset, model FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, fpr, fnr, lv) AS o FROM m) WHERE o = 1""")
def h9_choice(spark, d):
    df = frozen(predicted(spark, d))
    got = rules.ablation(df, ["dataset"], "label", {"LSTM": "lstm_pred", "LSTM_LITEMV": "litemv_pred", "LSTM_RF": "rf_pred", "LSTM_LITEMV_RF": "prediction"})
    return rules.choose_architecture(got, ["dataset"])


@query("H10", f"""SELECT 'holdout' AS protocol, row_id, dataset, model, label, predicted, {sql_error_type()} AS error_type, {r('score')} AS score, {r('threshold')} AS threshold, {r('score - threshold')} AS signed_margin, {r('abs(score - threshold)')} AS abs_margin, {r('fwd_len_mean')} AS fwd_len_mean FROM ({SQL_MODELS})""")
def h10(spark, d):
    return forensic.ledger(
        model_rows(spark, d), label="label", predicted="predicted", score="score", threshold="threshold",
        keep=["row_id", "dataset", "model", "fwd_len_mean"], protocol="holdout",
    )


# -- composed reports ---------------------------------------------------------------------------


@query("B1", f"SELECT row_id, {r(f'CASE WHEN isfinite(fwd_len_mean) THEN fwd_len_mean END')} AS fwd_len_mean, {r(sql_number('bytes_per_s_raw'))} AS bytes_per_s_raw FROM flows")
def b1(spark, d):
    return jobs.clean(flows(spark, d), ["fwd_len_mean", "bytes_per_s_raw"]).select("row_id", "fwd_len_mean", "bytes_per_s_raw")


@query("B2", f"""WITH c AS (SELECT model, {sql_confusion('predicted')}, count(*) FILTER (WHERE predicted <> label) AS errors FROM (SELECT * FROM ({SQL_MODELS}) WHERE split = 'test') GROUP BY 1) SELECT model, tn, fp, fn, tp, errors, {sql_rates()} FROM c""")
def b2(spark, d):
    """Frozen evaluation on test: metrics per model, with the size of the FP and FN tables."""
    test = model_ledger(spark, d).where("split = 'test'")
    errors = test.where(F.col("error_type").isin("FP", "FN")).groupBy("model").agg(F.count(F.lit(1)).alias("errors"))
    got = metrics.full_metrics(test, ["model"], "label", "score", "predicted").drop("roc_auc", "pr_auc")
    return got.join(errors, "model")


@query("B3", f"""WITH u AS (SELECT dataset, source_file, model, label, predicted FROM ({SQL_MODELS})), k AS (SELECT dataset, model, count(*) AS evaluation_rows, count(DISTINCT source_file) AS evaluation_sources, {sql_confusion('predicted')} FROM u GROUP BY 1, 2) SELECT *, {sql_rates(['accuracy', 'precision', 'recall_tpr', 'fpr', 'fnr', 'f1', 'f2'])} FROM k""")
def b3(spark, d):
    return reporting.component_records(
        predicted(spark, d), ["dataset"], "label", {"lstm": "lstm_pred", "litemv": "litemv_pred", "rf": "rf_pred"}, "source_file"
    )


@query("B4", f"""SELECT 'duplicate_keys' AS "check", CAST(0 AS BIGINT) AS n UNION ALL SELECT 'label_domain', CAST(0 AS BIGINT) UNION ALL SELECT 'rows', count(*) FROM flows""")
def b4(spark, d):
    """Stored component scores read back with key and domain checks."""
    from ..session import scratch_path

    path = scratch_path(spark, "b4")
    temporal.source_positions(flows(spark, d), ["split", "source_file"], "ts", "row_id").write.parquet(path)
    stored = spark.read.parquet(path)
    return quality.violation_counts(
        {
            "duplicate_keys": quality.duplicate_keys(stored, ["split", "source_file", "position"]),
            "label_domain": quality.label_domain(stored, "label"),
            "rows": stored,
        }
    )


@query("B5", f"{SQL_SEARCH} SELECT dataset, count(*) AS rules, count(*) FILTER (WHERE fpr <= fpr0 + 1e-12 AND fnr <= fnr0 + 1e-12) AS not_worse, count(*) FILTER (WHERE t.safe) AS safe FROM t JOIN bm USING (dataset) GROUP BY 1")
def b5(spark, d):
    found = searched(spark, d)
    base = metrics.rates(metrics.confusion(validation(spark, d).withColumn("p", decide(F.col(SCORES[0]), T1)), ["dataset"], "label", "p"))
    base = base.select("dataset", F.col("fpr").alias("fpr0"), F.col("fnr").alias("fnr0"))
    both = found.join(base, "dataset")
    ok = (F.col("fpr") <= F.col("fpr0") + 1e-12) & (F.col("fnr") <= F.col("fnr0") + 1e-12)
    return both.groupBy("dataset").agg(F.count(F.lit(1)).alias("rules"), F.count_if(ok).alias("not_worse"), F.count_if("safe").alias("safe"))


@query("B6", f"{SQL_DECIDED} SELECT row_id, CAST(hybrid AS INT) AS prediction FROM dec")
def b6(spark, d):
    selected = rules.select_rule(searched(spark, d), ["dataset"])
    test = flows(spark, d).where("split = 'test'")
    return rules.apply_rule(test, selected, ["dataset"], SCORES).select("row_id", "prediction")


@query("B11", f"SELECT dst_ip, printf('{{\"maxDepth\": %d, \"numTrees\": %d}}', CASE WHEN k = 2 THEN 20 ELSE 10 END, CASE WHEN k = 1 THEN 256 ELSE 128 END) AS params, n FROM (SELECT dst_ip, CAST((length(dst_ip) - 4) % 3 AS INT) AS k, count(*) AS n FROM flows GROUP BY 1, 2)")
def b11(spark, d):
    """One-factor configurations looked up by id for result rows keyed by configuration."""
    grid = models.grid_table(spark, models.one_factor_grid({"numTrees": 128, "maxDepth": 10}, {"numTrees": [128, 256], "maxDepth": [20]}))
    names = F.array(F.lit("base"), F.lit("numTrees=256"), F.lit("maxDepth=20"))
    runs = flows(spark, d).groupBy("dst_ip").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("config_id", F.get(names, (F.length("dst_ip") - 4) % 3))
    return runs.join(grid, "config_id").select("dst_ip", "params", "n")


@query("B13", f"""WITH k AS (SELECT dataset, {sql_confusion(f'CAST(lstm_probability >= {T1} AS INT)')} FROM flows GROUP BY 1), h AS (SELECT dataset, {sql_confusion('prediction')} FROM ({SQL_FROZEN}) GROUP BY 1),
a AS (SELECT dataset, fp, fn, {sql_metrics()['f1']} AS f1 FROM k), b AS (SELECT dataset, fp, fn, {sql_metrics()['f1']} AS f1 FROM h)
SELECT a.dataset, 'before' AS from_stage, 'after' AS to_stage, {r('b.f1 - a.f1')} AS delta_f1, {r('b.f1 - a.f1')} AS f1_improvement, b.fp - a.fp AS delta_fp, a.fp - b.fp AS fp_improvement, b.fn - a.fn AS delta_fn, a.fn - b.fn AS fn_improvement FROM a JOIN b ON a.dataset = b.dataset""")
def b13(spark, d):
    df = frozen(flows(spark, d))
    table_ = rules.ablation(df, ["dataset"], "label", {"before": "baseline", "after": "prediction"})
    return reporting.stage_deltas(table_, ["dataset"], "model", ["before", "after"], ["f1", "fp", "fn"])


@query("B14", f"""WITH c AS (SELECT split, count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label = 1) AS malicious FROM flows WHERE split <> 'test' OR label = 0 GROUP BY 1), s AS (SELECT *, CAST(benign + malicious AS DOUBLE) / sum(benign + malicious) OVER () AS row_fraction, CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END AS target FROM c)
SELECT split, benign, malicious, {r('row_fraction')} AS row_fraction, {r('abs(row_fraction - target)')} AS deviation FROM s WHERE benign = 0 OR malicious = 0 OR abs(row_fraction - target) > 0.05""")
def b14(spark, d):
    return splits.split_is_valid(flows(spark, d).where("split <> 'test' OR label = 0"), "split", "label")
