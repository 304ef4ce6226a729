"""Hard cases and their evidence: strengths, context, payloads, decisions (W8, R3, X9, A23, N)."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import evidence as ev
from ..functions.numeric import safe_ratio
from ..functions.text import label_name
from ..operators import alignment, filters, prep, sequence, temporal
from ..plans import jobs
from ..session import cut_lineage
from .base import FEATURES, SCORES, T1, T2, T3, flows, query, r, sql_log, sql_number, table
from .cascade import SQL_FROZEN, frozen
from .temporal import SQL_POSITION

MODELS = {"lstm": ("lstm_probability", T1), "litemv": ("litemv_probability", T2), "rf": ("rf_probability", T3)}
CONTEXT = ["fwd_len_mean", "fwd_len_std", "flow_iat_std"]
RAW = sql_number("bytes_per_s_raw")


def scored_test(spark, d):
    """Test rows with frozen route, positions, and strengths against the validation rows."""
    df = frozen(flows(spark, d))
    df = temporal.source_positions(df, ["split", "source_file"], "ts", "row_id")
    test, validation = df.where("split = 'test'"), df.where("split = 'validation'")
    return alignment.add_strengths(test, validation, MODELS)


def _margin(m, t):
    return f"CASE WHEN {m}_probability >= {t} THEN {m}_probability - {t} ELSE {t} - {m}_probability END"


def _strength_sql():
    ctes = [f"fz AS (SELECT *, {SQL_POSITION} AS position, {', '.join(f'CAST({m}_probability >= {t} AS INT) AS {m}_pred, {_margin(m, t)} AS {m}_margin' for m, (_, t) in MODELS.items())} FROM ({SQL_FROZEN}))"]
    previous = "(SELECT * FROM fz WHERE split = 'test')"
    for m in MODELS:
        share = f"coalesce((SELECT CAST(count(*) FILTER (WHERE v.{m}_margin <= t.{m}_margin) AS DOUBLE) / nullif(count(*), 0) FROM fz v WHERE v.split = 'validation' AND v.{m}_pred = t.{m}_pred), 0.5)"
        ctes.append(f"s_{m} AS (SELECT *, {share} AS {m}_percentile FROM {previous} t)")
        previous = f"s_{m}"
    strength = lambda p: f"CASE WHEN {p} < 0.5 THEN 'WEAK' WHEN {p} < 0.9 THEN 'MODERATE' ELSE 'STRONG' END"
    ctes.append(f"st AS (SELECT *, {', '.join(f'{strength(f'{m}_percentile')} AS {m}_strength' for m in MODELS)}, least({', '.join(f'{m}_percentile' for m in MODELS)}) AS weakest_percentile FROM {previous})")
    targeted = "route = 'LITEMV_CONFIRMED_LSTM_POSITIVE' AND lstm_pred = 1 AND litemv_pred = 1 AND rf_pred = 0 AND lstm_strength = 'WEAK' AND litemv_strength = 'WEAK' AND rf_strength = 'STRONG'"
    ctes.append(f"""rs AS (SELECT *, CASE WHEN {targeted} THEN '{filters.REASON_TARGETED}' END AS targeted, CASE WHEN route IN ({', '.join(f"'{x}'" for x in K.HARD_ROUTES)}) THEN concat('{filters.REASON_ROUTE}', route) END AS hard FROM st)""")
    ctes.append("hc AS (SELECT *, coalesce(hard, targeted) AS escalation_reason FROM rs WHERE hard IS NOT NULL OR targeted IS NOT NULL)")
    return "WITH " + ", ".join(ctes)


SQL_STRENGTHS = _strength_sql()


@query("W9_strengths", f"{SQL_STRENGTHS} SELECT row_id, {', '.join(f'{m}_pred, {r(f'{m}_percentile')} AS {m}_percentile, {m}_strength' for m in MODELS)}, {r('weakest_percentile')} AS weakest_percentile FROM st")
def w9_strengths(spark, d):
    cols = [c for m in MODELS for c in (f"{m}_pred", f"{m}_percentile", f"{m}_strength")]
    return scored_test(spark, d).select("row_id", *cols, "weakest_percentile")


@query("X9", f"""{SQL_STRENGTHS} SELECT row_id, 'final-union' AS mode, escalation_reason FROM hc UNION ALL SELECT row_id, 'weak-confirmed-only', targeted FROM rs WHERE targeted IS NOT NULL UNION ALL SELECT row_id, 'legacy', hard FROM rs WHERE hard IS NOT NULL
UNION ALL SELECT row_id, 'low-support', coalesce(hard, targeted, CASE WHEN weakest_percentile <= 0.05 THEN '{filters.REASON_LOW_SUPPORT}' END) FROM rs WHERE hard IS NOT NULL OR targeted IS NOT NULL OR weakest_percentile <= 0.05""")
def x9(spark, d):
    df = scored_test(spark, d)
    out = None
    for name, mode, low in (("final-union", "final-union", False), ("weak-confirmed-only", "weak-confirmed-only", False), ("legacy", "legacy", False), ("low-support", "all", True)):
        part = filters.hard_cases(df, mode, low).select("row_id", F.lit(name).alias("mode"), "escalation_reason")
        out = part if out is None else out.unionByName(part)
    return out


DECISIONS = {"lstm_c2_fraction": "lstm_pred", "litemv_c2_fraction": "litemv_pred", "rf_c2_fraction": "rf_pred", "hybrid_c2_fraction": "prediction"}


def windowed_cases(spark, d):
    df = cut_lineage(scored_test(spark, d))
    cases = filters.hard_cases(df, "final-union")
    columns = sequence.window_columns("ts", [*CONTEXT, "bytes_per_s_raw", *DECISIONS.values()])
    columns["rate"] = F.expr("try_cast(bytes_per_s_raw AS DOUBLE)")
    return sequence.recent_windows(cases, df, ["split", "source_file"], "position", columns)


_frame = "OVER (PARTITION BY split, source_file ORDER BY position ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
SQL_WINDOWS = f"""{SQL_STRENGTHS}, wn AS (SELECT *, count(*) {_frame} AS flows_in_window, list(epoch_us(ts)) {_frame} AS tl, {', '.join(f'list(CAST({f} AS DOUBLE)) {_frame} AS l_{f}' for f in CONTEXT)}, {', '.join(f'avg({c}) {_frame} AS {n}' for n, c in DECISIONS.items())} FROM st),
cs AS (SELECT wn.*, list_sort(tl) AS ts_sorted FROM wn WHERE row_id IN (SELECT row_id FROM hc)),
cg AS (SELECT *, [(ts_sorted[i + 1] - ts_sorted[i]) / 1e6 FOR i IN range(1, len(ts_sorted))] AS gaps FROM cs)"""


def _cv(lst):
    return (
        f"CASE WHEN len({lst}) < 2 OR list_avg(list_transform({lst}, lambda x: abs(x))) <= 1e-12 THEN 0.0 "
        f"ELSE list_aggregate({lst}, 'stddev_pop') / list_avg(list_transform({lst}, lambda x: abs(x))) END"
    )


@query("W8", f"""{SQL_WINDOWS} SELECT row_id, CAST(flows_in_window AS INT) AS flows_in_window, {r('list_median(gaps)', 4)} AS gap_median, {r(_cv('gaps'))} AS gap_cv,
{', '.join(f"{r(f'list_median(l_{f})')} AS {f}_median, {r(_cv(f'l_{f}'))} AS {f}_cv" for f in CONTEXT)}, {', '.join(f'{r(n)} AS {n}' for n in DECISIONS)} FROM cg""")
def w8(spark, d):
    got = sequence.with_sequence_context(windowed_cases(spark, d), CONTEXT, DECISIONS, "c").select("row_id", "c")
    summary = [F.col(f"c.recent_behavior_summary.{f}.{a}").alias(f"{f}_{b}") for f in CONTEXT for a, b in (("median", "median"), ("coefficient_of_variation", "cv"))]
    return got.select(
        "row_id", "c.flows_in_window", F.round("c.inter_flow_gap_seconds.median", 4).alias("gap_median"),
        F.col("c.inter_flow_gap_seconds.coefficient_of_variation").alias("gap_cv"), *summary, "c.recent_model_behavior.*",
    )


BEHAVIOR = {
    "duration": "fwd_len_mean", "ratios": {"length_ratio": ("fwd_len_mean", "flow_iat_std")}, "direct": [], "sizes": ["fwd_len_std"],
}


def _level(cv, n, high, moderate, noun):
    return f"CASE WHEN {n} < 3 THEN 'INSUFFICIENT_HISTORY' WHEN {cv} <= {high} THEN 'HIGH_{noun}' WHEN {cv} <= {moderate} THEN 'MODERATE_{noun}' ELSE 'LOW_{noun}' END"


_ratios = "[x FOR x IN [CASE WHEN abs(l_flow_iat_std[i]) > 1e-12 THEN l_fwd_len_mean[i] / l_flow_iat_std[i] END FOR i IN range(1, len(l_fwd_len_mean) + 1)] IF x IS NOT NULL]"
_mad = lambda l: f"list_median(list_transform({l}, lambda x: abs(x - list_median({l}))))"


@query("A23", f"""{SQL_WINDOWS}, q AS (SELECT *, {_ratios} AS ratios FROM cg) SELECT row_id, CAST(len(gaps) AS INT) AS gap_count, {r('list_median(gaps)', 4)} AS gap_median, {r(_mad('gaps'), 4)} AS gap_mad, {_level(_cv('gaps'), 'len(gaps)', 0.15, 0.35, 'REGULARITY')} AS regularity, {r('gaps[len(gaps)]', 4)} AS newest_gap,
CAST(len(l_fwd_len_mean) AS INT) AS length_count, {r('list_avg(l_fwd_len_mean)')} AS length_mean, {r("list_aggregate(l_fwd_len_mean, 'stddev_pop')")} AS length_std, {r(_mad('l_fwd_len_mean'))} AS length_mad, {r('CASE WHEN abs(list_median(l_fwd_len_mean)) > 1e-12 THEN fwd_len_mean / list_median(l_fwd_len_mean) END')} AS current_ratio,
{r('abs(fwd_len_mean - list_median(l_fwd_len_mean)) / greatest(abs(list_median(l_fwd_len_mean)), 1e-12)')} AS current_deviation, {_level(_cv('l_fwd_len_mean'), 'len(l_fwd_len_mean)', 0.2, 0.5, 'STABILITY')} AS stability, {r('list_median(ratios)')} AS ratio_median FROM q""")
def a23(spark, d):
    got = sequence.with_behavioral_context(windowed_cases(spark, d), **BEHAVIOR, out="b").select("row_id", "b")
    t, u, v = "b.beaconing_timing.", "b.flow_duration_behavior.", "b.directionality_behavior.length_ratio."
    return got.select(
        "row_id", F.col(t + "usable_inter_flow_gaps").alias("gap_count"), F.round(t + "median", 4).alias("gap_median"),
        F.round(t + "median_absolute_deviation", 4).alias("gap_mad"), F.col(t + "regularity_level").alias("regularity"),
        F.round(t + "most_recent_gap_seconds", 4).alias("newest_gap"), F.col(u + "count").alias("length_count"),
        F.col(u + "mean").alias("length_mean"), F.col(u + "std").alias("length_std"), F.col(u + "median_absolute_deviation").alias("length_mad"),
        F.col(u + "current_to_recent_median_ratio").alias("current_ratio"),
        F.col(u + "current_fractional_deviation_from_recent_median").alias("current_deviation"),
        F.col(u + "stability_level").alias("stability"), F.col(v + "median").alias("ratio_median"),
    )


BASE_FEATURES = ["fwd_len_mean", "flow_iat_std", "bytes_per_s_raw"]


def baseline(spark, d):
    table_ = prep.benign_baseline(flows(spark, d).where("split = 'train'"), "label", BASE_FEATURES)
    return {f: s for f, s in prep.collect_state(table_, BASE_FEATURES).items()}


def _deviation_sql():
    parts = []
    for i, (f, e) in enumerate((("fwd_len_mean", "fwd_len_mean"), ("flow_iat_std", "flow_iat_std"), ("bytes_per_s_raw", f"({RAW})"))):
        b = f"(SELECT median(x) AS m, CASE WHEN abs(quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) > 1e-12 THEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) ELSE 1 END AS q FROM (SELECT {sql_log(e)} AS x FROM flows WHERE split = 'train' AND label = 0))"
        parts.append(f"SELECT row_id, {i} AS i, '{f}' AS feature, ({sql_log(e)} - m) / q AS v FROM flows, {b} WHERE split = 'test'")
    return " UNION ALL ".join(parts)


SQL_TOP = f"""SELECT row_id, CAST(k - 1 AS INT) AS place, feature, CASE WHEN v >= 0 THEN 'ABOVE_BENIGN_BASELINE' ELSE 'BELOW_BENIGN_BASELINE' END AS direction, {r('abs(v)')} AS deviation FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(v) DESC, i) AS k FROM ({_deviation_sql()}) WHERE v IS NOT NULL) WHERE k <= 5"""


@query("R3", SQL_TOP)
def r3(spark, d):
    df = jobs.deviations(flows(spark, d).where("split = 'test'"), baseline(spark, d))
    top = ev.strongest_deviations(F.col("deviations"), K.DEVIATION_TOP_K)
    return df.select("row_id", F.posexplode(top).alias("place", "x")).select(
        "row_id", "place", "x.feature", "x.direction", F.col("x.absolute_robust_deviation").alias("deviation")
    )


def evidence(spark, d):
    return jobs.evidence_cases(
        scored_test(spark, d), keys=["split", "source_file"], position="position", ts="ts", features=CONTEXT,
        baseline={f: s for f, s in baseline(spark, d).items() if f != "bytes_per_s_raw"}, models_used=list(MODELS),
        behavior=BEHAVIOR,
    )


_meaning = "CASE route " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ev.ROUTE_MEANINGS.items()) + f" ELSE '{ev.ROUTE_WITHOUT_MEANING}' END"


@query("N1", f"""{SQL_STRENGTHS} SELECT row_id, printf('case_%05d', row_number() OVER (ORDER BY split, source_file, position)) AS case_id, escalation_reason, CASE WHEN prediction = 1 THEN 'COBALT_STRIKE_HTTPS_C2' ELSE 'NOT_COBALT_STRIKE_HTTPS_C2' END AS decision, route,
lstm_strength, CASE WHEN rf_pred = 1 THEN 'COBALT_STRIKE_HTTPS_C2' ELSE 'NOT_COBALT_STRIKE_HTTPS_C2' END AS rf_prediction, {r('fwd_len_mean')} AS length, CAST(2 AS INT) AS n_deviations, {_meaning} AS meaning, CAST(least(position + 1, 20) AS INT) AS flows_in_window FROM hc""")
def n1(spark, d):
    p = "payload."
    return evidence(spark, d).select(
        "row_id", p + "case_id", p + "escalation_reason", F.col(p + "existing_hybrid_decision").alias("decision"),
        F.col(p + "hybrid_decision_route").alias("route"), F.col(p + "hybrid_route_interpretation").alias("meaning"), F.col(p + "upstream_evidence.lstm.validation_calibrated_strength").alias("lstm_strength"),
        F.col(p + "upstream_evidence.rf.prediction").alias("rf_prediction"), F.col("payload.current_flow_telemetry")["fwd_len_mean"].alias("length"),
        F.size(p + "strongest_current_flow_benign_deviations").alias("n_deviations"), F.col(p + "sequence_context.flows_in_window").alias("flows_in_window"),
    )


_ALL = ["case_id", "target_task", "escalation_reason", "existing_hybrid_decision", "hybrid_decision_route", "hybrid_route_interpretation", "upstream_evidence", "current_flow_telemetry", "strongest_current_flow_benign_deviations", "sequence_context", "interpretation_warning", "behavioral_context_o1"]
_HIDDEN = {
    "full": [], "behavioral_o1": [], "no_sequence": ["sequence_context"], "no_benign_deviations": ["strongest_current_flow_benign_deviations"],
    "models_only": ["current_flow_telemetry", "strongest_current_flow_benign_deviations", "sequence_context", "behavioral_context_o1"],
    "telemetry_only": ["upstream_evidence", "hybrid_decision_route", "hybrid_route_interpretation"],
}


@query("N2", f"{SQL_STRENGTHS} " + " UNION ALL ".join(
    f"SELECT row_id, '{v}' AS variant, '{','.join(k for k in _ALL if k not in h)}' AS fields FROM hc" for v, h in _HIDDEN.items()
))
def n2(spark, d):
    cases = cut_lineage(evidence(spark, d).select("row_id", "payload"))
    out = None
    for v in ev.CONTEXT_VARIANTS:
        keys = F.json_object_keys(F.to_json(ev.context_variant(F.col("payload"), v)))
        part = cases.select("row_id", F.lit(v).alias("variant"), F.concat_ws(",", keys).alias("fields"))
        out = part if out is None else out.unionByName(part)
    return out


ANSWERS = [
    '{"recommended_action": "OVERRIDE_TO_C2", "confidence": "HIGH", "target_specificity": "SUPPORTS_C2", "evidence": ["a", "b"], "conflict_summary": "none"}',
    '{"recommended_action": "OVERRIDE_TO_NON_C2", "confidence": "HIGH", "target_specificity": "CONTRADICTS_C2", "evidence": ["a", "tail of a li',
    '{"recommended_action": "OVERRIDE_TO_C2", "confidence": "SURE", "target_specificity": "SUPPORTS_C2", "evidence": ["a"], "conflict_summary": "x"}',
    '["not", "an object"]',
    '{"recommended_action": "OVERRIDE_TO_C2", "confidence": "HI',
    '{"recommended_action": "KEEP_HYBRID", "confidence": "LOW", "target_specificity": "NON_SPECIFIC", "evidence": [], "conflict_summary": "c"}',
    '{"recommended_action" "OVERRIDE_TO_C2", "confidence": "HIGH", "target_specificity": "SUPPORTS_C2", "evidence": ["a"], "conflict_summary": "x"}',
    '{"recommended_action": "OVERRIDE_TO_C2", "confidence": "MEDIUM", "target_specificity": "SUPPORTS_C2", "evidence": ["a"], "conflict_summary": "x"}',
    '{"recommended_action": "OVERRIDE_TO_C2", "confidence": "HIGH", "target_specificity": "NON_SPECIFIC", "evidence": ["a"], "conflict_summary": "x"}',
    '{"recommended_action": "OVERRIDE_TO_C2", "confidence": "HIGH", "target_specificity": "SUPPORTS_C2", "evidence": ["a"], "conflict_summary": null}',
    '{"recommended_action": "OVERRIDE_TO_C2", "confidence": "HIGH", "target_specificity": "SUPPORTS_C2", "evidence": ["a"], "conflict_summary": 5}',
    '{"recommended_action": "OVERRIDE_TO_C2", "confidence": "HIGH", "target_specificity": "SUPPORTS_C2", "evidence": [1, {"x": 2}], "conflict_summary": "x"}',
    '{"recommended_action": "OVERRIDE_TO_C2", "confidence": "HIGH", "target_specificity": "SUPPORTS_C2", "evidence": [1, {"x": 2}], "conflict',
    '{"recommended_action": "OVERRIDE_TO_C2", "confidence": "HIGH", "target_specificity": "SUPPORTS_C2", "evidence": ["a"]}',
]
_EXPECT = [
    ("OVERRIDE_TO_C2", "HIGH", "SUPPORTS_C2", "a|b", "none"),
    ("OVERRIDE_TO_NON_C2", "HIGH", "CONTRADICTS_C2", "a", ev.NOTE_RECOVERED),
    None,
    None,
    None,
    ("KEEP_HYBRID", "LOW", "NON_SPECIFIC", ev.NOTE_TRUNCATED, "c"),
    None,
    ("OVERRIDE_TO_C2", "MEDIUM", "SUPPORTS_C2", "a", "x"),
    ("OVERRIDE_TO_C2", "HIGH", "NON_SPECIFIC", "a", "x"),
    None,
    None,
    None,
    None,
    ("OVERRIDE_TO_C2", "HIGH", "SUPPORTS_C2", "a", ev.NOTE_RECOVERED),
]
_FAIL = ("KEEP_HYBRID", "LOW", "NON_SPECIFIC", ev.NOTE_INVALID, ev.NOTE_FAIL_CLOSED + "partial JSON lacked a complete valid decision")
_EXPECT = [e or _FAIL for e in _EXPECT]
_EXPECT[3] = (*_FAIL[:4], ev.NOTE_FAIL_CLOSED + "partial JSON was not an object")


def _case_of(i: int) -> str:
    return f"CASE row_id % {len(ANSWERS)} " + " ".join(f"WHEN {k} THEN '{e[i]}'" for k, e in enumerate(_EXPECT)) + " END"


def answered(df):
    texts = F.array(*[F.lit(a) for a in ANSWERS])
    return df.withColumn("answer", F.get(texts, (F.col("row_id") % len(ANSWERS)).cast("int")))


@query("N3", f"SELECT row_id, {_case_of(0)} AS recommended_action, {_case_of(1)} AS confidence, {_case_of(2)} AS target_specificity, {_case_of(3)} AS evidence, {_case_of(4)} AS conflict_summary FROM flows")
def n3(spark, d):
    got = answered(flows(spark, d)).select("row_id", ev.parse_decision(F.col("answer")).alias("x"))
    return got.select("row_id", "x.recommended_action", "x.confidence", "x.target_specificity", F.concat_ws("|", "x.evidence").alias("evidence"), "x.conflict_summary")


_act, _conf, _spec = _case_of(0), _case_of(1), _case_of(2)
SQL_GATE = f"""gt AS (SELECT *, CASE WHEN act = 'KEEP_HYBRID' THEN 'LLM_KEEP_HYBRID' WHEN CAST(act = 'OVERRIDE_TO_C2' AS INT) = prediction THEN 'LLM_ACTION_MATCHES_HYBRID' WHEN conf <> 'HIGH' THEN 'REJECTED_NOT_HIGH_CONFIDENCE'
WHEN spec <> CASE WHEN act = 'OVERRIDE_TO_C2' THEN 'SUPPORTS_C2' ELSE 'CONTRADICTS_C2' END THEN 'REJECTED_SPECIFICITY_MISMATCH' WHEN NOT ('WEAK' IN (lstm_strength, litemv_strength, rf_strength)) THEN 'REJECTED_NO_WEAK_UPSTREAM_MODEL' ELSE 'STRICT_GATE_ACCEPTED_OVERRIDE' END AS gate_reason
FROM (SELECT *, {_act} AS act, {_conf} AS conf, {_spec} AS spec FROM st))"""


@query("N4", f"""{SQL_STRENGTHS}, {SQL_GATE} SELECT row_id, gate_reason, gate_reason = 'STRICT_GATE_ACCEPTED_OVERRIDE' AS override_accepted, CAST(CASE WHEN gate_reason = 'STRICT_GATE_ACCEPTED_OVERRIDE' THEN CAST(act = 'OVERRIDE_TO_C2' AS INT) ELSE prediction END AS INT) AS final_label FROM gt""")
def n4(spark, d):
    """Every scored test row put through the gate with a stored answer."""
    df = answered(scored_test(spark, d))
    got = jobs.arbitrate(df, "answer", list(MODELS))
    return got.select("row_id", "gate_reason", "override_accepted", "final_label")


@query("N5", f"""{SQL_STRENGTHS} SELECT row_id, concat('Case: ', '{{"row_id":', row_id, ',"route":"', route, '"}}', ' Decide.') AS prompt FROM hc""")
def n5(spark, d):
    cases = filters.hard_cases(scored_test(spark, d), "final-union")
    return cases.select("row_id", ev.prompt_text("Case: ", F.struct("row_id", "route"), " Decide.").alias("prompt"))
