"""Nested evidence payloads, structured decisions and the safety gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import label_name

# Explanations and warnings shown with a case.
TARGET_TASK = "Detect Cobalt Strike Beacon command-and-control over HTTPS from network-flow metadata."
WARNING = (
    "Anomaly and repetition are contextual signals only; neither is automatically evidence of Cobalt Strike."
)
# What the routes of the cascade mean.
ROUTE_MEANINGS = {
    "RF_ARBITRATED_KEEP_MALICIOUS": (
        "The LSTM produced a borderline malicious decision. LITEMV did not meet its confirmation threshold, so RF arbitrated "
        "and confirmed malicious."
    ),
    "LITEMV_RF_FILTERED_LSTM_POSITIVE": (
        "The LSTM produced a borderline malicious decision. LITEMV did not confirm it, and RF also failed to confirm it, so "
        "the hybrid changed the final decision to non-C2."
    ),
    "JOINT_LITEMV_RF_RESCUE": (
        "The LSTM predicted non-C2, but both LITEMV and RF exceeded strict rescue thresholds, so the hybrid changed the final "
        "decision to C2."
    ),
}
ROUTE_WITHOUT_MEANING = "The frozen hybrid produced this route without LLM involvement."
CONTEXT_VARIANTS = ["full", "behavioral_o1", "no_sequence", "no_benign_deviations", "models_only", "telemetry_only"]

# Allowed decision words.
ACTIONS = ["KEEP_HYBRID", "OVERRIDE_TO_C2", "OVERRIDE_TO_NON_C2"]
CONFIDENCES = ["LOW", "MEDIUM", "HIGH"]
SPECIFICITIES = ["NON_SPECIFIC", "SUPPORTS_C2", "CONTRADICTS_C2"]

# Audit notes for incomplete decisions.
NOTE_INVALID = "Structured LLM output was incomplete or invalid; the hybrid decision was retained safely."
NOTE_TRUNCATED = "The model response was truncated after emitting its classification fields."
NOTE_RECOVERED = (
    "The structured response was truncated after the completed decision fields; "
    "the decision was recovered without changing the safety gate."
)
NOTE_FAIL_CLOSED = "Fail-closed structured-output fallback: "

def telemetry_map(features: list[str]) -> Column:
    """Map of the finite features of a row."""
    entries = F.array(*[F.struct(F.lit(f), F.col(f"`{f}`").cast("double")) for f in features])
    kept = F.filter(entries, lambda e: e["col2"].isNotNull() & ~F.isnan(e["col2"]) & (F.abs(e["col2"]) != float("inf")))
    return F.map_from_entries(kept)


def strongest_deviations(deviations: Column, k: int) -> Column:
    """The ``k`` largest of an array of (feature, signed deviation), with direction; array order breaks ties."""
    indexed = F.transform(
        F.filter(deviations, lambda d: d["deviation"].isNotNull()),
        lambda d, i: F.struct(
            (-F.abs(d["deviation"])).alias("rank"), i.alias("i"), d["feature"].alias("feature"), d["deviation"].alias("deviation")
        ),
    )
    return F.transform(
        F.slice(F.array_sort(indexed), 1, k),
        lambda d: F.struct(
            d["feature"].alias("feature"),
            F.when(d["deviation"] >= 0, "ABOVE_BENIGN_BASELINE").otherwise("BELOW_BENIGN_BASELINE").alias("direction"),
            F.abs(d["deviation"]).alias("absolute_robust_deviation"),
        ),
    )


def route_meaning(route: Column) -> Column:
    """Explanation of a cascade route."""
    known = F.create_map(*[F.lit(x) for pair in ROUTE_MEANINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, route), F.lit(ROUTE_WITHOUT_MEANING))


def score_evidence(models: list[str]) -> Column:
    """Predicted class name and evidence strength per model, from ``<model>_pred`` and ``<model>_strength``."""
    return F.struct(
        *[
            F.struct(
                label_name(F.col(f"{m}_pred")).alias("prediction"),
                F.col(f"{m}_strength").alias("validation_calibrated_strength"),
            ).alias(m)
            for m in models
        ]
    )


def context_variant(payload: Column, variant: str) -> Column:
    """Payload struct without the fields the variant hides."""
    hidden = {
        "full": [],
        "behavioral_o1": [],
        "no_sequence": ["sequence_context"],
        "no_benign_deviations": ["strongest_current_flow_benign_deviations"],
        "models_only": [
            "current_flow_telemetry", "strongest_current_flow_benign_deviations", "sequence_context", "behavioral_context_o1",
        ],
        "telemetry_only": ["upstream_evidence", "hybrid_decision_route", "hybrid_route_interpretation"],
    }[variant]
    return payload.dropFields(*hidden) if hidden else payload


# -- structured decisions ------------------------------------------------------

_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_LIST = rf"\[\s*(?:{_TEXT}\s*(?:,\s*{_TEXT}\s*)*+)?+\]"
_VALUE = rf"(?:{_TEXT}|{_LIST}|-?[0-9.eE+-]+|true|false|null)"
_PAIR = rf"{_TEXT}\s*:\s*{_VALUE}"
_OPEN_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+\\?'
_OPEN_VALUE = rf"(?:{_OPEN_TEXT}|\[\s*(?:{_TEXT}\s*,\s*)*+(?:{_TEXT}|{_OPEN_TEXT})?\s*|-?[0-9.eE+-]*|[a-z]*)"
_OPEN_PAIR = rf"(?:{_OPEN_TEXT}|{_TEXT}\s*(?::\s*{_OPEN_VALUE})?)"
TRUNCATED_OBJECT = rf"(?s)^\s*\{{\s*(?:{_PAIR}\s*,\s*)*+(?:{_PAIR}\s*,?\s*|{_OPEN_PAIR})?$"


def _allowed(value: Column, words: list[str]) -> Column:
    return F.coalesce(value.isin(*words), F.lit(False))


def _unescape(quoted: Column) -> Column:
    return F.from_json(F.concat(F.lit('{"v":'), quoted, F.lit("}")), "v string")["v"]


_FIELDS = ["recommended_action", "confidence", "target_specificity"]


def _valid(decision: Column) -> Column:
    items = decision["evidence"]
    return (
        _allowed(decision["recommended_action"], ACTIONS)
        & _allowed(decision["confidence"], CONFIDENCES)
        & _allowed(decision["target_specificity"], SPECIFICITIES)
        & F.coalesce(F.size(items).between(1, 4) & ~F.exists(items, lambda e: e.isNull()), F.lit(False))
        & decision["conflict_summary"].isNotNull()
    )


def _complete_decision(answer: Column) -> Column:
    """Decision of a complete JSON object.  Every field must be a text, evidence a list of texts; of another kind it is null.

    Only an absent summary and an absent, empty or unlisted evidence are replaced by their notes.
    """
    kind = lambda name: F.schema_of_variant(F.try_variant_get(answer, f"$.{name}", "variant"))
    text = lambda name: F.when(kind(name) == "STRING", F.try_variant_get(answer, f"$.{name}", "string"))
    items = F.try_variant_get(answer, "$.evidence", "array<variant>")
    listed = F.coalesce(kind("evidence").startswith("ARRAY"), F.lit(False)) & (F.size(items) > 0)
    strings = F.when(kind("evidence") == "ARRAY<STRING>", F.try_variant_get(answer, "$.evidence", "array<string>"))
    summary = F.when(kind("conflict_summary").isNull(), NOTE_RECOVERED).otherwise(text("conflict_summary"))
    return F.struct(
        *[text(name).alias(name) for name in _FIELDS],
        F.when(listed, strings).otherwise(F.array(F.lit(NOTE_TRUNCATED))).alias("evidence"), summary.alias("conflict_summary"),
    )


def _truncated_decision(text: Column) -> Column:
    """Completed fields of an object that breaks off; a completed field of another kind than text is null."""

    def field(name: str) -> Column:
        return _unescape(F.nullif(F.regexp_extract(text, rf'"{name}"\s*:\s*({_TEXT})', 1), F.lit("")))

    def other_kind(name: str) -> Column:
        return text.rlike(rf'"{name}"\s*:\s*(?:-?[0-9]|true|false|null|\[|\{{)')

    listed = F.regexp_extract(text, rf'"evidence"\s*:\s*\[((?:\s*{_TEXT}\s*,?)*+)', 1)
    items = F.transform(F.regexp_extract_all(listed, F.lit(f"({_TEXT})"), F.lit(1)), _unescape)
    mixed = text.rlike(rf'"evidence"\s*:\s*\[(?:\s*{_TEXT}\s*,?)*+\s*[^\s"\]]')
    summary = F.when(~other_kind("conflict_summary"), F.coalesce(field("conflict_summary"), F.lit(NOTE_RECOVERED)))
    return F.struct(
        *[field(name).alias(name) for name in _FIELDS],
        F.when(~mixed, F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(NOTE_TRUNCATED)))).alias("evidence"),
        summary.alias("conflict_summary"),
    )


def parse_decision(text: Column) -> Column:
    """Decision struct from a JSON answer, failing closed.

    A complete valid answer is taken as it is.  Narrative fields that are absent
    give way to a note, and a truncated answer keeps its completed fields;
    anything else becomes the decision that changes nothing.
    """
    answer = F.try_parse_json(text)
    is_object = F.coalesce(F.schema_of_variant(answer).startswith("OBJECT"), F.lit(False))
    complete, truncated = _complete_decision(answer), _truncated_decision(text)
    fail = F.struct(
        F.lit("KEEP_HYBRID").alias("recommended_action"),
        F.lit("LOW").alias("confidence"),
        F.lit("NON_SPECIFIC").alias("target_specificity"),
        F.array(F.lit(NOTE_INVALID)).alias("evidence"),
        F.concat(
            F.lit(NOTE_FAIL_CLOSED),
            F.when(answer.isNotNull() & ~is_object, "partial JSON was not an object").otherwise("partial JSON lacked a complete valid decision"),
        ).alias("conflict_summary"),
    )
    broken = answer.isNull() & F.coalesce(text.rlike(TRUNCATED_OBJECT), F.lit(False))
    return F.when(is_object & _valid(complete), complete).when(broken & _valid(truncated), truncated).otherwise(fail)


def safety_gate(
    hybrid: Column, decision: Column, *strengths: Column, allow_overrides: bool = True, require_high_confidence: bool = True,
    require_direction: bool = True, require_weak_model: bool = True,
) -> Column:
    """Struct (final_label, override_accepted, gate_reason): an override must be allowed at all and, unless a switch
    is off, be confident, point the same way as its evidence and meet at least one weak upstream score."""
    action = decision["recommended_action"]
    requested = (action == "OVERRIDE_TO_C2").cast("int")
    expected = F.when(requested == 1, "SUPPORTS_C2").otherwise("CONTRADICTS_C2")
    any_weak = F.array_contains(F.array(*strengths), "WEAK")
    # Gate reasons.
    reason = F.when(action == "KEEP_HYBRID", "LLM_KEEP_HYBRID").when(requested == hybrid, "LLM_ACTION_MATCHES_HYBRID")
    if not allow_overrides:
        reason = reason.otherwise("AUTOMATIC_OVERRIDES_DISABLED")
    else:
        if require_high_confidence:
            reason = reason.when(decision["confidence"] != "HIGH", "REJECTED_NOT_HIGH_CONFIDENCE")
        if require_direction:
            reason = reason.when(decision["target_specificity"] != expected, "REJECTED_SPECIFICITY_MISMATCH")
        if require_weak_model:
            reason = reason.when(~F.coalesce(any_weak, F.lit(False)), "REJECTED_NO_WEAK_UPSTREAM_MODEL")
        reason = reason.otherwise("STRICT_GATE_ACCEPTED_OVERRIDE")
    accepted = reason == "STRICT_GATE_ACCEPTED_OVERRIDE"
    return F.struct(
        F.when(accepted, requested).otherwise(hybrid.cast("int")).alias("final_label"),
        accepted.alias("override_accepted"),
        reason.alias("gate_reason"),
    )


def prompt_text(template_head: str, payload: Column, template_tail: str = "") -> Column:
    return F.concat(F.lit(template_head), F.to_json(payload), F.lit(template_tail))
