"""Exhaustive search of cascade thresholds.

A rule only asks how a row's scores compare with candidate thresholds, so the
rows are first reduced to counts per grid cell (how many candidates each score
reaches).  The number of cells is fixed by the candidate lists, whatever the
table size, and every rule is a sum over cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.cascade import Rule, three_score, two_score
from ..functions.numeric import EPS, next_up
from ..session import cut_lineage
from .metrics import confusion, rates
from .ordered import bounded_broadcast, exact_quantiles, unpivot


def _sorted_distinct(values: Column, low: float, high: float | None = None) -> Column:
    kept = F.filter(
        values, lambda v: v.isNotNull() & (v >= low) & (F.lit(True) if high is None else v <= high)
    )
    return F.array_sort(F.array_distinct(kept))


def cutoff_candidates(df: DataFrame, keys: Sequence[str], primary: str, threshold: float) -> DataFrame:
    """The threshold and quantiles of the scores that reach it: keys, cutoffs."""
    positive = df.where(F.col(primary) >= threshold)
    got = exact_quantiles(positive, keys, primary, K.CUTOFF_QUANTILES)
    values = F.concat(F.array(F.lit(float(threshold))), "q")
    return got.select(*keys, _sorted_distinct(values, float(threshold) - EPS).alias("cutoffs"))


def confirm_candidates(
    df: DataFrame, keys: Sequence[str], primary: str, threshold: float, score: str, own: float, out: str
) -> DataFrame:
    """0, the score's own threshold, 1 and quantiles of the routed rows."""
    routed = df.where(F.col(primary) >= threshold)
    got = exact_quantiles(routed, keys, score, K.CONFIRM_QUANTILES)
    values = F.concat(F.array(F.lit(0.0), F.lit(float(own)), F.lit(1.0)), "q")
    return got.select(*keys, _sorted_distinct(values, -EPS, 1.0 + EPS).alias(out))


def rescue_thresholds(
    df: DataFrame, keys: Sequence[str], label: str, primary: str, threshold: float, floors: Mapping[str, float]
) -> DataFrame:
    """Per score the value just above every benign row the primary score rejects, but at least its floor."""
    benign = (F.col(primary) < threshold) & (F.col(label) == 0)
    return df.groupBy(*keys).agg(
        *[
            F.coalesce(F.greatest(F.lit(float(floor)), next_up(F.max(F.when(benign, F.col(score))))), F.lit(float(floor))).alias(
                f"{score}_rescue"
            )
            for score, floor in floors.items()
        ]
    )


def _reached(score: Column, candidates: Column) -> Column:
    """How many ascending candidates the score reaches."""
    return F.size(F.filter(candidates, lambda c: score >= c))


def _spread(cells: DataFrame, keys: Sequence[str], dim: str, size: Column, others: Sequence[str]) -> DataFrame:
    """Cumulative counts along one grid dimension: a cell counts for every index from its own up."""
    last = size - 1
    return (
        cells.where(F.col(dim) <= last)
        .withColumn(dim, F.explode(F.sequence(F.col(dim), last)))
        .groupBy(*keys, *others, dim)
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )


def _candidates(
    df: DataFrame, keys: Sequence[str], label: str, primary: str, threshold: float, others: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """One row per key: array ``cutoffs``, an array per further score (name -> score, own threshold), rescue thresholds.

    All quantiles come from one pass over the routed rows.
    """
    probs = sorted({*K.CUTOFF_QUANTILES, *K.CONFIRM_QUANTILES})
    scores = [primary, *[score for score, _ in others.values()]]
    routed = unpivot(df.where(F.col(primary) >= threshold), keys, scores, "__score", "__value")
    got = exact_quantiles(routed, [*keys, "__score"], "__value", probs)
    pick = lambda score, wanted: F.max(
        F.when(F.col("__score") == score, F.array(*[F.col("q")[probs.index(p)] for p in wanted]))
    )
    wide = got.groupBy(*keys).agg(
        pick(primary, K.CUTOFF_QUANTILES).alias("cutoffs"),
        *[pick(score, K.CONFIRM_QUANTILES).alias(name) for name, (score, _) in others.items()],
    )
    fixed = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    arrays = {"cutoffs": _sorted_distinct(F.concat(fixed(threshold), "cutoffs"), float(threshold) - EPS)}
    for name, (_, own) in others.items():
        arrays[name] = _sorted_distinct(F.concat(fixed(0, own, 1), name), -EPS, 1.0 + EPS)
    rescue = rescue_thresholds(df, keys, label, primary, threshold, dict(others.values()))
    return cut_lineage(wide.withColumns(arrays).join(rescue, list(keys)))


def search_three_score(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    scores: Sequence[str],
    thresholds: Sequence[float],
) -> DataFrame:
    """Counts and rates of every rule, with the primary-only baseline and a ``safe`` flag.

    Safe rules do not worsen FPR or FNR and strictly raise F1.  The rows are
    read three times (quantiles, rescue limits, cells); everything after works
    on the cells, whose number the candidate lists bound.
    """
    primary, second, third = scores
    t1, t2, t3 = (float(t) for t in thresholds)
    cands = _candidates(df, keys, label, primary, t1, {"seconds": (second, t2), "thirds": (third, t3)})

    rows = df.select(*keys, label, *scores).join(bounded_broadcast(cands), list(keys))
    p, s, t = (F.col(c) for c in scores)
    positive = p >= t1
    rescued = ~positive & (s >= F.col(f"{second}_rescue")) & (t >= F.col(f"{third}_rescue"))
    # index of the first cutoff that routes the row, and of the first confirm threshold it fails
    first_cut = F.size("cutoffs") - F.size(F.filter("cutoffs", lambda c: p <= c + EPS))
    cells = cut_lineage(
        rows.groupBy(
            *keys,
            positive.alias("positive"),
            rescued.alias("rescued"),
            F.when(positive, first_cut).alias("a"),
            F.when(positive, _reached(s, F.col("seconds"))).alias("b"),
            F.when(positive, _reached(t, F.col("thirds"))).alias("c"),
        ).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    )
    sizes = cands.select(*keys, F.size("cutoffs").alias("na"), F.size("seconds").alias("nb"), F.size("thirds").alias("nc"))
    base = cells.groupBy(*keys).agg(
        *[
            F.sum(F.when(cond, F.col(n)).otherwise(0)).alias(out)
            for out, cond, n in (
                ("tn0", ~F.col("positive"), "n0"),
                ("fp0", F.col("positive"), "n0"),
                ("fn0", ~F.col("positive"), "n1"),
                ("tp0", F.col("positive"), "n1"),
                ("r0", F.col("rescued"), "n0"),
                ("r1", F.col("rescued"), "n1"),
            )
        ]
    )
    grid = cells.where("positive").join(bounded_broadcast(sizes), list(keys))
    size_cols = ["na", "nb", "nc"]
    by_a = _spread(grid, keys, "a", F.col("na"), ["b", "c", *size_cols])
    by_ab = _spread(by_a, keys, "b", F.col("nb"), ["a", "c", *size_cols])
    by_abc = _spread(by_ab, keys, "c", F.col("nc"), ["a", "b", *size_cols])
    routed = by_a.groupBy(*keys, "a").agg(F.sum(F.col("n0") + F.col("n1")).alias("routed"))
    arbiter = by_ab.groupBy(*keys, "a", "b").agg(F.sum(F.col("n0") + F.col("n1")).alias("arbiter"))

    rules = (
        cands.select("*", F.posexplode("cutoffs").alias("a", "positive_filter_cutoff"))
        .select("*", F.posexplode("seconds").alias("b", "second_confirm_threshold"))
        .select("*", F.posexplode("thirds").alias("c", "third_confirm_threshold"))
        .drop("cutoffs", "seconds", "thirds")
        .withColumnsRenamed({f"{second}_rescue": "second_rescue_threshold", f"{third}_rescue": "third_rescue_threshold"})
    )
    out = (
        rules.join(base, list(keys))
        .join(routed, [*keys, "a"], "left")
        .join(arbiter, [*keys, "a", "b"], "left")
        .join(by_abc.select(*keys, "a", "b", "c", "n0", "n1"), [*keys, "a", "b", "c"], "left")
        .na.fill(0, ["routed", "arbiter", "n0", "n1"])
    )
    out = out.withColumns(
        {
            "primary_threshold": F.lit(t1),
            "low_positive_routed_rows": F.col("routed"),
            "second_confirmed_rows": F.col("routed") - F.col("arbiter"),
            "arbiter_rows": F.col("arbiter"),
            "rescue_routed_rows": F.col("r0") + F.col("r1"),
            "total_changed_rows": F.col("n0") + F.col("n1") + F.col("r0") + F.col("r1"),
            "tn": F.col("tn0") + F.col("n0") - F.col("r0"),
            "fp": F.col("fp0") - F.col("n0") + F.col("r0"),
            "fn": F.col("fn0") + F.col("n1") - F.col("r1"),
            "tp": F.col("tp0") - F.col("n1") + F.col("r1"),
        }
    )
    out = _with_safety(out)
    return out.drop("routed", "arbiter", "n0", "n1", "r0", "r1", "tn0", "fp0", "fn0", "tp0")


def _with_safety(rules: DataFrame) -> DataFrame:
    """Adds rates, and ``safe`` against the baseline counts tn0, fp0, fn0, tp0."""
    names = ["accuracy", "precision", "recall_tpr", "fpr", "fnr", "f1", "f2"]
    rated = rates(rules, names=names)
    f0 = 2.0 * F.col("tp0") / F.greatest(2 * F.col("tp0") + F.col("fp0") + F.col("fn0"), F.lit(1))
    fpr0 = F.col("fp0") / F.greatest(F.col("fp0") + F.col("tn0"), F.lit(1))
    fnr0 = F.col("fn0") / F.greatest(F.col("fn0") + F.col("tp0"), F.lit(1))
    return rated.withColumn(
        "safe", (F.col("fpr") <= fpr0 + EPS) & (F.col("fnr") <= fnr0 + EPS) & (F.col("f1") > f0 + EPS)
    )


RULE_FIELDS = [
    "primary_threshold", "positive_filter_cutoff", "second_confirm_threshold", "third_confirm_threshold",
    "second_rescue_threshold", "third_rescue_threshold",
]


def select_rule(rules: DataFrame, keys: Sequence[str], disabled_fallback: bool = False) -> DataFrame:
    """Best safe rule per key: F1, then FPR, FNR, fewest changes, fewest arbitrated rows, first in the grid.

    Without a safe rule the key is absent, or with ``disabled_fallback`` gets a
    row with ``enabled`` false.
    """
    order = F.struct(
        -F.col("f1"), F.col("fpr"), F.col("fnr"), F.col("total_changed_rows"), F.col("arbiter_rows"),
        F.col("a"), F.col("b"), F.col("c"),
    )
    kept = [c for c in rules.columns if c not in keys]
    best = rules.where("safe").groupBy(*keys).agg(F.min_by(F.struct(*kept), order).alias("m"))
    best = best.select(*keys, "m.*", F.lit(True).alias("enabled"))
    if not disabled_fallback:
        return best
    every = rules.groupBy(*keys).agg(*[F.first(c).alias(f"__{c}") for c in RULE_FIELDS])
    out = every.join(best, list(keys), "left").withColumn("enabled", F.coalesce("enabled", F.lit(False)))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in RULE_FIELDS}).drop(
        *[f"__{c}" for c in RULE_FIELDS]
    )


def apply_rule(df: DataFrame, selected: DataFrame, keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Frozen cascade with each key's selected rule: adds baseline, prediction and route."""
    rule = selected.select(*keys, *RULE_FIELDS, "enabled")
    joined = df.join(bounded_broadcast(rule), list(keys), "left")
    got = three_score(*[F.col(s) for s in scores], Rule.from_columns())
    on = F.col("enabled")
    return joined.withColumns(
        {
            "baseline": got["baseline"],
            "prediction": F.when(on, got["prediction"]).otherwise(got["baseline"]),
            "route": F.when(on, got["route"]).otherwise("LSTM_DIRECT"),
        }
    ).drop(*RULE_FIELDS, "enabled")


def search_two_score(
    df: DataFrame, keys: Sequence[str], label: str, primary: str, second: str, t1: float, t2: float
) -> DataFrame:
    """Every rule of the two-score cascade, with counts, rates and ``safe``."""
    cands = _candidates(df, keys, label, primary, float(t1), {"seconds": (second, float(t2))})
    rows = df.select(*keys, label, primary, second).join(bounded_broadcast(cands), list(keys))
    p, s = F.col(primary), F.col(second)
    positive = p >= float(t1)
    rescued = ~positive & (s >= F.col(f"{second}_rescue"))
    first_cut = F.size("cutoffs") - F.size(F.filter("cutoffs", lambda c: p <= c + EPS))
    cells = cut_lineage(
        rows.groupBy(
            *keys, positive.alias("positive"), rescued.alias("rescued"),
            F.when(positive, first_cut).alias("a"), F.when(positive, _reached(s, F.col("seconds"))).alias("b"),
        ).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    )
    flag = lambda cond, n, out: F.sum(F.when(cond, F.col(n)).otherwise(0)).alias(out)
    base = cells.groupBy(*keys).agg(
        flag(~F.col("positive"), "n0", "tn0"), flag(F.col("positive"), "n0", "fp0"),
        flag(~F.col("positive"), "n1", "fn0"), flag(F.col("positive"), "n1", "tp0"),
        flag(F.col("rescued"), "n0", "r0"), flag(F.col("rescued"), "n1", "r1"),
    )
    sizes = cands.select(*keys, F.size("cutoffs").alias("na"), F.size("seconds").alias("nb"))
    grid = cells.where("positive").join(bounded_broadcast(sizes), list(keys))
    by_a = _spread(grid, keys, "a", F.col("na"), ["b", "na", "nb"])
    by_ab = _spread(by_a, keys, "b", F.col("nb"), ["a", "na"])
    routed = by_a.groupBy(*keys, "a").agg(F.sum(F.col("n0") + F.col("n1")).alias("routed"))
    rules = (
        cands.select("*", F.posexplode("cutoffs").alias("a", "positive_filter_cutoff"))
        .select("*", F.posexplode("seconds").alias("b", "second_confirm_threshold"))
        .drop("cutoffs", "seconds")
        .withColumnRenamed(f"{second}_rescue", "second_rescue_threshold")
    )
    out = (
        rules.join(base, list(keys))
        .join(routed, [*keys, "a"], "left")
        .join(by_ab.select(*keys, "a", "b", "n0", "n1"), [*keys, "a", "b"], "left")
        .na.fill(0, ["routed", "n0", "n1"])
        .withColumns(
            {
                "primary_threshold": F.lit(float(t1)),
                "filter_routed_rows": F.col("routed"),
                "rescue_routed_rows": F.col("r0") + F.col("r1"),
                "total_changed_rows": F.col("n0") + F.col("n1") + F.col("r0") + F.col("r1"),
                "tn": F.col("tn0") + F.col("n0") - F.col("r0"),
                "fp": F.col("fp0") - F.col("n0") + F.col("r0"),
                "fn": F.col("fn0") + F.col("n1") - F.col("r1"),
                "tp": F.col("tp0") - F.col("n1") + F.col("r1"),
            }
        )
    )
    return _with_safety(out).drop("routed", "n0", "n1", "r0", "r1", "tn0", "fp0", "fn0", "tp0")


def select_two_score_rule(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best safe two-score rule; ties prefer the higher confirmation threshold."""
    order = F.struct(
        -F.col("f1"), F.col("fpr"), F.col("fnr"), F.col("total_changed_rows"), -F.col("second_confirm_threshold"),
        F.col("a"), F.col("b"),
    )
    kept = [c for c in rules.columns if c not in keys]
    return rules.where("safe").groupBy(*keys).agg(F.min_by(F.struct(*kept), order).alias("m")).select(*keys, "m.*")


def apply_two_score_rule(
    df: DataFrame, selected: DataFrame, keys: Sequence[str], primary: str, second: str, threshold: float, out: str
) -> DataFrame:
    """Frozen two-score decision; keys without a selected rule keep the primary decision."""
    fields = ["positive_filter_cutoff", "second_confirm_threshold", "second_rescue_threshold"]
    rule = selected.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = df.join(bounded_broadcast(rule), list(keys), "left")
    got = two_score(
        F.col(primary), F.col(second), float(threshold), *[F.col(f"__{f}") for f in fields],
        enabled=F.col(f"__{fields[0]}").isNotNull(),
    )
    return joined.withColumn(out, got["prediction"]).drop(*[f"__{f}" for f in fields])


def ablation(df: DataFrame, keys: Sequence[str], label: str, predictions: Mapping[str, str]) -> DataFrame:
    """Metrics of several prediction columns side by side: keys, model, counts, rates."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("int").alias("predicted")) for m, c in predictions.items()])
    long = df.select(*keys, label, F.explode(pairs).alias("__p")).select(*keys, label, "__p.model", "__p.predicted")
    return rates(confusion(long, [*keys, "model"], label, "predicted"))


# Complexity of the architectures a tie prefers to keep low.
COMPLEXITY = {"LSTM": 1, "LSTM_RF": 2, "LSTM_LITEMV": 2, "LSTM_LITEMV_RF": 3}


def choose_architecture(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Model of the best F1, then FPR, FNR and least complexity."""
    names = list(COMPLEXITY)
    level = F.element_at(F.create_map(*[x for n in names for x in (F.lit(n), F.lit(COMPLEXITY[n]))]), F.col("model"))
    order = F.struct(-F.col("f1"), F.col("fpr"), F.col("fnr"), level, F.array_position(F.array(*[F.lit(n) for n in names]), F.col("model")))
    return table.where(F.col("model").isin(*names)).groupBy(*keys).agg(F.min_by("model", order).alias("model"))
