"""Equi-joins between score, row and manifest tables, and lookups in a reference distribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.decision import decide, strength, support_margin, weakest
from ..functions.numeric import finite
from ..functions.text import normalize_source
from ..functions.times import micros
from .ordered import Ordered, bounded_broadcast
from .temporal import occurrence_number


def align_scores(frames: Mapping[str, DataFrame], keys: Sequence[str], label: str) -> DataFrame:
    """One row per key with every model's score; each frame holds keys, label and one score column.

    A key that a frame lacks fails the query, see ``alignment_violations``.
    """
    sides = [
        (df if i == 0 else df.drop(label)).withColumn(f"__in{i}", F.lit(True)) for i, df in enumerate(frames.values())
    ]
    joined = reduce(lambda a, b: a.join(b, list(keys), "full"), sides)
    complete = reduce(lambda a, b: a & b, [F.col(f"__in{i}").isNotNull() for i in range(len(sides))])
    missing = F.raise_error(F.concat(F.lit("no score of some model for "), F.to_json(F.struct(*keys))))
    kind = joined.schema[label].dataType
    checked = joined.withColumn(label, F.when(complete, F.col(label)).otherwise(missing.cast(kind)))
    return checked.drop(*[f"__in{i}" for i in range(len(sides))])


def alignment_violations(frames: Mapping[str, DataFrame], keys: Sequence[str], label: str) -> DataFrame:
    """Keys missing or repeated in a frame, or with labels that disagree."""
    tagged = reduce(
        lambda a, b: a.unionByName(b),
        [df.select(*keys, label, F.lit(i).alias("__m")) for i, df in enumerate(frames.values())],
    )
    counts = [F.count_if(F.col("__m") == i).alias(f"n_{name}") for i, name in enumerate(frames)]
    per = tagged.groupBy(*keys).agg(*counts, (F.min(label) != F.max(label)).alias("labels_differ"))
    off = reduce(lambda a, b: a | b, [F.col(f"n_{n}") != 1 for n in frames])
    return per.where(off | F.col("labels_differ"))


def match_occurrences(
    predictions: DataFrame,
    rows: DataFrame,
    *,
    source: str,
    ts: str,
    label: str,
    prediction_order: str,
    row_id: str,
    flow_id: str | None = None,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Predictions with the id of the row they belong to.

    Rows equal in source, time, label (and flow id) are told apart by their
    occurrence number, so the join key is unique even for long runs of copies.
    """
    keys = ["__source", "__time", "__label"] + (["__flow"] if flow_id else [])

    def keyed(df, order):
        cols = {"__source": normalize_source(F.col(source)), "__time": micros(F.col(ts)), "__label": F.col(label).cast("string")}
        if flow_id:
            cols["__flow"] = F.trim(F.col(flow_id).cast("string"))
        return occurrence_number(df.withColumns(cols), keys, order, "__nth", rows_per_slice)

    right = keyed(rows, row_id).select(*keys, "__nth", row_id)
    return keyed(predictions, prediction_order).join(right, [*keys, "__nth"], "left").drop(*keys, "__nth")


def attach(scores: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join of row columns to scores, one to one."""
    return scores.join(rows.select(*keys, *columns), list(keys), "left")


def apply_manifest(rows: DataFrame, manifest: DataFrame, row_id: str, split: str) -> DataFrame:
    """Rows with their split; a row that the manifest lacks fails the query."""
    missing = F.raise_error(F.concat(F.lit("the manifest has no split for row "), F.col(row_id).cast("string"))).cast("string")
    joined = rows.join(manifest.select(row_id, F.col(split).alias("__split")), row_id, "left")
    return joined.withColumn(split, F.coalesce("__split", missing)).drop("__split")


def map_sources(rows: DataFrame, assignment: DataFrame, source: str, columns: Sequence[str]) -> DataFrame:
    """Left join of a per-source table; broadcast after a look at its size, else split on skew."""
    return rows.join(bounded_broadcast(assignment.select(source, *columns)), source, "left")


def restrict(ledger: DataFrame, population: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ledger.join(population.select(*keys), list(keys), "left_semi")


def override(base: DataFrame, changes: DataFrame, keys: Sequence[str], value: str, new: str, out: str) -> DataFrame:
    """``out`` is the changed value where there is one, else the base value."""
    renamed = changes.select(*keys, F.col(new).alias("__new"))
    return base.join(renamed, list(keys), "left").withColumn(out, F.coalesce("__new", value)).drop("__new")


def unfinished(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in an existing output."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys in both, only left or only right."""
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    side = tagged.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    kind = F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left_only").otherwise("right_only")
    return side.select(key, kind.alias("side"))


def jaccard(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    sides = set_difference(left, right, key)
    both = F.count_if(F.col("side") == "both")
    n = F.count(F.lit(1))
    return sides.agg(both.alias("n_both"), n.alias("n_union"), F.when(n > 0, both / n).otherwise(0.0).alias("jaccard"))


def error_overlap(base: DataFrame, errors: Mapping[str, DataFrame], row_id: str, kind: str) -> DataFrame:
    """Base rows with each model's error type, the number of wrong models and their names joined by '|'."""
    out = base
    for m, df in errors.items():
        out = out.join(df.select(row_id, F.col(kind).alias(f"{m}_{kind}")), row_id, "left")
    wrong = {m: F.col(f"{m}_{kind}").isin("FP", "FN") for m in errors}
    names = F.concat_ws("|", *[F.when(w, m) for m, w in wrong.items()])
    count = reduce(lambda a, b: a + b, [F.coalesce(w, F.lit(False)).cast("int") for w in wrong.values()])
    return out.withColumns({"models_wrong": count, "wrong_models": F.when(names == "", "none").otherwise(names)})


def percentile_table(
    reference: DataFrame, target: DataFrame, keys: Sequence[str], value: str, out: str, rows_per_slice: int | None = None
) -> DataFrame:
    """For every distinct target value of a key the share of reference values at most that; 0.5 without reference.

    Both sides shrink to distinct values before the running count, so ties cost nothing.
    """
    counted = (
        reference.where(finite(F.col(value)).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("__r"))
        .unionByName(target.select(*keys, value).distinct().withColumn("__r", F.lit(0).cast("long")))
        .groupBy(*keys, value)
        .agg(F.sum("__r").alias("__r"))
    )
    o = Ordered(counted, keys, [value], rows_per_slice=rows_per_slice, aggregated=True)
    o.running({"__cum": F.col("__r")}).totals({"__all": F.col("__r")})
    share = F.when(F.col("__all") > 0, F.col("__cum") / F.col("__all")).otherwise(0.5)
    return o.done().select(*keys, value, share.alias(out))


def support_percentiles(
    reference: DataFrame, target: DataFrame, keys: Sequence[str], value: str, out: str, rows_per_slice: int | None = None
) -> DataFrame:
    """Target rows with the share of reference values at most their own, per key."""
    table = percentile_table(reference, target, keys, value, out, rows_per_slice)
    return target.join(table, [*keys, value], "left")


def add_strengths(
    df: DataFrame, reference: DataFrame, models: Mapping[str, tuple[str, float]], rows_per_slice: int | None = None
) -> DataFrame:
    """Per model its decision, percentile among the reference margins of the same decision, and strength."""
    cols = {}
    for m, (score, threshold) in models.items():
        cols[f"{m}_pred"] = decide(F.col(score), threshold)
        cols[f"{m}_margin"] = support_margin(F.col(score), threshold)
    judged, known = df.withColumns(cols), reference.select(*[c.alias(n) for n, c in cols.items()])
    out = judged
    for m in models:
        at = [f"{m}_pred", f"{m}_margin"]
        out = out.join(percentile_table(known, judged, at[:1], at[1], f"{m}_percentile", rows_per_slice), at, "left")
    out = out.withColumns({f"{m}_strength": strength(F.col(f"{m}_percentile")) for m in models})
    return out.withColumn("weakest_percentile", weakest(*[F.col(f"{m}_percentile") for m in models]))
