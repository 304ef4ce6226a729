"""Sliding sequences per source and recent-flow context of single cases."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import arrays
from ..functions.decision import regularity_level, stability_level
from ..functions.numeric import EPS, finite, ratio_or_null
from ..functions.times import micros
from .columns import q
from .ordered import Ordered, bounded_broadcast


def sliding_sequences(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    row_id: str,
    features: Sequence[str],
    length: int,
    *,
    stride: int = 1,
    pad: str = "right",
    value: float | None = None,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Every ``stride``-th row with the ``length`` latest feature vectors up to itself.

    Short prefixes are padded on the right (sentinel) or on the left (zeros).
    Adds position, sequence_length and sequence (array of float arrays).
    """
    filler = (K.RIGHT_PAD_VALUE if pad == "right" else K.LEFT_PAD_VALUE) if value is None else value
    rows = df.withColumn("__x", F.array(*[q(f).cast("float") for f in features]))
    o = Ordered(rows, keys, [ts, row_id], halo=length - 1, rows_per_slice=rows_per_slice)
    o.add({"__seq": F.collect_list("__x").over(o.window(-(length - 1), 0))}).position("position")
    out = o.done().withColumn("position", F.col("position") - 1)
    out = out.where(F.col("position") % stride == 0).withColumn("sequence_length", F.size("__seq"))
    blank = F.array_repeat(F.array(*[F.lit(float(filler)).cast("float") for _ in features]), F.lit(length) - F.size("__seq"))
    sequence = F.concat("__seq", blank) if pad == "right" else F.concat(blank, "__seq")
    return out.withColumn("sequence", sequence).drop("__seq", "__x")


Scorer = Callable[[np.ndarray], np.ndarray]


def score_sequences(sequences: DataFrame, scorer: Scorer, keep: Sequence[str], out: str = "probability") -> DataFrame:
    """One score per sequence from a batch function (rows x length x features -> rows)."""
    kept = sequences.select(*keep, "sequence")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            result = pdf[list(keep)].copy()
            if len(pdf):
                block = np.stack([np.stack(s) for s in pdf["sequence"]]).astype(np.float32)
                result[out] = np.asarray(scorer(block), dtype=float)
            else:
                result[out] = pd.Series(dtype=float)
            yield result

    from pyspark.sql import types as T

    fields = [f for f in kept.schema.fields if f.name != "sequence"] + [T.StructField(out, T.DoubleType())]
    return kept.mapInPandas(run, T.StructType(fields))


def recent_windows(
    cases: DataFrame, rows: DataFrame, keys: Sequence[str], position: str, columns: Mapping[str, Column], length: int = K.RECENT_FLOWS
) -> DataFrame:
    """Cases (keys, position) with the ordered array ``window`` of the up to ``length`` rows ending there.

    A case asks for at most ``length`` positions, each a key of its own, so even
    a huge source spreads over the join; few cases are broadcast and the rows
    stay where they are.
    """
    wanted = cases.select(*keys, F.col(position).alias("__case")).withColumn(
        "__pos", F.explode(F.sequence(F.greatest(F.col("__case") - (length - 1), F.lit(0)), F.col("__case")))
    )
    found = rows.select(*keys, F.col(position).alias("__pos"), *[c.alias(n) for n, c in columns.items()])
    item = F.struct(F.col("__pos"), *[F.col(n) for n in columns])
    windows = (
        found.join(bounded_broadcast(wanted), [*keys, "__pos"])
        .groupBy(*keys, "__case")
        .agg(F.array_sort(F.collect_list(item)).alias("window"))
        .withColumnRenamed("__case", position)
    )
    return cases.join(windows, [*keys, position], "left")


def _values(window: Column, name: str) -> Column:
    return arrays.keep_finite(F.transform(window, lambda r: r[name].cast("double")))


def _gap_array(window: Column) -> Column:
    return arrays.gaps(F.array_sort(F.filter(F.transform(window, lambda r: r["__us"]), lambda t: t.isNotNull())))


def with_sequence_context(
    df: DataFrame, features: Sequence[str], decisions: Mapping[str, str], out: str = "sequence_context"
) -> DataFrame:
    """Adds a struct from ``window``: flow count, gap and feature summaries, share of positive decisions."""
    w = F.col("window")
    df = df.withColumn("__gaps", _gap_array(w))
    series = {"__sum_gap": (F.col("__gaps"), None), **{f"__sum_{f}": (_values(w, f), None) for f in features}}
    df = arrays.add_summaries(df, series)
    brief = lambda f: F.struct(F.col(f"__sum_{f}.median"), F.col(f"__sum_{f}.coefficient_of_variation"))
    share = lambda c: arrays.mean(F.transform(w, lambda r: r[c].cast("double")))
    gap = F.struct(
        F.col("__sum_gap.median"), F.coalesce("__sum_gap.coefficient_of_variation", F.lit(0.0)).alias("coefficient_of_variation")
    )
    context = F.struct(
        F.size(w).alias("flows_in_window"),
        gap.alias("inter_flow_gap_seconds"),
        F.struct(*[F.when(F.col(f"__sum_{f}").isNotNull(), brief(f)).alias(f) for f in features]).alias("recent_behavior_summary"),
        F.struct(*[share(c).alias(n) for n, c in decisions.items()]).alias("recent_model_behavior"),
    )
    return df.withColumn(out, context).drop("__gaps", *series)


def with_behavioral_context(
    df: DataFrame,
    duration: str | None,
    ratios: Mapping[str, tuple[str, str]],
    direct: Sequence[str],
    sizes: Sequence[str],
    out: str = "behavioral_context_o1",
) -> DataFrame:
    """Adds a struct from ``window``: beaconing timing, duration, direction and size stability of the recent flows.

    ``ratios`` maps a name to numerator and denominator columns; ``direct`` are
    direction metrics stored as columns; the current values are those of the case row.
    """
    w = F.col("window")
    last = F.element_at(w, -1)
    current = lambda c: finite(last[c])
    df = df.withColumn("__gaps", F.filter(_gap_array(w), lambda g: g >= 0))
    ratio_values = lambda a, b: arrays.keep_finite(F.transform(w, lambda r: ratio_or_null(r[a], r[b])))
    direction = {name: (ratio_values(a, b), ratio_or_null(last[a], last[b])) for name, (a, b) in ratios.items()}
    direction |= {name: (_values(w, name), current(name)) for name in direct}
    size = {name: (_values(w, name), current(name)) for name in sizes}
    length = {"duration": (_values(w, duration), current(duration))} if duration else {}
    groups = {"d": direction, "s": size, "l": length}
    series = {f"__{g}_{n}": v for g, group in groups.items() for n, v in group.items()}
    df = arrays.add_summaries(df, {"__gap": (F.col("__gaps"), None), **series})
    df = df.withColumns(
        {
            n: F.when(
                F.col(n).isNotNull(),
                F.col(n).withField("stability_level", stability_level(F.col(f"{n}.coefficient_of_variation"), F.col(f"{n}.count"))),
            )
            for n in series
        }
    )
    n, middle = F.size("__gaps"), F.col("__gap.median")
    newest = F.when(n > 0, F.element_at("__gaps", -1))
    df = df.withColumn("__level", regularity_level(F.col("__gap.coefficient_of_variation"), n))
    timing = F.struct(
        n.alias("usable_inter_flow_gaps"),
        *[F.col(f"__gap.{f}") for f in ("median", "mean", "std", "coefficient_of_variation", "median_absolute_deviation")],
        F.col("__level").alias("regularity_level"),
        newest.alias("most_recent_gap_seconds"),
        F.when(F.abs(middle) > EPS, newest / middle).alias("most_recent_gap_to_median_ratio"),
    )
    stable = lambda c: F.coalesce(F.col(f"{c}.stability_level") == "HIGH_STABILITY", F.lit(False))
    block = lambda g: F.struct(*[F.col(f"__{g}_{name}").alias(name) for name in groups[g]])
    names = lambda g: (
        F.array_compact(F.array(*[F.when(stable(f"__{g}_{name}"), name) for name in groups[g]]))
        if groups[g]
        else F.array().cast("array<string>")
    )
    fields = [F.size(w).alias("flows_in_window"), timing.alias("beaconing_timing")]
    if duration:
        fields.append(F.col("__l_duration").alias("flow_duration_behavior"))
    if direction:
        fields.append(block("d").alias("directionality_behavior"))
    if size:
        fields.append(block("s").alias("size_consistency_behavior"))
    facts = F.struct(
        (F.col("__level") == "HIGH_REGULARITY").alias("timing_is_highly_regular"),
        (stable("__l_duration") if duration else F.lit(False)).alias("flow_duration_is_highly_stable"),
        names("d").alias("highly_stable_directionality_metrics"),
        names("s").alias("highly_stable_size_metrics"),
    )
    return df.withColumn(out, F.struct(*fields, facts.alias("compact_behavioral_facts"))).drop(
        "__gaps", "__gap", "__level", *series
    )


def window_columns(ts: str, columns: Sequence[str]) -> dict[str, Column]:
    return {"__us": micros(F.col(ts)), **{c: q(c) for c in columns}}
