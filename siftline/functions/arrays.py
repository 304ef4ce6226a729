"""Summaries of short, bounded arrays (a recent window of one case).

Array functions nest badly: a median inside a lambda is taken again for every
element.  Summaries are therefore built in stages, each a plain column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import EPS


def keep_finite(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def median_of_sorted(ascending: Column) -> Column:
    n = F.size(ascending)
    low = F.get(ascending, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ascending, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def median(values: Column) -> Column:
    return median_of_sorted(F.sort_array(values))


def gaps(sorted_micros: Column) -> Column:
    """Seconds between consecutive entries of an ascending array of epoch micros."""
    later = F.slice(sorted_micros, F.lit(2), F.greatest(F.size(sorted_micros) - 1, F.lit(0)))
    earlier = F.slice(sorted_micros, F.lit(1), F.greatest(F.size(sorted_micros) - 1, F.lit(0)))
    return F.zip_with(later, earlier, lambda b, a: (b - a) / 1e6)


def _distances(values: Column, center: Column, squared: bool = False) -> Column:
    return F.transform(values, lambda x: (x - center) * (x - center) if squared else F.abs(x - center))


def add_summaries(df: DataFrame, series: Mapping[str, tuple[Column, Column | None]]) -> DataFrame:
    """Adds one struct per series (values, current value): count, median, mean, std, variation, MAD, current vs recent.

    The struct is null without values.  Variation is the population std over the
    mean magnitude, 0 for fewer than two values or a mean magnitude near zero.
    """
    tag = lambda step, name: f"__{step}_{name}"
    df = df.withColumns({tag("v", n): F.sort_array(v) for n, (v, _) in series.items()} | {
        tag("c", n): c for n, (_, c) in series.items() if c is not None
    })
    stage = {}
    for n in series:
        v = F.col(tag("v", n))
        stage |= {tag("m", n): median_of_sorted(v), tag("a", n): mean(v), tag("s", n): mean(F.transform(v, F.abs))}
    df = df.withColumns(stage)
    stage = {}
    for n in series:
        v, m, a = F.col(tag("v", n)), F.col(tag("m", n)), F.col(tag("a", n))
        stage[tag("d", n)] = F.sqrt(mean(_distances(v, a, squared=True)))
        stage[tag("g", n)] = F.sort_array(_distances(v, m))
    df = df.withColumns(stage)
    out = {}
    for n, (_, current) in series.items():
        v, m, d, s = (F.col(tag(k, n)) for k in ("v", "m", "d", "s"))
        fields = [
            F.size(v).alias("count"),
            m.alias("median"),
            F.col(tag("a", n)).alias("mean"),
            d.alias("std"),
            F.when((F.size(v) < 2) | (s <= EPS), 0.0).otherwise(d / s).alias("coefficient_of_variation"),
            median_of_sorted(F.col(tag("g", n))).alias("median_absolute_deviation"),
        ]
        if current is not None:
            c = F.col(tag("c", n))
            fields += [
                c.alias("current"),
                F.when(F.abs(m) > EPS, c / m).alias("current_to_recent_median_ratio"),
                (F.abs(c - m) / F.greatest(F.abs(m), F.lit(EPS))).alias("current_fractional_deviation_from_recent_median"),
            ]
        out[n] = F.when(F.size(v) > 0, F.struct(*fields))
    return df.withColumns(out).drop(*[tag(k, n) for k in "vcmasdg" for n in series])
