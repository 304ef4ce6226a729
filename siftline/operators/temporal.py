"""Causal history of an endpoint, positions inside a source and chronological splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import times
from ..functions.numeric import variation
from .columns import q
from .ordered import Ordered, scalars


def choose_timestamp(df: DataFrame, column: str, out: str = "parsed", max_bad: float = 0.001) -> DataFrame:
    """Parses ``column`` month-first or day-first, whichever reads more rows (ties: month-first)."""
    readings = {
        "month_first": times.parse_mixed(q(column), strict=True),
        "day_first": times.parse_mixed(q(column), day_first=True, strict=True),
    }
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(k) for k, c in readings.items()])
    chosen = counts.select(
        (F.col("day_first") > F.col("month_first")).alias("__day"),
        (1 - F.greatest("month_first", "day_first") / F.greatest(F.col("n"), F.lit(1)) > max_bad).alias("__bad"),
    )
    choice = scalars(chosen)
    parsed = F.when(choice["__day"], readings["day_first"]).otherwise(readings["month_first"])
    failure = F.raise_error(F.lit(f"too many unreadable values in {column}")).cast("timestamp")
    return df.withColumn(out, F.when(choice["__bad"], failure).otherwise(parsed))


def endpoint(ip: Column) -> Column:
    """Address as text; a missing one is the text nan, an endpoint of its own."""
    return F.coalesce(ip.cast("string"), F.lit("nan"))


def history_features(
    df: DataFrame,
    *,
    source: str,
    src_ip: str,
    dst_ip: str,
    ts: str,
    row_id: str,
    features: Sequence[str],
    windows: Sequence[int] = (5,),
    within: Sequence[str] = (),
    count: str = "Endpoint History Count",
    delta: str = "InterFlow Delta",
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Earlier flows of the same endpoint: count, seconds since the last, and mean/std over the previous k.

    The current row is never part of its own history.  ``within`` restarts the
    history inside further columns, such as a split.  All expressions share one
    window order, hence one shuffle.
    """
    keyed = df.withColumns({"__src": endpoint(q(src_ip)), "__dst": endpoint(q(dst_ip)), "__us": times.micros(q(ts))})
    o = Ordered(
        keyed, [*within, source, "__src", "__dst"], ["__us", row_id], halo=max(windows) + 1, rows_per_slice=rows_per_slice
    )
    gap = (F.col("__us") - F.lag("__us").over(o.window())) / F.lit(1e6)
    o.add({delta: F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0)))})
    added = {}
    for k in windows:
        frame = o.window(-k, -1)
        for f in features:
            added[f"{f} Prev{k} Mean"] = F.avg(q(f)).over(frame)
            added[f"{f} Prev{k} Std"] = F.stddev_pop(q(f)).over(frame)
        added[f"{delta} Prev{k} Mean"] = F.avg(q(delta)).over(frame)
        added[f"{delta} Prev{k} Std"] = F.stddev_pop(q(delta)).over(frame)
    o.add(added)
    o.add({f"{delta} Prev{k} CV": variation(q(f"{delta} Prev{k} Std"), q(f"{delta} Prev{k} Mean")) for k in windows})
    o.position(count)
    return o.done().withColumn(count, q(count) - 1).drop("__src", "__dst", "__us")


def source_positions(
    df: DataFrame, keys: Sequence[str], ts: str, row_id: str, out: str = "position", rows_per_slice: int | None = None
) -> DataFrame:
    """0-based place of each row among the rows of its keys by time."""
    o = Ordered(df, keys, [ts, row_id], rows_per_slice=rows_per_slice).position(out)
    return o.done().withColumn(out, F.col(out) - 1)


def occurrence_number(
    df: DataFrame, keys: Sequence[str], row_id: str, out: str = "occurrence", rows_per_slice: int | None = None
) -> DataFrame:
    """0-based count of earlier rows with equal keys."""
    o = Ordered(df, keys, [row_id], rows_per_slice=rows_per_slice).position(out)
    return o.done().withColumn(out, F.col(out) - 1)


def row_ids(df: DataFrame, order: Sequence[str], out: str = "row_id", rows_per_slice: int | None = None) -> DataFrame:
    """Deterministic 0-based row number over the whole table."""
    o = Ordered(df, [], order, rows_per_slice=rows_per_slice).position(out)
    return o.done().withColumn(out, F.col(out) - 1)


def _bounds(n: Column, rule: str) -> tuple[Column, Column]:
    train, validation = K.SPLIT_RATIOS["train"], K.SPLIT_RATIOS["validation"]
    if rule == "cut":
        train_end = F.least(F.greatest(F.floor(n * train), F.lit(1)), n - 2)
        return train_end, F.least(F.greatest(F.floor(n * (train + validation)), train_end + 1), n - 1)
    n_train = F.greatest(F.lit(1), F.floor(n * train))
    n_validation = F.greatest(F.lit(1), F.floor(n * validation))
    shortage = F.greatest(F.lit(0), n_train + n_validation + 1 - n)
    from_train = F.least(shortage, n_train - 1)
    n_validation = n_validation - F.least(shortage - from_train, n_validation - 1)
    train_end = F.when(n <= 2, 1).otherwise(n_train - from_train)
    return train_end, F.when(n <= 2, 1).otherwise(n_train - from_train + n_validation)


def chronological_split(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    row_id: str,
    rule: str = "allocate",
    out: str = "split",
    rows_per_slice: int | None = None,
) -> DataFrame:
    """70/15/15 by time inside every key, each part holding at least one row.

    ``cut`` places the borders at floors of the cumulative ratios (used for one
    oversized source); ``allocate`` gives every part the floor of its own ratio
    and handles sources of one or two rows.
    """
    o = Ordered(df, keys, [ts, row_id], rows_per_slice=rows_per_slice)
    o.position("__pos").totals({"__n": F.lit(1).cast("long")})
    train_end, validation_end = _bounds(F.col("__n"), rule)
    name = F.when(F.col("__pos") <= train_end, "train").when(F.col("__pos") <= validation_end, "validation").otherwise("test")
    return o.done().withColumn(out, name).drop("__pos", "__n")
