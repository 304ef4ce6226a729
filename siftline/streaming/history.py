"""Causal history of endpoints on a stream: the rows of ``history_features``, given out as the watermark passes them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import times
from ..functions.numeric import variation
from ..operators.columns import q
from ..operators.temporal import endpoint

#: State store with lists and timers per key, which spills to disk and keeps change logs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def previous(values: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation of the k rows before each row from ``first`` on; NaN is missing."""
    padded = np.vstack([np.full((k, values.shape[1]), np.nan), values])
    frames = np.lib.stride_tricks.sliding_window_view(padded, k, axis=0)[first : len(values)]  # row, column, place in the frame
    n = (~np.isnan(frames)).sum(axis=2)
    safe = np.where(n > 0, n, 1)
    mean = np.where(n > 0, np.nansum(frames, axis=2) / safe, np.nan)
    spread = np.nansum((frames - mean[:, :, None]) ** 2, axis=2) / safe
    return mean, np.where(n > 0, np.sqrt(spread), np.nan)


class EndpointHistory(StatefulProcessor):
    """Per endpoint: flows still in front of the watermark, the last few behind it, and how many there were.

    A flow is given out once the watermark has passed it, since an earlier one
    may arrive until then; so the order of arrival within the delay does not
    matter.  State per endpoint is the flows of one delay and the longest
    window.
    """

    def __init__(self, windows: Sequence[int], features: int):
        self.windows, self.features = list(windows), features

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, row long, v array<double>")
        self.recent = handle.getListState("recent", "us long, v array<double>")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            self.waiting.appendList([(int(u), int(r), [float(x) for x in v]) for u, r, v in zip(batch["us"], batch["row"], batch["v"])])
            least = int(batch["us"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(max(0, first // 1000 + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get())
        ready = sorted(((r[0], r[1], r[2]) for r in waiting if r[0] <= passed), key=lambda r: r[:2])
        if not ready:
            return
        before = [(r[0], r[1]) for r in self.recent.get()] if self.recent.exists() else []
        seen = self.seen.get()[0] if self.seen.exists() else 0
        us = np.array([b[0] for b in before] + [r[0] for r in ready], np.int64)
        values = np.full((len(us), self.features + 1), np.nan)
        for i, v in enumerate([b[1] for b in before] + [r[2] for r in ready]):
            values[i, : len(v)] = v
        m = len(before)
        gaps = np.maximum(np.diff(us) / 1e6, 0.0)
        values[max(m, 1) :, -1] = gaps[max(m, 1) - 1 :]
        out = {"row": [r[1] for r in ready], "us": us[m:], "n": seen + np.arange(len(ready)), "gap": values[m:, -1]}
        for k in self.windows:
            mean, spread = previous(values, k, m)
            out[f"mean{k}"], out[f"std{k}"] = list(mean), list(spread)
        self.recent.put([(int(u), v.tolist()) for u, v in zip(us, values)][-max(self.windows) :])
        self.seen.update((seen + len(ready),))
        left = [(r[0], r[1], list(r[2])) for r in waiting if r[0] > passed]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(min(r[0] for r in left) // 1000 + 1)
        frame = pd.DataFrame(out)
        for i, name in enumerate(("k0", "k1", "k2")):
            frame[name] = key[i]
        yield frame

    def close(self) -> None:
        pass


def history_stream(
    flows: DataFrame, *, source: str, src_ip: str, dst_ip: str, ts: str, row_id: str, features: Sequence[str],
    windows: Sequence[int] = (5,), delay: str = "10 minutes", count: str = "Endpoint History Count", delta: str = "InterFlow Delta",
) -> DataFrame:
    """Source, endpoints, row id, time and the columns of ``history_features`` for every flow of a stream.

    A flow that comes later than ``delay`` behind the newest one seen is
    dropped and counted in the query's progress (``numRowsDroppedByWatermark``).
    Flows within the last ``delay`` of the stream wait for its going on.
    """
    names, width = list(features), len(features)
    keyed = flows.withColumn("__ts", q(ts).cast("timestamp")).withWatermark("__ts", delay).select(
        q(source).cast("string").alias("k0"), endpoint(q(src_ip)).alias("k1"), endpoint(q(dst_ip)).alias("k2"), "__ts",
        times.micros(F.col("__ts")).alias("us"), q(row_id).cast("long").alias("row"),
        F.transform(F.array(*[q(f).cast("double") for f in names]), lambda x: F.coalesce(x, F.lit(float("nan")))).alias("v"),
    )
    arrays = ", ".join(f"mean{k} array<double>, std{k} array<double>" for k in windows)
    out = keyed.groupBy("k0", "k1", "k2").transformWithStateInPandas(
        statefulProcessor=EndpointHistory(windows, width),
        outputStructType=f"row long, us long, n long, gap double, {arrays}, k0 string, k1 string, k2 string",
        outputMode="Append", timeMode="EventTime",
    )
    known = lambda c: F.when(~F.isnan(c), c)
    columns = [
        F.col("k0").alias(source), F.col("k1").alias(src_ip), F.col("k2").alias(dst_ip), F.col("row").alias(row_id),
        F.timestamp_micros("us").alias(ts), F.col("n").alias(count), known(F.col("gap")).alias(delta),
    ]
    for k in windows:
        for i, f in enumerate([*names, delta]):
            columns += [known(F.col(f"{s}{k}")[i]).alias(f"{f} Prev{k} {n}") for s, n in (("mean", "Mean"), ("std", "Std"))]
    shown = out.select(*columns)
    return shown.withColumns({f"{delta} Prev{k} CV": variation(q(f"{delta} Prev{k} Std"), q(f"{delta} Prev{k} Mean")) for k in windows})


def run_history(spark: SparkSession, flows: DataFrame, target: str, progress: str, **arguments) -> None:
    """Runs the stream over what is there now and appends to ``target``; a later call with the same ``progress`` goes on."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        query = (
            history_stream(flows, **arguments).writeStream.format("parquet").option("path", target)
            .option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
