"""The stream of endpoint histories against the batch operator."""

import os
import random

import pytest
from pyspark.sql import functions as F

from siftline.operators.temporal import history_features
from siftline.streaming.history import run_history

NAMES = {"source": "file", "src_ip": "src", "dst_ip": "dst", "ts": "ts", "row_id": "id", "features": ["x", "y"], "windows": (2, 3)}
SCHEMA = "id long, file string, src string, dst string, ts timestamp, x double, y double"


def flow_rows(n, seed=3):
    """Flows in order of time, with ties, missing values and a missing address."""
    rng, at, rows = random.Random(seed), 1_700_000_000, []
    for i in range(n):
        at += rng.choice([0, 1, 7, 60])
        rows.append((i, f"f{rng.randrange(2)}", rng.choice(["a", "b", None]), "z", at, rng.random(), rng.choice([None, float(i)])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("timestamp", "long")).withColumn("ts", F.timestamp_seconds("ts"))


@pytest.mark.parametrize("together", [1, 3])
def test_stream_gives_the_rows_of_the_batch_after_restarts(spark, tmp_path, together):
    rows = flow_rows(300)
    rng, arrived, folder = random.Random(1), rows.copy(), tmp_path / "in"
    for i in range(0, 290, 10):  # out of order within the delay
        part = arrived[i : i + 10]
        rng.shuffle(part)
        arrived[i : i + 10] = part
    end = (10_000, "f9", "q", "z", rows[-1][4] + 100_000, 0.0, None)  # moves the watermark past all others
    late = (10_001, "f0", "a", "z", rows[0][4] - 50_000, 0.0, 0.0)  # beyond the delay
    batches = [arrived[i : i + 75] for i in range(0, 300, 75)] + [[end], [late]]
    folder.mkdir()
    for i, batch in enumerate(batches):
        made = str(tmp_path / f"made{i}")
        frame(spark, batch).coalesce(1).write.parquet(made)
        name = next(f for f in os.listdir(made) if f.endswith(".parquet"))
        os.rename(f"{made}/{name}", folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_600_000_000 + 100 * i, 1_600_000_000 + 100 * i))
        if i % together == together - 1 or i == len(batches) - 1:  # each run starts from the progress of the one before
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
            run_history(spark, stream, str(tmp_path / "out"), str(tmp_path / "progress"), **NAMES, delay="1 hour")
    got = {r["id"]: r.asDict() for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["id"]: r.asDict() for r in history_features(frame(spark, rows), **NAMES).collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        for name in w:
            if name in ("x", "y", "src"):
                continue
            a, b = got[i][name], w[name]
            assert a == b or (isinstance(b, float) and a == pytest.approx(b, abs=1e-9)), (i, name, a, b)
