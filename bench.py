"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

Each query runs once to warm up and then BENCH_RUNS times (3 by default) into
the noop sink; the median counts.  Building a query is timed with it, as some
operators look at sizes or fit state while they are built.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftline.catalogue import registered
from siftline.session import session

HEADLINE = [
    "flagship", "W1", "W1_sliced", "W5", "W7", "W9", "A4", "A7", "A9", "A11", "A16", "C4", "H4", "H7", "J1", "J2", "J5", "L1", "G6", "X4",
    "W8", "S3",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = session(
        "siftline-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registered(), {}
    for name in names:
        taken = []
        for i in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
