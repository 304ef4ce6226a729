"""Incremental extraction: new capture files are filtered, labelled and appended as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.columns import clean_name

#: Cells read of a line; more than any capture file has columns.
MOST_CELLS = 128


def _by_name(raw: DataFrame, schema: StructType) -> DataFrame:
    """Rows of raw cells with the columns of ``schema``, found by name in the header of each file."""
    names = [clean_name(f.name) for f in schema]
    bare = F.transform("cells", lambda c: F.trim(F.replace(c, F.lit("﻿"), F.lit(""))))
    lines = raw.withColumn("__header", F.size(F.array_intersect(bare, F.array(*[F.lit(n) for n in names]))) == len(names))
    headers = lines.where("__header").groupBy("file_path").agg(F.max(bare).alias("__names"))
    placed = lines.where("not __header").join(headers, "file_path", "left")
    missing = F.raise_error(F.concat(F.lit("no header with all columns in "), F.col("file_path"))).cast("string")
    ragged = F.raise_error(F.concat(F.lit("a line with more cells than its header in "), F.col("file_path"))).cast("string")
    surplus = F.exists(F.slice("cells", F.size("__names") + 1, MOST_CELLS), lambda c: c.isNotNull())

    def cell(name: str):
        at = F.array_position("__names", name).cast("int")
        return F.when(F.col("__names").isNull(), missing).when(surplus, ragged).otherwise(F.get("cells", at - 1))

    return placed.select(*[cell(n).cast(f.dataType).alias(f.name) for n, f in zip(names, schema)])


def append_new_files(
    spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], target: str, progress: str,
    files_per_batch: int = 1000,
) -> int:
    """Runs every file not yet seen through ``transform`` and appends the rows to ``target``, one folder per batch.

    Columns are taken by name from each file's own header, whatever their order;
    a file without them, or with lines longer than its header, fails the run.
    Files done are remembered below ``progress``, so a restarted run goes on
    where the last one stopped, and a batch that is run again replaces its own
    folder.  Returns the number of input rows of all batches.
    """
    cells = ", ".join(f"c{i} string" for i in range(MOST_CELLS))
    stream = (
        spark.readStream.schema(cells).option("header", False).option("maxFilesPerTrigger", files_per_batch).csv(source)
        .select(F.array(*[f"c{i}" for i in range(MOST_CELLS)]).alias("cells"), F.col("_metadata.file_path").alias("file_path"))
    )
    rows = 0

    def append(batch: DataFrame, number: int) -> None:
        nonlocal rows
        seen = Observation()
        counted = _by_name(batch, schema).observe(seen, F.count(F.lit(1)).alias("rows"))
        transform(counted).write.mode("overwrite").parquet(f"{target}/batch={number}")
        rows += seen.get["rows"]

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows
