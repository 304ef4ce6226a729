"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go when the write that made them is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(
    app_name: str = "siftline", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """Session with adaptive execution, skew-join splitting and UTC timestamps.

    ``input_bytes`` sizes shuffles: partitions start at about 128 MB of input
    each and adaptive execution merges those that turn out small.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if input_bytes:
        settings["spark.sql.shuffle.partitions"] = str(max(200, input_bytes // (128 * 1024 * 1024)))
    settings |= conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own, since
    there the driver and the executors are one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="siftline-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)  # this process's own folder
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/siftline/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Reliable checkpoint of ``df`` in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, into: DataFrame | None = None, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder once and reads it back, so that later steps do not run it again.

    The shuffle files of the run go with its end, not when the driver happens to
    collect its garbage.  With ``into``, a table given before, the rows are
    added to that one.  ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name) if into is None else into._stored_at
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).mode("errorifexists" if into is None else "append").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that ``stored`` gave and that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
