"""Output of long runs in committed parts, so that a restarted run does only what is missing.

Below one folder lie ``data/part=<name>``, a Bloom filter of the keys of each
part in ``filters/part=<name>``, and ``log/part=<name>``, written last: a part
without a log entry does not exist.  A restart looks its keys up in the filters,
reads the keys of only those parts that may hold some, and compares these
exactly, so a filter can cost a read but never a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import bounded_broadcast
from ..session import cut_lineage

#: Bits of one block of a filter, as ``bitmap_construct_agg`` makes them.
BLOCK_BITS = 32_768
BITS_PER_KEY = 16
#: Bits set for a key, all in one block: about one key in a thousand passes wrongly.
PROBES = 8
LOG = "part string, rows long, level int"


def _block(keys: Sequence[str], level: Column) -> Column:
    """One of 2**level blocks."""
    return F.pmod(F.xxhash64(F.lit(0), *keys), F.pow(F.lit(2), level).cast("long"))


def _bits(keys: Sequence[str]) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(BLOCK_BITS)) for i in range(1, PROBES + 1)]


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there)


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema(LOG).parquet(f"{path}/log") if _exists(spark, f"{path}/log") else None


def commit(df: DataFrame, path: str, name: str, keys: Sequence[str]) -> int:
    """Writes ``df`` as part ``name`` of the output at ``path`` and returns its rows.

    A part written again replaces itself, also one that a stopped run left
    unfinished.  Names are words of letters, digits, ``-`` and ``_``.
    """
    if not name or not all(c.isalnum() or c in "-_" for c in name) or name.isdigit():
        raise ValueError(f"not a part name: {name!r}")
    spark, place = df.sparkSession, f"part={name}"
    if _exists(spark, f"{path}/log/{place}"):
        # an entry is withdrawn before its part changes
        spark.createDataFrame([], "rows long, level int").write.mode("overwrite").parquet(f"{path}/log/{place}")
    df.write.mode("overwrite").parquet(f"{path}/data/{place}")
    written = spark.read.schema(df.schema).parquet(f"{path}/data/{place}").select(*keys)
    rows = written.count()
    level = max(0, (rows * BITS_PER_KEY // BLOCK_BITS).bit_length())
    spots = written.select(_block(keys, F.lit(level)).alias("block"), F.explode(F.array(*_bits(keys))).alias("bit"))
    blocks = spots.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    blocks.write.mode("overwrite").parquet(f"{path}/filters/{place}")
    entry = spark.createDataFrame([(rows, level)], "rows long, level int").coalesce(1)
    entry.write.mode("overwrite").parquet(f"{path}/log/{place}")
    return rows


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of all parts in the log, with column ``part``; nothing if no part was ever committed."""
    log = _log(spark, path)
    if log is None:
        return None
    return spark.read.parquet(f"{path}/data").join(bounded_broadcast(log.select("part")), "part", "left_semi")


def candidates(work: DataFrame, path: str, keys: Sequence[str]) -> DataFrame | None:
    """Distinct keys of ``work`` with each ``part`` whose filter they pass; nothing without a log.

    A key has one block for each filter size, found by equi-join, and is tested
    there; a part is one run, so few parts share a size.
    """
    spark = work.sparkSession
    log = _log(spark, path)
    if log is None:
        return None
    shape = "block long, bits binary, part string"
    filters = spark.read.schema(shape).parquet(f"{path}/filters").join(bounded_broadcast(log.select("part", "level")), "part")
    sizes = log.agg(F.collect_set("level")).scalar()
    asked = work.select(*keys).distinct().withColumn("__level", F.explode(sizes))
    asked = asked.withColumn("__block", _block(keys, F.col("__level")))

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1

    passes = reduce(lambda a, b: a & b, [is_set(bit) for bit in _bits(keys)])
    met = asked.join(filters, (F.col("__level") == F.col("level")) & (F.col("__block") == F.col("block")))
    return met.where(passes).select(*keys, "part")


def unfinished(work: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Rows of ``work`` whose keys are in no committed part; rows with a null key always count as unfinished.

    Only the key columns of parts that may hold a key of ``work`` are read.
    """
    found = candidates(work, path, keys)
    if found is None:
        return work
    found = cut_lineage(found)
    hit = bounded_broadcast(found.select("part").distinct())
    data = work.sparkSession.read.parquet(f"{path}/data").select("part", *keys)
    done = data.join(hit, "part", "left_semi").join(found, ["part", *keys], "left_semi").select(*keys)
    # kept apart from the output, whose folders the caller may replace with what this returns
    return work.join(cut_lineage(done), list(keys), "left_anti")
