"""Exact duplicates by a heavy-hitter split.

Every text becomes one SHA-256 digest.  Misra-Gries summaries, one per task,
name the digests that may be frequent; their exact counts are taken with
map-side sums, and the verified ones (at most ``COUNTERS`` rows, whatever the
input) are broadcast, so copies of frequent texts are settled where they are
read.  A digest left over has at most ``2 / (COUNTERS + 1)`` of the rows, and
those rows, 40 bytes each, are grouped by an ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.tables import free_name, stored, whole

#: Size of a Misra-Gries summary, and so the most rows that are broadcast.
COUNTERS = 1023


def normalised(text: Column | str) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(whole(text), r"[\x20\x09-\x0D]+", " ")


def _reduce(counts: Counter, size: int) -> Counter:
    """A Misra-Gries summary of a sum of summaries: the (size + 1)th count is taken from all."""
    if len(counts) <= size:
        return counts
    cut = sorted(counts.values(), reverse=True)[size]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def _summaries(size: int):
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch["digest"])
            counts = _reduce(counts, size)
        yield pd.DataFrame({"digest": list(counts), "seen": list(counts.values())})

    return summarise


def frequent_digests(hashed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests with more than ``1 / (counters + 1)`` of all rows, their exact counts and smallest ids; at most ``counters`` rows.

    A summary misses at most ``1 / (counters + 1)`` of the rows it saw of a
    digest, and the sums of the summaries add up to no more than all rows, so
    every digest with twice that share is among the largest ``counters`` sums.
    """
    candidates = (
        hashed.select("digest").mapInPandas(_summaries(counters), "digest binary, seen long")
        .groupBy("digest").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "digest").limit(counters)
    )
    total = hashed.count()
    return (
        hashed.join(F.broadcast(candidates.select("digest")), "digest")
        .groupBy("digest").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id"))
        .where(F.col("group_size") * (counters + 1) > total)
    )


def _digests(df: DataFrame, id_col: str, text_col: str, counters: int) -> tuple[DataFrame, DataFrame]:
    """doc_id and digest of every row, and the frequent digests, to be broadcast."""
    hashed = stored(
        df.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest")), "digests"
    )
    return hashed, F.broadcast(stored(frequent_digests(hashed, counters), "frequent"))


def _usual(hashed: DataFrame, winners: DataFrame) -> DataFrame:
    """Decisions on the rows whose digest is not frequent."""
    group = Window.partitionBy("digest")
    return hashed.join(winners, "digest", "left_anti").select(
        "doc_id", "digest",
        F.min("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last())) == 1).alias("kept"),
    )


def _one_of(key: str, order: str, part: str) -> Column:
    """Marks one row of each ``key``: the first by ``order`` of each ``part``, then the first of those.

    ``part`` is the number of the partition that was read, so no window has more
    rows of a key than one partition holds, or than there are partitions.
    """
    here = F.row_number().over(Window.partitionBy(key, part).orderBy(order)) == 1
    slot = F.when(here, F.lit(-1)).otherwise(F.col(part))
    return here & (F.row_number().over(Window.partitionBy(key, slot).orderBy(order, part)) == 1)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty.  The row with the smallest id of equal texts
    stays (null ids come last); of rows that tie in it one stays.  An empty
    table gives no rows; other columns are not looked at.
    """
    hashed, winners = _digests(df, id_col, text_col, counters)
    heavy = hashed.join(winners, "digest").withColumn("_part", F.spark_partition_id())
    first = heavy.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    parts = (
        _usual(hashed, winners),
        first.withColumn("kept", _one_of("digest", "doc_id", "_part")),
        heavy.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False)),
    )
    columns = ("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    return parts[0].select(*columns).union(parts[1].select(*columns)).union(parts[2].select(*columns))


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row of each group of equal texts, as ``kept`` marks it, with all its columns, whatever their names.

    Null texts count as empty.  Of rows that repeat both id and text (but for
    white space), and of equal texts that have no id at all, the one with the
    smallest text stays.  Copies of frequent texts go where they are read.  An
    empty table gives no rows.
    """
    hashed, winners = _digests(df, id_col, text_col, counters)
    usual = _usual(hashed, winners)
    digest, best, nth, part, gone, gone_id = (free_name(df, f"_{x}") for x in ("digest", "best", "nth", "part", "gone", "gone_id"))
    known = F.broadcast(winners.select(F.col("digest").alias(digest), F.col("keep_id").alias(best)))
    rows = df.withColumn(digest, F.unhex(F.sha2(normalised(text_col), 256))).join(known, digest, "left")
    rows = rows.where(F.col(best).isNull() | (F.col(id_col) == F.col(best)))
    columns = [F.col(f"`{c}`") for c in df.columns]
    # The anti join uses the shuffle of the window again.
    dropped = usual.where("doc_id is not null and doc_id != keep_id").select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone))
    named = rows.where(F.col(id_col).isNotNull())
    named = named.withColumn(nth, F.row_number().over(Window.partitionBy(id_col, digest).orderBy(text_col))).where(F.col(nth) == 1)
    named = named.join(dropped.hint("merge"), (F.col(id_col) == F.col(gone_id)) & (F.col(digest) == F.col(gone)), "left_anti")
    # Equal texts without ids may be any number of rows, and go if one of the equal texts has an id.
    nameless = rows.where(F.col(id_col).isNull()).withColumn(part, F.spark_partition_id())
    nameless = nameless.withColumn(nth, _one_of(digest, text_col, part)).where(F.col(nth))
    owned = usual.where("doc_id is null and keep_id is not null").select(F.col("digest").alias(gone)).distinct()
    nameless = nameless.join(owned.hint("merge"), F.col(digest) == F.col(gone), "left_anti")
    return named.select(*columns).union(nameless.select(*columns))
