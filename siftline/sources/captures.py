"""Flow-record files in, canonical tables and result files out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import times
from ..operators.columns import canonical_names, clean_name, q
from ..operators.filters import touches_endpoint
from ..operators.quality import require_empty

CSV_TIMESTAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _raw_schema(width: int) -> T.StructType:
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(width)]
    return T.StructType(fields + [T.StructField("_corrupt_record", T.StringType())])


def _cells(width: int) -> Column:
    bare = lambda c: F.trim(F.replace(c, F.lit("﻿"), F.lit("")))
    return F.array(*[bare(F.col(f"c{i}")) for i in range(width)])


def read_raw(spark: SparkSession, path, width: int) -> DataFrame:
    """All lines of all files below ``path`` as text cells, with file name and path.

    Headers stay in as rows, so one lazy read covers any number of files.
    """
    rows = spark.read.schema(_raw_schema(width)).option("header", False).option("mode", "PERMISSIVE").csv(path)
    # Lines keep their order inside a split of a file, and splits are ordered by where they begin.
    position = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return rows.select(
        "*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"), position.alias("position")
    )


def _is_header(columns: Sequence[str], marker: str) -> Column:
    return F.array_contains(_cells(len(columns)), marker)


def header_violations(raw: DataFrame, columns: Sequence[str], marker: str = K.TIMESTAMP) -> DataFrame:
    """Files whose header is missing, repeated, or not exactly the ordered ``columns``, and files with ragged lines."""
    expected = F.array(*[F.lit(clean_name(c)) for c in columns])
    header = F.coalesce(_is_header(columns, marker), F.lit(False))
    wrong = header & ((_cells(len(columns)) != expected) | F.col("_corrupt_record").isNotNull())
    ragged = ~header & F.col("_corrupt_record").isNotNull()
    per = raw.groupBy("file_path").agg(
        F.count_if(header).alias("headers"), F.count_if(wrong).alias("wrong"), F.count_if(ragged).alias("ragged")
    )
    return per.where((F.col("headers") != 1) | (F.col("wrong") > 0) | (F.col("ragged") > 0))


def read_captures(
    spark: SparkSession, path, label: int, class_name: str, columns: Sequence[str] = K.FLOW_COLUMNS,
    label_column: str = K.LABEL, timestamp: str = K.TIMESTAMP, check: bool = True, position: str | None = None,
) -> DataFrame:
    """Flow records of one class: exact header, parsed time, label and ``class/file`` source stamped.

    Features stay text until cleaning; nothing is inferred from the data.  A line
    with more or fewer cells than the header is refused.  ``position`` names a
    column for the place of the row in its file, which orders rows of equal time
    as the file does.
    """
    raw = read_raw(spark, path, len(columns))
    if check:
        require_empty(header_violations(raw, columns, timestamp), "files without the exact header or with ragged lines")
        if not raw.take(1):
            raise ValueError(f"no rows below {path}")
    data = raw.where(~F.coalesce(_is_header(columns, timestamp), F.lit(False)))
    out = []
    for i, c in enumerate(columns):
        name = clean_name(c)
        if name == label_column:
            continue
        out.append((times.parse_mixed(F.col(f"c{i}")) if name == timestamp else F.col(f"c{i}")).alias(name))
        if name == timestamp:
            out.append(F.concat(F.lit(class_name + "/"), F.col("file_name")).alias(K.SOURCE))
    if position:
        out.append(F.col("position").alias(position))
    return data.select(*out, F.lit(int(label)).alias(label_column))


def read_dataset(spark: SparkSession, name: str, benign, malicious, **options) -> DataFrame:
    """Benign and malicious captures of one dataset, with column ``dataset``."""
    parts = [read_captures(spark, benign, 0, "benign", **options), read_captures(spark, malicious, 1, "malicious", **options)]
    return parts[0].unionByName(parts[1]).withColumn("dataset", F.lit(name))


def write_canonical(df: DataFrame, path: str, partition: str = "dataset") -> None:
    """Parquet, one folder per dataset."""
    df.write.partitionBy(partition).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header and a fixed timestamp format."""
    df.write.option("header", True).option("timestampFormat", CSV_TIMESTAMP).option("timestampNTZFormat", CSV_TIMESTAMP).csv(path)


def write_json_lines(df: DataFrame, payload: str, path: str) -> None:
    """One JSON text per row."""
    df.select(F.to_json(payload).alias("value")).write.text(path)


def write_ledger(df: DataFrame, path: str, keys: Sequence[str] = ("dataset", "model")) -> None:
    df.write.partitionBy(*keys).parquet(path)


# -- endpoint configuration and alignment ---------------------------------------------


def read_endpoints(spark: SparkSession, path) -> DataFrame:
    """Endpoint list (capture, ip, port) from JSON records of pcap_file, c2_ip, c2_port."""
    rows = spark.read.schema("pcap_file string, c2_ip string, c2_port int").option("multiLine", True).json(path)
    return rows.select(F.trim("pcap_file").alias("capture"), F.trim("c2_ip").alias("ip"), F.col("c2_port").alias("port")).dropDuplicates()


def stem(file_name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name, r"(?<=.)\.[^.]+$", "")


def endpoints_for(captures: DataFrame, endpoints: DataFrame, exact_only_if_found: bool = False) -> DataFrame:
    """Endpoints of each capture by equal name or equal stem; optionally an equal name rules out stems."""
    base = captures.select("capture", stem(F.col("capture")).alias("__s")).dropDuplicates()
    named = endpoints.select(F.col("capture").alias("__c"), stem(F.col("capture")).alias("__s"), "ip", "port")
    hits = base.join(named, "__s").withColumn("exact", F.col("capture") == F.col("__c"))
    if exact_only_if_found:
        found = hits.where("exact").select("capture").distinct().withColumn("__f", F.lit(True))
        hits = hits.join(found, "capture", "left").where(F.col("exact") | F.col("__f").isNull())
    return hits.select("capture", "ip", "port").dropDuplicates()


def capture_of_path(path: Column, suffix: str = "_configured_c2") -> Column:
    """Capture base name: the folder two levels above the file, without its job suffix."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1)
    return F.regexp_replace(folder, suffix + "$", "")


def align_and_label(
    df: DataFrame, reference: Sequence[str], label_value: str, condition: Column | None = None, label_column: str = K.LABEL
) -> DataFrame:
    """Canonical names, optional row filter, fixed label and reference column order, all in one lazy plan."""
    named = canonical_names(df)
    if condition is not None:
        named = named.where(condition)
    named = named.withColumn(label_column, F.lit(label_value))
    missing = [c for c in reference if c not in named.columns]
    if missing:
        raise ValueError(f"columns missing from the shared schema: {missing}")
    return named.select(*[q(c) for c in reference])


def align_configured(df: DataFrame, endpoints: DataFrame, reference: Sequence[str], label_value: str, capture: str = "capture") -> DataFrame:
    """Rows of configured endpoints, aligned and labelled, with their capture kept for partitioned output."""
    named = canonical_names(df)
    hits = touches_endpoint(named, endpoints, capture, ("Src IP", "Src Port"), ("Dst IP", "Dst Port"), "Protocol")
    return hits.withColumn(K.LABEL, F.lit(label_value)).select(capture, *[q(c) for c in reference])
