"""Sources and sinks (S): each writes the derived flows below the shared folder and reads them back."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import times
from ..operators import alignment, columns, filters
from ..session import scratch_path
from ..sources import captures, resume
from .base import flows, query, r, table
from .columns import endpoints

SMALL = ["Flow ID", "Timestamp", "Src IP", "Value", "Label"]


def _csv(spark, d, name, condition):
    """CSV captures with blanks around the header names."""
    path = scratch_path(spark, name)
    flows(spark, d).where(condition).select(
        F.col("row_id").alias("﻿Flow ID"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(" Timestamp "),
        F.col("src_ip").alias("Src IP"), F.floor(F.col("fwd_len_mean") * 100).alias("Value"), F.lit("x").alias("Label "),
    ).write.option("header", True).csv(path)
    return path


def _read(spark, path, label, name):
    return captures.read_captures(spark, path, label, name, columns=SMALL)


@query("S1", "SELECT row_id, epoch_us(ts) AS us, src_ip, CAST(floor(fwd_len_mean * 100) AS BIGINT) AS value, 1 AS label, 'malicious/' AS prefix FROM flows WHERE label = 1")
def s1(spark, d):
    df = _read(spark, _csv(spark, d, "s1", "label = 1"), 1, "malicious")
    return df.select(
        F.col("Flow ID").cast("long").alias("row_id"), times.micros(F.col("Timestamp")).alias("us"), F.col("Src IP").alias("src_ip"),
        F.col("Value").cast("long").alias("value"), F.col("Label").alias("label"), F.substring("SourceFile", 1, 10).alias("prefix"),
    )


@query("S2", "SELECT src_ip, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM flows WHERE label = 0 GROUP BY 1")
def s2(spark, d):
    df = _read(spark, _csv(spark, d, "s2", "label = 0"), 0, "benign")
    return df.groupBy(F.col("Src IP").alias("src_ip")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("Flow ID").cast("long")).alias("ids"))


@query("S3", "SELECT dataset, label, count(*) AS n, epoch_us(min(ts)) AS first_us FROM flows GROUP BY 1, 2")
def s3(spark, d):
    parts = None
    for ds in ("dsA", "dsB"):
        paths = [_csv(spark, d, f"s3-{ds}-{y}", f"label = {y} AND dataset = '{ds}'") for y in (0, 1)]
        part = captures.read_dataset(spark, ds, *paths, columns=SMALL)
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("dataset", F.col("Label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min(times.micros(F.col("Timestamp"))).alias("first_us")
    )


@query("S4", "SELECT row_id, dataset, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t FROM flows")
def s4(spark, d):
    path = scratch_path(spark, "s4")
    captures.write_csv(flows(spark, d).select("row_id", "dataset", F.col("ts").alias("t")), path)
    return spark.read.schema("row_id long, dataset string, t string").option("header", True).csv(path)


@query("S5", "SELECT row_id, src_ip, 'C2' AS label FROM flows WHERE protocol = 6 AND (src_port = 443 OR dst_port = 443)")
def s5(spark, d):
    """Files are filtered, labelled and appended as a stream that ends when all are done."""
    from pyspark.sql import types as T

    from ..streaming.append import append_new_files

    source, target, progress = (scratch_path(spark, f"s5-{x}") for x in ("in", "out", "progress"))
    cols = ["row_id", "src_ip", "src_port", "dst_port", "protocol"]
    flows(spark, d).select(*cols).write.option("header", True).csv(source)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])

    def transform(df):
        kept = filters.https_tcp(F.col("protocol"), F.col("src_port"), F.col("dst_port"))
        return captures.align_and_label(df, ["row_id", "src_ip", "label"], "C2", kept, label_column="label")

    append_new_files(spark, source, schema, transform, target, progress)
    return spark.read.parquet(target).drop("batch").withColumn("row_id", F.col("row_id").cast("long"))


@query("S6", "SELECT concat('cap=', dst_ip) AS capture, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM flows GROUP BY 1")
def s6(spark, d):
    path = scratch_path(spark, "s6")
    parts = flows(spark, d).select("row_id", F.concat("dst_ip", F.lit("_configured_c2")).alias("cap"), (F.col("row_id") % 2).alias("part"))
    parts.write.partitionBy("cap", "part").option("header", True).csv(path)
    read = spark.read.schema("row_id long").option("header", True).option("recursiveFileLookup", True).csv(path)
    merged = read.select("row_id", captures.capture_of_path(F.col("_metadata.file_path")).alias("capture"))
    out = scratch_path(spark, "s6-merged")
    merged.write.partitionBy("capture").parquet(out)
    return spark.read.parquet(out).groupBy("capture").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


@query("S7", "SELECT row_id, label FROM flows WHERE dataset = 'dsB'")
def s7(spark, d):
    path = scratch_path(spark, "s7")
    captures.write_canonical(flows(spark, d), path)
    return spark.read.parquet(path).where("dataset = 'dsB'").select("row_id", "label")


@query("S8", """WITH e AS (SELECT DISTINCT concat('cap', CAST(s_suppkey % 20 AS STRING), '.pcap') AS c, concat('10.0.0.', CAST(s_suppkey AS STRING)) AS ip, CAST(443 + s_suppkey % 2 AS INT) AS port FROM supplier)
SELECT concat('cap', CAST(k AS STRING), CASE WHEN k % 2 = 0 THEN '.pcap' ELSE '.pcapng' END) AS capture, ip, port FROM e JOIN (SELECT DISTINCT user_id % 20 AS k FROM events) u ON e.c = concat('cap', CAST(k AS STRING), '.pcap')""")
def s8(spark, d):
    path = scratch_path(spark, "s8")
    table(spark, d, "supplier").select(
        F.format_string("cap%d.pcap", F.col("s_suppkey") % 20).alias("pcap_file"),
        F.concat(F.lit(" 10.0.0."), F.col("s_suppkey").cast("string")).alias("c2_ip"),
        (443 + F.col("s_suppkey") % 2).cast("int").alias("c2_port"),
    ).write.json(path)
    known = spark.read.schema("pcap_file string, c2_ip string, c2_port int").json(path)
    k = F.col("user_id") % 20
    files = table(spark, d, "events").select(
        F.concat(F.lit("cap"), k.cast("string"), F.when(k % 2 == 0, ".pcap").otherwise(".pcapng")).alias("capture")
    ).distinct()
    named = known.select(F.trim("pcap_file").alias("capture"), F.trim("c2_ip").alias("ip"), F.col("c2_port").alias("port")).dropDuplicates()
    return captures.endpoints_for(files, named)


@query("S9", "SELECT dataset, model, count(*) AS n FROM (SELECT dataset, unnest(['lstm', 'litemv', 'rf']) AS model FROM flows) GROUP BY 1, 2")
def s9(spark, d):
    from ..operators.forensic import ledger
    from .metrics import model_rows

    path = scratch_path(spark, "s9")
    rows = model_rows(spark, d)
    led = ledger(rows, label="label", predicted="predicted", score="score", threshold="threshold", keep=["row_id", "dataset", "model"], protocol="holdout")
    captures.write_ledger(led, path)
    return spark.read.parquet(path).groupBy("dataset", "model").agg(F.count(F.lit(1)).alias("n"))


@query("S10", "SELECT concat('{\"row_id\":', row_id, ',\"source\":\"', source_file, '\"}') AS value FROM flows")
def s10(spark, d):
    path = scratch_path(spark, "s10")
    payload = F.struct("row_id", F.col("source_file").alias("source")).alias("payload")
    captures.write_json_lines(flows(spark, d).select(payload), "payload", path)
    return spark.read.text(path)


@query("S11", f"SELECT row_id, source_file FROM flows WHERE lstm_probability >= 0.8 AND row_id % 4 <> 0")
def s11(spark, d):
    path = scratch_path(spark, "s11")
    work = flows(spark, d).where("lstm_probability >= 0.8").select("row_id", "source_file")
    work.where("row_id % 4 = 0").write.parquet(path)
    todo = alignment.unfinished(work, spark.read.parquet(path), ["row_id"])
    return todo


@query("S11_log", "SELECT row_id, source_file, CASE WHEN row_id % 4 = 0 THEN 'first' ELSE 'second' END AS part FROM flows WHERE lstm_probability >= 0.8")
def s11_log(spark, d):
    """A run that was stopped while it wrote its second part, and its restart."""
    path = scratch_path(spark, "s11-log")
    work = flows(spark, d).where("lstm_probability >= 0.8").select("row_id", "source_file")
    resume.commit(work.where("row_id % 4 = 0"), path, "first", ["row_id"])
    work.where("row_id % 4 = 1").write.parquet(f"{path}/data/part=second")
    resume.commit(resume.unfinished(work, path, ["row_id"]), path, "second", ["row_id"])
    return resume.committed(spark, path).select("row_id", "source_file", "part")
