"""Capture files, configuration, sinks and the incremental run."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline import constants as K
from siftline.operators import filters
from siftline.plans import jobs
from siftline.sources import captures, resume
from siftline.streaming.append import append_new_files

COLUMNS = ["Flow ID", "Timestamp", "Value", "Label"]


def write(folder, name, header, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")


def test_headers(spark, tmp_path):
    good = "﻿Flow ID, Timestamp ,Value,Label"
    row = "f1,2024-01-01 00:00:01,5,x"
    write(tmp_path / "a", "one.csv", good, [row])
    write(tmp_path / "a", "two.csv", "Flow ID,Timestamp,Value,Label", [row, row])
    df = captures.read_captures(spark, str(tmp_path / "a"), 1, "malicious", columns=COLUMNS)
    assert df.columns == ["Flow ID", "Timestamp", "SourceFile", "Value", "Label"]
    assert sorted(r["SourceFile"] for r in df.collect()) == ["malicious/one.csv"] + ["malicious/two.csv"] * 2
    assert {r["Label"] for r in df.collect()} == {1}
    for i, header in enumerate(["Timestamp,Flow ID,Value,Label", "Flow ID,Timestamp,Value", "Flow ID,Timestamp,Value,Label,Extra", "f0,2024-01-01 00:00:00,1,x"]):
        write(tmp_path / f"bad{i}", "x.csv", header, [row])
        with pytest.raises(ValueError):
            captures.read_captures(spark, str(tmp_path / f"bad{i}"), 0, "benign", columns=COLUMNS)


def test_ragged_lines_are_refused_and_ties_keep_file_order(spark, tmp_path):
    header = ",".join(COLUMNS)
    for i, line in enumerate(["f1,2024-01-01 00:00:01,5,x,EXTRA,MORE", "f1,2024-01-01 00:00:01,5"]):
        write(tmp_path / f"r{i}", "x.csv", header, ["f0,2024-01-01 00:00:00,1,x", line])
        with pytest.raises(ValueError):
            captures.read_captures(spark, str(tmp_path / f"r{i}"), 0, "benign", columns=COLUMNS)
    write(tmp_path / "t", "x.csv", header, [f"f{n},2024-01-01 00:00:0{n % 2},5,x" for n in (7, 3, 9, 1, 8, 2)])
    df = captures.read_captures(spark, str(tmp_path / "t"), 0, "benign", columns=COLUMNS, position="at")
    assert [r[0] for r in df.orderBy("Timestamp", "at").select("Flow ID").collect()] == ["f8", "f2", "f7", "f3", "f9", "f1"]


def test_ingest_job(spark, tmp_path):
    for i, cls in enumerate(("benign", "malicious")):
        cells = lambda n: ",".join(f"2024-01-01 00:00:0{n}" if c == "Timestamp" else f"{n}" for c in K.FLOW_COLUMNS)
        write(tmp_path / cls, f"{cls}.csv", ",".join(K.FLOW_COLUMNS), [cells(3), cells(1 + i)])
    table = jobs.ingest(spark, {"d1": (str(tmp_path / "benign"), str(tmp_path / "malicious"))}, str(tmp_path / "out"))
    assert table.count() == 4 and set(table.columns) == {*K.FLOW_COLUMNS, "SourceFile", "dataset"}
    assert os.path.isdir(tmp_path / "out" / "dataset=d1")


def test_endpoint_configuration(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([
        {"pcap_file": "a.pcap", "c2_ip": " 1.2.3.4 ", "c2_port": 443}, {"pcap_file": "a.pcap", "c2_ip": "1.2.3.4", "c2_port": 443},
        {"pcap_file": "a.pcapng", "c2_ip": "5.6.7.8", "c2_port": 8443},
    ]))
    config = captures.read_endpoints(spark, str(path))
    assert config.count() == 2
    files = spark.createDataFrame([("a.pcap",), ("b.pcap",)], "capture string")
    union = captures.endpoints_for(files, config).collect()
    exact = captures.endpoints_for(files, config, exact_only_if_found=True).collect()
    assert {r["ip"] for r in union} == {"1.2.3.4", "5.6.7.8"} and {r["ip"] for r in exact} == {"1.2.3.4"}


def test_configured_rows(spark):
    rows = [("a", "1.2.3.4", "443", "9.9.9.9", "5000", "6"), ("a", "9.9.9.9", "5000", "1.2.3.4", "443", "6"), ("a", "1.2.3.4", "80", "9.9.9.9", "443", "6"),
            ("b", "1.2.3.4", "443", "9.9.9.9", "1", "6"), ("a", "1.2.3.4", "443", "9.9.9.9", "1", "17"), ("a", "1.2.3.4", "x", "9.9.9.9", "1", "6")]
    df = spark.createDataFrame(rows, "capture string, `Source IP` string, `Source Port` string, `Destination IP` string, `Destination Port` string, Protocol string")
    config = spark.createDataFrame([("a", "1.2.3.4", 443)], "capture string, ip string, port int")
    got = captures.align_configured(df, config, ["Src IP", "Dst IP", "Label"], "C2")
    assert got.columns == ["capture", "Src IP", "Dst IP", "Label"] and got.count() == 2
    with pytest.raises(ValueError):
        captures.align_and_label(df, ["Missing"], "C2")


def test_capture_names(spark):
    paths = [("/x/cap1_configured_c2/out/f.csv",), ("/x/cap2/out/f.csv",)]
    got = spark.createDataFrame(paths, "p string").select(captures.capture_of_path(F.col("p"))).collect()
    assert [r[0] for r in got] == ["cap1", "cap2"]


def test_incremental_run_does_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "1.csv", "row_id,src_port,dst_port,protocol", ["1,443,9,6", "2,80,9,6"])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("row_id", "src_port", "dst_port", "protocol")])
    keep = lambda df: df.where(filters.https_tcp(F.col("protocol"), F.col("src_port"), F.col("dst_port")))
    run = lambda: append_new_files(spark, str(src), schema, keep, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert run() == 2
    write(src, "2.csv", "row_id,src_port,dst_port,protocol", ["3,9,443,6"])
    run()
    run()
    assert sorted(r["row_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "3"]


def test_incremental_run_goes_by_header_and_counts_every_batch(spark, tmp_path):
    src = tmp_path / "in"
    for n in range(130):
        write(src, f"{n}.csv", "\ufeffa, b " if n % 2 else "b,extra,a", [f"{n},x" if n % 2 else f"x,e,{n}"])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b")])
    args = (spark, str(src), schema, lambda df: df, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert append_new_files(*args, files_per_batch=1) == 130
    got = spark.read.parquet(str(tmp_path / "out")).select("a", "b").collect()
    assert sorted(int(r["a"]) for r in got) == list(range(130)) and {r["b"] for r in got} == {"x"}


def test_incremental_run_refuses_files_without_the_columns(spark, tmp_path):
    write(tmp_path / "in", "x.csv", "a,c", ["1,2"])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b")])
    with pytest.raises(Exception, match="no header"):
        append_new_files(spark, str(tmp_path / "in"), schema, lambda df: df, str(tmp_path / "out"), str(tmp_path / "progress"))


def test_restart_does_only_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "out")
    work = spark.range(30_000).select(F.col("id").alias("a"), F.concat(F.lit("k"), "id").alias("b"), (F.col("id") % 7).alias("v"))
    keys = ["a", "b"]
    assert resume.committed(spark, path) is None and resume.unfinished(work, path, keys).count() == 30_000
    assert resume.commit(work.where("a < 20000"), path, "big", keys) == 20_000
    assert resume.commit(work.where("a between 20000 and 20099"), path, "small", keys) == 100
    assert resume.commit(work.where("a < 0"), path, "none", keys) == 0
    # written without an entry: a run that was stopped
    work.where("a between 25000 and 25999").write.parquet(path + "/data/part=stopped")
    left = resume.unfinished(work, path, keys)
    assert sorted(r["a"] for r in left.collect()) == list(range(20_100, 30_000))
    assert resume.commit(left, path, "stopped", keys) == 9_900
    got = resume.committed(spark, path)
    assert got.count() == 30_000 and got.select(*keys).distinct().count() == 30_000
    assert resume.unfinished(work, path, keys).isEmpty()


def test_filters_let_few_keys_through(spark, tmp_path):
    path = str(tmp_path / "out")
    resume.commit(spark.range(50_000).select("id"), path, "p", ["id"])
    assert resume.candidates(spark.range(50_000), path, ["id"]).count() == 50_000
    strange = resume.candidates(spark.range(10**6, 10**6 + 50_000), path, ["id"])
    assert strange.count() < 150
    nulls = spark.createDataFrame([(None,), (None,), (3,), (3,)], "id long")
    assert [r["id"] for r in resume.unfinished(nulls, path, ["id"]).collect()] == [None, None]


def test_a_part_replaced_leaves_no_old_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    resume.commit(spark.range(10), path, "p", ["id"])
    resume.commit(spark.range(5, 8), path, "p", ["id"])
    assert sorted(r["id"] for r in resume.committed(spark, path).collect()) == [5, 6, 7]
    assert resume.unfinished(spark.range(10), path, ["id"]).count() == 7
    with pytest.raises(ValueError):
        resume.commit(spark.range(1), path, "a/b", ["id"])
