"""Projections (P), filters (X)."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.decision import decide, error_type
from ..operators import columns, filters, ordered, temporal
from .base import SQL_DECISIONS, T1, flows, query, r, sql_error_type, sql_ratio, table
from .temporal import history, sql_history


def wide_expression(i: int) -> str:
    """Value of the i-th canonical feature, valid in both engines."""
    return f"CAST((event_id * {7 + 2 * i} + {i}) % {101 + i} AS DOUBLE)"


WIDE_FEATURES = [c for c in K.FLOW_COLUMNS if c not in K.METADATA_COLUMNS and c != K.LABEL]
WIDE_IDS = {
    "Flow ID": "CAST(event_id AS STRING)", "Src IP": "concat('10.0.0.', CAST(user_id % 250 AS STRING))", "Src Port": "1024 + event_id % 5000",
    "Dst IP": "event_type", "Dst Port": "CASE WHEN event_id % 3 = 0 THEN 80 ELSE 443 END", "Protocol": "CASE WHEN event_id % 10 < 8 THEN 6 ELSE 17 END",
    "Timestamp": "ts", "SourceFile": "concat('u', CAST(user_id AS STRING))", "Label": "CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END",
}


def wide_flows(spark, d):
    """Canonical 89-column flow table plus source, computed from every event."""
    ev = table(spark, d, "events")
    exprs = {**WIDE_IDS, **{c: wide_expression(i) for i, c in enumerate(WIDE_FEATURES)}}
    order = [c for c in K.FLOW_COLUMNS if c != K.LABEL] + [K.SOURCE, K.LABEL]
    return ev.select(*[F.expr(exprs[c]).alias(c) for c in order])


def sql_sums(features) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS n, sum({wide_expression(WIDE_FEATURES.index(c))}) AS total FROM events" for c in features
    )


def sums(df, features):
    long = ordered.unpivot(df, [], features)
    return long.groupBy("feature").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


@query("P1", "SELECT row_id AS \"Row Id\", source_file AS \"Source\", label AS \"Label\" FROM flows")
def p1(spark, d):
    dirty = flows(spark, d).select(F.col("row_id").alias("﻿Row Id"), F.col("source_file").alias(" Source "), F.col("label").alias("Label\t"))
    return columns.clean_names(dirty)


@query("P2", "SELECT row_id, src_ip AS \"Src IP\", dst_ip AS \"Dst IP\", fwd_len_mean AS \"Fwd Segment Size Avg\" FROM flows")
def p2(spark, d):
    df = flows(spark, d).select(
        "row_id", F.col("src_ip").alias("Source IP"), F.col("dst_ip").alias("Destination IP"),
        F.round("fwd_len_mean", 6).alias("Avg Fwd Segment Size"), F.lit(0).alias("Fwd Segment Size Avg "),
    )
    return columns.canonical_names(df)


@query("P3", "SELECT row_id, src_ip, epoch_us(ts) AS us FROM flows")
def p3(spark, d):
    df = flows(spark, d).select("row_id", F.col("src_ip").alias("SRC_ip"), F.col("ts").alias("time-stamp"))
    ip = columns.resolve_alias(df.columns, K.ROLE_ALIASES["source address"], "source address")
    ts = columns.resolve_alias(df.columns, K.ROLE_ALIASES["timestamp"], "timestamp")
    return df.select("row_id", columns.q(ip).alias("src_ip"), F.unix_micros(columns.q(ts).cast("timestamp")).alias("us"))


@query("P4", sql_sums(WIDE_FEATURES))
def p4(spark, d):
    df = wide_flows(spark, d)
    return sums(df, K.candidate_features(df.columns))


SELECTED = [c for c in WIDE_FEATURES if c not in K.NON_PREDICTIVE_COLUMNS + K.CONSTANT_COLUMNS + K.CORRELATED_COLUMNS]


@query("P5", sql_sums(SELECTED))
def p5(spark, d):
    view, _ = columns.select_features(wide_flows(spark, d))
    return sums(view, K.candidate_features(view.columns))


@query("P6", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{cat}' AS category, {'TRUE' if c in WIDE_FEATURES else 'FALSE'} AS present, {'(SELECT count(*) FROM events)' if c in WIDE_FEATURES else 'CAST(0 AS BIGINT)'} AS n"
    for cat, names in (("non_predictive", K.NON_PREDICTIVE_COLUMNS), ("constant", K.CONSTANT_COLUMNS), ("correlated", K.CORRELATED_COLUMNS)) for c in names
))
def p6(spark, d):
    """Drop manifest with the number of values each dropped column held."""
    df = wide_flows(spark, d)
    held = sums(df, [c for c in K.candidate_features(df.columns) if c not in SELECTED]).select("feature", "n")
    manifest = columns.drop_manifest(spark, df.columns).select("feature", "category", "present")
    return manifest.join(held, "feature", "left").na.fill(0, ["n"])


@query("P7", f"SELECT user_id AS u, count(*) AS n, {r('sum(' + wide_expression(WIDE_FEATURES.index('Flow IAT Std')) + ')')} AS total, CAST(sum(CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS malicious FROM events GROUP BY 1")
def p7(spark, d):
    view = columns.feature_view(wide_flows(spark, d), SELECTED, K.METADATA_COLUMNS, K.LABEL)
    u = F.regexp_extract("SourceFile", "u([0-9]+)", 1).cast("long").alias("u")
    return view.groupBy(u).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Flow IAT Std").alias("total"), F.sum("Label").alias("malicious")
    )


HARDENED = [c for c in SELECTED if c not in K.BRITTLE_COLUMNS and "flag" not in c.lower()]


@query("P8", sql_sums(HARDENED))
def p8(spark, d):
    view, _ = columns.select_features(wide_flows(spark, d))
    hard = columns.harden(view)
    return sums(hard, K.candidate_features(hard.columns))


@query("P9", "SELECT CAST(event_id AS STRING) AS \"Flow ID\", event_type AS \"Dst IP\", CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS \"Label\" FROM events")
def p9(spark, d):
    shuffled = wide_flows(spark, d).select("Label", "Dst IP", "Flow ID", "SourceFile")
    return shuffled.select(*[columns.q(c) for c in K.FLOW_COLUMNS if c in shuffled.columns])


@query("P10", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM events")
def p10(spark, d):
    return temporal.row_ids(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"]).drop("ts")


def _wide(c):
    return wide_expression(WIDE_FEATURES.index(c))


@query("P11", f"""SELECT event_id, {', '.join(f'{r(_wide(c))} AS "{c}"' for c in K.FOREST_BASE_10)}, {r(sql_ratio(_wide('Fwd Packet Length Std'), 'abs(' + _wide('Fwd Packet Length Mean') + ')'))} AS "Fwd Packet Length CV", {r(_wide('Total Length of Fwd Packet'))} AS "Total Length of Fwd Packet" FROM events""")
def p11(spark, d):
    df = columns.forest_base(wide_flows(spark, d)).withColumn("event_id", F.col("Flow ID").cast("long"))
    return columns.representation(df, "base12", ["event_id"])


# -- filters ---------------------------------------------------------------------------


@query("X1", "SELECT row_id FROM flows WHERE protocol = 6 AND (src_port = 443 OR dst_port = 443)")
def x1(spark, d):
    return flows(spark, d).where(filters.https_tcp(F.col("protocol"), F.col("src_port"), F.col("dst_port"))).select("row_id")


@query("X2", "SELECT row_id FROM flows WHERE protocol = 6 AND (src_port = 443 OR dst_port = 443) AND label = 0")
def x2(spark, d):
    text = F.when(F.col("label") == 0, F.concat(F.lit(" "), F.lit("Benign"), F.lit(" "))).otherwise("Bot")
    return flows(spark, d).where(
        filters.benign_text(text) & filters.https_tcp(F.col("protocol"), F.col("src_port"), F.col("dst_port"))
    ).select("row_id")


@query("X3", "SELECT row_id FROM flows WHERE protocol = 6 AND (src_port = 443 OR dst_port = 443) AND (src_ip = CASE WHEN contains(source_file, 'malicious') THEN '10.0.0.5' ELSE '10.0.0.7' END OR dst_ip = CASE WHEN contains(source_file, 'malicious') THEN '10.0.0.5' ELSE '10.0.0.7' END)")
def x3(spark, d):
    host = filters.host_of_capture(F.col("source_file"), "malicious", "10.0.0.5", "10.0.0.7")
    c = F.col
    return flows(spark, d).where(filters.touches_host(c("protocol"), c("src_ip"), c("dst_ip"), host, c("src_port"), c("dst_port"))).select("row_id")


SQL_ENDPOINTS = "SELECT DISTINCT concat(CASE WHEN s_suppkey % 5 = 0 THEN 'malicious/u' ELSE 'benign/u' END, CAST(s_suppkey AS STRING)) AS capture, concat('10.0.0.', CAST(s_suppkey % 250 AS STRING)) AS ip, p AS port FROM supplier, (VALUES (1024), (1500), (443)) AS x(p) UNION SELECT concat('benign/u', CAST(s_suppkey AS STRING)), 'purchase', 443 FROM supplier WHERE s_suppkey % 5 <> 0"


def endpoints(spark, d):
    s = table(spark, d, "supplier")
    name = F.concat(F.when(F.col("s_suppkey") % 5 == 0, "malicious/u").otherwise("benign/u"), F.col("s_suppkey").cast("string"))
    own = s.select(
        name.alias("capture"), F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % 250).cast("string")).alias("ip"),
        F.explode(F.array(F.lit(1024), F.lit(1500), F.lit(443))).alias("port"),
    )
    shop = s.where("s_suppkey % 5 <> 0").select(name.alias("capture"), F.lit("purchase").alias("ip"), F.lit(443).alias("port"))
    return own.unionByName(shop)


@query("X4", f"WITH e AS ({SQL_ENDPOINTS}) SELECT row_id FROM flows f WHERE protocol = 6 AND EXISTS (SELECT 1 FROM e WHERE e.capture = f.source_file AND ((e.ip = f.src_ip AND e.port = f.src_port) OR (e.ip = f.dst_ip AND e.port = f.dst_port)))")
def x4(spark, d):
    df = flows(spark, d)
    return filters.touches_endpoint(df, endpoints(spark, d), "source_file", ("src_ip", "src_port"), ("dst_ip", "dst_port"), "protocol").select("row_id")


SQL_IP = "concat(CAST(o_custkey % 256 AS STRING), '.', CAST((o_custkey * 7) % 256 AS STRING), '.', CAST(o_orderkey % 300 AS STRING), '.', CAST((o_orderkey * 3) % 256 AS STRING))"
_V4_PRIVATE = (
    "a IN (0, 10, 127) OR a >= 240 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2) AND NOT (c = 0 AND e IN (9, 10))) "
    "OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)"
)


@query("X5", f"""SELECT DISTINCT ip FROM (SELECT {SQL_IP} AS ip, o_custkey % 256 AS a, (o_custkey * 7) % 256 AS b, o_orderkey % 300 AS c, (o_orderkey * 3) % 256 AS e FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0) WHERE c <= 255 AND NOT ({_V4_PRIVATE})""")
def x5(spark, d):
    octets = [F.col("o_custkey") % 256, (F.col("o_custkey") * 7) % 256, F.col("o_orderkey") % 300, (F.col("o_orderkey") * 3) % 256]
    df = table(spark, d, "orders").select(
        F.concat_ws(".", *[o.cast("string") for o in octets]).alias("responh"),
        F.when(F.col("o_orderstatus") == "F", " Benign ").otherwise("Probing").alias("traffic_category"),
        (F.col("o_custkey") % 3).cast("string").alias("Label"),
    )
    return filters.public_addresses(df, "responh", "traffic_category", "Label")


# Addresses in several spellings from two numbers of an order: groups g, h, i of 16 bits, one of five forms.
_V6_FIRST = [0x2001, 0x2A00, 0xFE80, 0xFD00, 0x2002, 0x0064, 0x2606, 0x0100]
_V6_GROUPS = {
    "g": "element_at(array(" + ", ".join(map(str, _V6_FIRST)) + "), CAST(o_custkey % 8 AS INT) + 1)",
    "h": "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 64 WHEN o_orderkey % 3 = 1 THEN 3512 ELSE o_custkey % 65536 END",
    "i": "o_orderkey % 65536",
}
_SQL_V6 = {
    0: "format('{:x}:{:x}:0:0:0:0:0:{:x}', g, h, i)", 1: "format('{:X}:{:04x}::{:x}', g, h, i)", 2: "format('::ffff:{}.{}.{}.9', h % 256, i % 256, g % 256)",
    3: "format('{:x}::{:x}::{:x}', g, h, i)", 4: "format('{:x}:{:x}::{:x}%eth0', g, h, i)",
}
_V6_PRIVATE = (
    "(g = 8193 AND h < 512 AND NOT (h = 3 OR h BETWEEN 32 AND 63 OR (h = 1 AND i IN (1, 2)))) OR (g = 8193 AND h = 3512) OR g = 8194 "
    "OR g BETWEEN 64512 AND 65023 OR g BETWEEN 65152 AND 65215 OR (g = 256 AND h = 0)"
)


@query("X5_ipv6", f"""WITH n AS (SELECT o_orderkey % 5 AS form, list_extract([{', '.join(map(str, _V6_FIRST))}], CAST(o_custkey % 8 AS INT) + 1) AS g, {_V6_GROUPS['h']} AS h, {_V6_GROUPS['i']} AS i FROM orders),
t AS (SELECT *, h % 256 AS a, i % 256 AS b, g % 256 AS c, 9 AS e, CASE form {' '.join(f'WHEN {k} THEN {v}' for k, v in _SQL_V6.items())} END AS ip FROM n)
SELECT DISTINCT ip FROM t WHERE form <> 3 AND NOT (CASE WHEN form = 2 THEN {_V4_PRIVATE} ELSE {_V6_PRIVATE} END)""")
def x5_ipv6(spark, d):
    """Full, shortened, embedded, malformed and zoned spellings."""
    g, h, i = (f"CAST({v} AS BIGINT)" for v in _V6_GROUPS.values())
    texts = [
        f"format_string('%x:%x:0:0:0:0:0:%x', {g}, {h}, {i})", f"format_string('%X:%04x::%x', {g}, {h}, {i})",
        f"concat('::ffff:', {h} % 256, '.', {i} % 256, '.', {g} % 256, '.9')", f"format_string('%x::%x::%x', {g}, {h}, {i})",
        f"format_string('%x:%x::%x%%eth0', {g}, {h}, {i})",
    ]
    df = table(spark, d, "orders").selectExpr(
        "CASE o_orderkey % 5 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts)) + " END AS responh",
        "'Benign' AS traffic_category", "'0' AS Label",
    )
    return filters.public_addresses(df, "responh", "traffic_category", "Label")


@query("X6", "SELECT row_id FROM flows WHERE label = 0")
def x6(spark, d):
    return filters.benign_only(flows(spark, d), "label").select("row_id")


@query("X7", f"{sql_history((5,))} SELECT row_id FROM h WHERE history_count >= 5")
def x7(spark, d):
    return filters.enough_history(history(spark, d), "Endpoint History Count").select("row_id")


@query("X8", f"SELECT row_id, error_type FROM (SELECT row_id, {sql_error_type('label', 'lstm_pred')} AS error_type FROM (SELECT *, {SQL_DECISIONS} FROM flows)) WHERE error_type IN ('FP', 'FN')")
def x8(spark, d):
    df = flows(spark, d).withColumn("error_type", error_type(F.col("label"), decide(F.col("lstm_probability"), T1)))
    return filters.errors_only(df, "error_type").select("row_id", "error_type")


@query("B15", "SELECT dataset, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM flows WHERE protocol = 6 AND (src_port = 443 OR dst_port = 443) GROUP BY 1")
def b15(spark, d):
    """Extraction of the benign side: filter, fixed label, capture name, per-capture totals."""
    from ..sources.captures import align_and_label

    df = flows(spark, d).withColumnsRenamed({"src_ip": "Source IP", "src_port": "Source Port", "dst_port": "Destination Port"})
    kept = filters.https_tcp(F.col("protocol"), F.col("`Src Port`"), F.col("`Dst Port`"))
    out = align_and_label(df, ["dataset", "row_id", "Src IP", "Label"], "Benign", kept)
    return out.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))
