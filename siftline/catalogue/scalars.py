"""Scalar functions: numbers (M), times (D), text (T)."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import decision as dec
from ..functions import numeric as num
from ..functions import text as txt
from ..functions import times
from ..operators import augment, prep, temporal
from .base import FEATURES, T1, T2, T3, flows, items, query, r, sql_draw, sql_error_type, sql_log, sql_number, sql_ratio, table

RAW = sql_number("bytes_per_s_raw")


@query("M1", f"SELECT row_id, {r(sql_log('flow_iat_std'))} AS logged FROM flows")
def m1(spark, d):
    return flows(spark, d).select("row_id", num.signed_log1p(F.col("flow_iat_std")).alias("logged"))


@query("M2", f"SELECT row_id, {r('CASE WHEN isfinite(x) THEN x END')} AS value FROM (SELECT row_id, CASE WHEN row_id % 11 = 0 THEN CAST('inf' AS DOUBLE) WHEN row_id % 13 = 0 THEN CAST('nan' AS DOUBLE) WHEN row_id % 17 = 0 THEN CAST('-inf' AS DOUBLE) ELSE fwd_len_mean END AS x FROM flows)")
def m2(spark, d):
    i = F.col("row_id")
    x = (
        F.when(i % 11 == 0, F.lit(float("inf")))
        .when(i % 13 == 0, F.lit(float("nan")))
        .when(i % 17 == 0, F.lit(float("-inf")))
        .otherwise(F.col("fwd_len_mean"))
    )
    return flows(spark, d).select("row_id", num.finite(x).alias("value"))


@query("M3", f"SELECT row_id, {r(RAW)} AS value FROM flows")
def m3(spark, d):
    return flows(spark, d).select("row_id", num.number_from_text(F.col("bytes_per_s_raw")).alias("value"))


@query("M4", f"SELECT source_file, round(price, 2) AS price, round(discount, 2) AS discount, {r(sql_ratio('price', 'discount'))} AS ratio, {r('CASE WHEN abs(discount) > 1e-12 THEN price / discount END')} AS ratio_or_null FROM items")
def m4(spark, d):
    p, q = F.col("price"), F.col("discount")
    return items(spark, d).select(
        "source_file", F.round(p, 2).alias("price"), F.round(q, 2).alias("discount"),
        num.safe_ratio(p, q).alias("ratio"), num.ratio_or_null(p, q).alias("ratio_or_null"),
    )


@query("M5", f"SELECT row_id, {r(sql_ratio('CAST(fwd_len_std AS DOUBLE)', 'abs(fwd_len_mean)'))} AS cv FROM flows")
def m5(spark, d):
    return flows(spark, d).select("row_id", num.variation(F.col("fwd_len_std"), F.col("fwd_len_mean")).alias("cv"))


@query("M6", f"""WITH s AS (SELECT median(flow_iat_std) AS m, quantile_cont(flow_iat_std, 0.75) - quantile_cont(flow_iat_std, 0.25) AS i FROM flows)
SELECT row_id, {r('(flow_iat_std - m) / CASE WHEN i = 0 THEN 1 ELSE i END')} AS scaled FROM flows, s""")
def m6(spark, d):
    from ..operators.ordered import exact_quantiles, scalars

    df = flows(spark, d)
    got = scalars(exact_quantiles(df, [], "flow_iat_std", [0.25, 0.5, 0.75]))["q"]
    return df.select("row_id", num.robust_scale(F.col("flow_iat_std"), got[1], got[2] - got[0]).alias("scaled"))


@query("M7", f"SELECT row_id, CAST(lstm_probability >= {T1} AS INT) AS lstm_pred, CAST(litemv_probability >= {T2} AS INT) AS litemv_pred, CAST(rf_probability >= {T3} AS INT) AS rf_pred FROM flows")
def m7(spark, d):
    return flows(spark, d).select(
        "row_id", *[dec.decide(F.col(f"{m}_probability"), t).alias(f"{m}_pred") for m, t in (("lstm", T1), ("litemv", T2), ("rf", T3))]
    )


@query("M8", "SELECT row_id, CAST(rf_probability > CAST(700 AS DOUBLE) / 1391 AS INT) AS predicted FROM flows")
def m8(spark, d):
    return flows(spark, d).select("row_id", dec.decide(F.col("rf_probability"), F.lit(700.0) / 1391, strict=True).alias("predicted"))


@query("M9", f"SELECT row_id, {sql_error_type('label', 'p')} AS error_type FROM (SELECT row_id, label, CAST(lstm_probability >= {T1} AS INT) AS p FROM flows)")
def m9(spark, d):
    return flows(spark, d).select("row_id", dec.error_type(F.col("label"), dec.decide(F.col("lstm_probability"), T1)).alias("error_type"))


@query("M10", f"SELECT row_id, {r(f'lstm_probability - {T1}')} AS signed_margin, {r(f'abs(lstm_probability - {T1})')} AS abs_margin FROM flows")
def m10(spark, d):
    m = dec.signed_margin(F.col("lstm_probability"), T1)
    return flows(spark, d).select("row_id", m.alias("signed_margin"), F.abs(m).alias("abs_margin"))


@query("M11", f"SELECT row_id, {r(f'CASE WHEN lstm_probability >= {T1} THEN lstm_probability - {T1} ELSE {T1} - lstm_probability END')} AS margin FROM flows")
def m11(spark, d):
    return flows(spark, d).select("row_id", dec.support_margin(F.col("lstm_probability"), T1).alias("margin"))


@query("M12", "SELECT row_id, CASE WHEN rf_probability < 0.5 THEN 'WEAK' WHEN rf_probability < 0.9 THEN 'MODERATE' ELSE 'STRONG' END AS strength FROM flows")
def m12(spark, d):
    return flows(spark, d).select("row_id", dec.strength(F.col("rf_probability")).alias("strength"))


def _levels(cv, n, high, moderate, noun):
    return (
        f"CASE WHEN {n} < 3 OR {cv} IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN {cv} <= {high} THEN 'HIGH_{noun}' "
        f"WHEN {cv} <= {moderate} THEN 'MODERATE_{noun}' ELSE 'LOW_{noun}' END"
    )


@query("M13", f"""SELECT row_id, {_levels('cv', 'n', 0.15, 0.35, 'REGULARITY')} AS regularity, {_levels('cv', 'n', 0.20, 0.50, 'STABILITY')} AS stability
FROM (SELECT row_id, row_id % 7 AS n, CASE WHEN row_id % 10 = 0 THEN NULL ELSE CAST(row_id % 100 AS DOUBLE) / 100 END AS cv FROM flows)""")
def m13(spark, d):
    n = F.col("row_id") % 7
    cv = F.when(F.col("row_id") % 10 != 0, (F.col("row_id") % 100).cast("double") / 100)
    return flows(spark, d).select("row_id", dec.regularity_level(cv, n).alias("regularity"), dec.stability_level(cv, n).alias("stability"))


def benign_centroid_errors(spark, d):
    """Distance of every vector from the centroid of the benign ones (labels below 8), as an array."""
    from ..operators.ordered import scalars

    e = table(spark, d, "embeddings")
    parts = e.where(F.col("label") < 8).select(F.posexplode("embedding").alias("i", "v"))
    center = parts.groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("c")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c")
    )
    rows = e.withColumn("c", scalars(center)["c"])
    errors = F.zip_with(F.transform("embedding", lambda v: v.cast("double")), F.col("c"), lambda a, b: a - b)
    return rows.select("vec_id", "label", errors.alias("errors"))


@query("M14", """WITH parts AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT i, avg(CAST(v AS DOUBLE)) AS c FROM parts WHERE label < 8 GROUP BY i),
e AS (SELECT vec_id, (CAST(v AS DOUBLE) - c) AS e, row_number() OVER (PARTITION BY vec_id ORDER BY (CAST(v AS DOUBLE) - c) * (CAST(v AS DOUBLE) - c) DESC) AS k FROM parts JOIN c USING (i))
SELECT vec_id, (round(avg(e * e), 6) + 0.0) AS mse, (round(avg(abs(e)), 6) + 0.0) AS mae,
(round(sum(e * e) FILTER (WHERE k <= 5) / 5, 6) + 0.0) AS top5_mse, (round(sum(e * e) FILTER (WHERE k <= 10) / 10, 6) + 0.0) AS top10_mse FROM e GROUP BY vec_id""")
def m14(spark, d):
    df = benign_centroid_errors(spark, d)
    return df.select(
        "vec_id", *[num.reconstruction_score(F.col("errors"), m).alias(m) for m in ("mse", "mae", "top5_mse", "top10_mse")]
    )


@query("M15", f"SELECT row_id, {r('least(lstm_probability, litemv_probability, rf_probability)')} AS weakest FROM flows")
def m15(spark, d):
    return flows(spark, d).select("row_id", dec.weakest(F.col("lstm_probability"), F.col("litemv_probability"), F.col("rf_probability")).alias("weakest"))


def portable_factor(source, copy):
    """Factor from the number in the source name, by integer arithmetic both engines share."""
    low, high = K.WARP_RANGES[copy - 1]
    number = F.regexp_extract(source, "u([0-9]+)$", 1).cast("long")
    return F.lit(low) + (high - low) * (F.pmod(number * 37 + copy * 11, F.lit(101)) / 101.0)


def warped(spark, d, factor=portable_factor):
    df = flows(spark, d).where("split = 'train'").withColumn("flow_id", F.col("row_id").cast("string"))
    return augment.timewarp(
        df, source="source_file", label="label", timing=["flow_iat_std"], rates=["bytes_per_s_raw"], factor=factor, flow_id="flow_id"
    )


SQL_WARPED = f"""WITH w AS (SELECT *, CASE WHEN copy_index = 1 THEN 0.5 + (0.9 - 0.5) * (CAST((user_id * 37 + 11) % 101 AS DOUBLE) / 101)
  ELSE 1.1 + (2.0 - 1.1) * (CAST((user_id * 37 + 22) % 101 AS DOUBLE) / 101) END AS f FROM flows, (VALUES (1), (2)) AS c(copy_index) WHERE split = 'train' AND label = 1)"""


@query("M16", f"""{SQL_WARPED} SELECT row_id, copy_index, source_file AS original_source, printf('%s__FINAL_TIMEWARP__%d_s%.6f', source_file, copy_index, f) AS source_file,
printf('%s__FINAL_TIMEWARP__%d', CAST(row_id AS STRING), copy_index) AS flow_id, {r('f')} AS time_scale, {r('flow_iat_std * f')} AS flow_iat_std, {r(f'({RAW}) / f')} AS rate FROM w""")
def m16(spark, d):
    return warped(spark, d).select(
        "row_id", "copy_index", "original_source", "source_file", "flow_id", "time_scale", "flow_iat_std", F.col("bytes_per_s_raw").alias("rate")
    )


@query("A32", f"""{SQL_WARPED} SELECT source_file AS original_source, printf('%s__FINAL_TIMEWARP__%d_s%.6f', source_file, copy_index, f) AS source_file, copy_index, {r('f')} AS time_scale, count(*) AS original_rows FROM w GROUP BY ALL""")
def a32(spark, d):
    return augment.warp_manifest(warped(spark, d), "source_file")


@query("M16_hashed", f"""WITH w AS (SELECT *, CASE WHEN copy_index = 1 THEN 0.5 + (0.9 - 0.5) * u ELSE 1.1 + (2.0 - 1.1) * u END AS f FROM (SELECT *, CAST({sql_draw('source_file', 'copy_index', '42')} AS DOUBLE) / 281474976710656 AS u FROM flows, (VALUES (1), (2)) AS c(copy_index) WHERE split = 'train' AND label = 1))
SELECT source_file AS original_source, printf('%s__FINAL_TIMEWARP__%d_s%.6f', source_file, copy_index, f) AS source_file, copy_index, {r('f')} AS time_scale, count(*) AS original_rows FROM w GROUP BY ALL""")
def m16_hashed(spark, d):
    return augment.warp_manifest(warped(spark, d, augment.hashed_factor()), "source_file")


def _noise(i: int) -> str:
    unit = lambda salt: f"(CAST({sql_draw('row_id', str(i), '42', str(salt))} + 1 AS DOUBLE) / 281474976710657)"
    return f"0.05 * sqrt(-2.0 * ln({unit(0)})) * cos(2.0 * 3.141592653589793 * {unit(1)})"


@query("M17", "SELECT row_id, " + ", ".join(f"{r(f'{x} + {_noise(i)}')} AS {x}" for i, x in enumerate(FEATURES)) + " FROM flows")
def m17(spark, d):
    return augment.add_noise(flows(spark, d), FEATURES, 0.05, "row_id").select("row_id", *FEATURES)


@query("M18", f"SELECT row_id, {r('greatest(flow_iat_std, 0)')} AS floored, {r('least(greatest(flow_iat_std / 100, 0), 1)')} AS clipped FROM flows")
def m18(spark, d):
    x = F.col("flow_iat_std")
    return flows(spark, d).select("row_id", num.clip(x, low=0.0).alias("floored"), num.clip(x / 100, 0.0, 1.0).alias("clipped"))


# -- times -----------------------------------------------------------------------------


@query("D1", """SELECT row_id, CAST(CASE WHEN row_id % 50 = 0 THEN NULL WHEN row_id % 2 = 0 THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us(ts) END AS STRING) AS us FROM flows""")
def d1(spark, d):
    i, ts = F.col("row_id"), F.col("ts")
    text = (
        F.when(i % 50 == 0, "not a time")
        .when(i % 2 == 0, F.date_format(ts, "M/d/yyyy H:mm:ss"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )
    return flows(spark, d).select("row_id", text.alias("t")).select("row_id", times.micros(times.parse_mixed(F.col("t"))).cast("string").alias("us"))


@query("D2", "SELECT row_id, epoch_us(date_trunc('second', ts)) AS us FROM flows")
def d2(spark, d):
    df = flows(spark, d).withColumn("t", F.date_format("ts", "d/M/yyyy H:mm:ss"))
    return temporal.choose_timestamp(df, "t").select("row_id", times.micros(F.col("parsed")).alias("us"))


@query("D3", f"SELECT row_id, {r('(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY source_file ORDER BY ts, row_id))) / 1e6')} AS seconds FROM flows")
def d3(spark, d):
    from ..operators.ordered import Ordered

    o = Ordered(flows(spark, d).select("row_id", "source_file", "ts"), ["source_file"], ["ts", "row_id"], halo=1)
    o.add({"seconds": times.seconds_between(F.col("ts"), F.lag("ts").over(o.window()))})
    return o.done().select("row_id", "seconds")


@query("D4", "SELECT row_id, CAST(epoch_us(ts) AS STRING) AS key FROM flows")
def d4(spark, d):
    return flows(spark, d).select("row_id", times.micros(F.col("ts")).cast("string").alias("key"))


# -- text ------------------------------------------------------------------------------


@query("T1", "SELECT doc_id, replace(trim(concat('  ', source, '\\', lang, ' ')), '\\', '/') AS path FROM documents")
def t1(spark, d):
    raw = F.concat(F.lit("  "), "source", F.lit("\\"), "lang", F.lit(" "))
    return table(spark, d, "documents").select("doc_id", txt.normalize_source(raw).alias("path"))


FEATURE_CASE = "['Flow Duration', ' fwd  IAT Mean', 'Active Std', 'Idle Min', 'Flow Bytes/s', 'Fwd Bulk Rate Avg', 'SYN Flag Count', 'Down/Up Ratio']"


@query("T2", f"""SELECT kind, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM (SELECT row_id, CASE WHEN n = 'flow duration' OR contains(concat(' ', n, ' '), ' iat ') OR starts_with(n, 'active ') OR starts_with(n, 'idle ') THEN 'timing'
WHEN ends_with(n, '/s') OR contains(n, ' rate avg') THEN 'rate' WHEN contains(n, 'flag') THEN 'flag' ELSE 'other' END AS kind
FROM (SELECT row_id, lower(regexp_replace(trim({FEATURE_CASE}[1 + row_id % 8]), '\\s+', ' ', 'g')) AS n FROM flows)) GROUP BY kind""")
def t2(spark, d):
    names = F.array(*[F.lit(s) for s in ("Flow Duration", " fwd  IAT Mean", "Active Std", "Idle Min", "Flow Bytes/s", "Fwd Bulk Rate Avg", "SYN Flag Count", "Down/Up Ratio")])
    name = F.get(names, (F.col("row_id") % 8).cast("int"))
    return (
        flows(spark, d).select("row_id", txt.feature_kind(name).alias("kind"))
        .groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))
    )


@query("T3", "SELECT row_id, printf('%s__FINAL_TIMEWARP__%d_s%.6f', source_file, 1, CAST(row_id % 1000 AS DOUBLE) / 1000) AS name FROM flows")
def t3(spark, d):
    factor = (F.col("row_id") % 1000).cast("double") / 1000
    return flows(spark, d).select("row_id", txt.warped_source(F.col("source_file"), F.lit(1), factor).alias("name"))


@query("T4", "SELECT row_id, printf('case_%05d', row_number() OVER (ORDER BY source_file, ts, row_id)) AS case_id FROM flows WHERE lstm_probability >= 0.9")
def t4(spark, d):
    df = flows(spark, d).where(F.col("lstm_probability") >= 0.9)
    numbered = temporal.row_ids(df, ["source_file", "ts", "row_id"], "n")
    return numbered.select("row_id", txt.case_id(F.col("n") + 1).alias("case_id"))


@query("T5", "SELECT row_id, CASE WHEN label = 1 THEN 'COBALT_STRIKE_HTTPS_C2' ELSE 'NOT_COBALT_STRIKE_HTTPS_C2' END AS name FROM flows")
def t5(spark, d):
    return flows(spark, d).select("row_id", txt.label_name(F.col("label")).alias("name"))


@query("N6", "SELECT doc_id, sha256(text) AS digest FROM documents")
def n6(spark, d):
    return table(spark, d, "documents").select("doc_id", txt.sha256(F.col("text")).alias("digest"))


@query("N7", "SELECT row_id, concat('{\"row_id\":', row_id, CASE WHEN row_id % 3 = 0 THEN '' ELSE concat(',\"count\":', row_id % 7) END, '}') AS json FROM flows")
def n7(spark, d):
    i = F.col("row_id")
    dirty = F.when(i % 3 == 0, F.lit(float("nan"))).otherwise((i % 7).cast("double"))
    return flows(spark, d).select("row_id", F.to_json(F.struct("row_id", num.finite(dirty).cast("long").alias("count"))).alias("json"))
