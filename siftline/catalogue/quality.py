"""Data-quality checks (Q)."""

from pyspark.sql import functions as F

from ..functions.decision import decide
from ..operators import quality, splits
from ..operators.alignment import match_occurrences
from .base import SQL_DECISIONS, T1, flows, items, query, r, sql_draw, sql_number, table

RAW = sql_number("bytes_per_s_raw")


def text_flows(spark, d):
    """Flows whose time is text, unreadable in every 40th row."""
    bad = F.format_string("bad-%d", F.col("row_id") % 15)
    return flows(spark, d).withColumn(
        "t", F.when(F.col("row_id") % 40 == 0, bad).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )


@query("Q3", """WITH b AS (SELECT printf('bad-%d', row_id % 15) AS e, count(*) AS n FROM flows WHERE row_id % 40 = 0 GROUP BY 1)
SELECT 'total' AS kind, CAST(NULL AS STRING) AS example, CAST(sum(n) AS BIGINT) AS n FROM b UNION ALL (SELECT 'example', e, n FROM b ORDER BY e LIMIT 10)""")
def q3(spark, d):
    return quality.unparsed_timestamps(text_flows(spark, d), "t")


@query("Q4", "SELECT CASE row_id % 5 WHEN 0 THEN '2' WHEN 1 THEN 'x' END AS value, count(*) AS n FROM flows WHERE row_id % 5 < 3 GROUP BY 1")
def q4(spark, d):
    k = F.col("row_id") % 5
    return quality.label_domain(
        flows(spark, d).withColumn("label", F.when(k == 0, "2").when(k == 1, "x").when(k >= 3, (k - 3).cast("string"))), "label"
    )


@query("Q5", "SELECT dst_ip AS source, min(label) AS min_label, max(label) AS max_label, count(*) AS n FROM flows GROUP BY 1 HAVING min(label) <> max(label)")
def q5(spark, d):
    return quality.mixed_sources(flows(spark, d).withColumnRenamed("dst_ip", "source"), "source", "label")


@query("Q6", "SELECT row_id, source_file, value, previous FROM (SELECT row_id, source_file, CAST(floor(fwd_len_mean) AS BIGINT) AS value, lag(CAST(floor(fwd_len_mean) AS BIGINT)) OVER (PARTITION BY source_file ORDER BY row_id) AS previous FROM flows) WHERE previous > value")
def q6(spark, d):
    df = flows(spark, d).withColumn("value", F.floor("fwd_len_mean"))
    return quality.time_regressions(df, "source_file", "value", "row_id")


@query("Q7", f"SELECT 'bytes_per_s_raw' AS feature, count(*) FILTER (WHERE bytes_per_s_raw IS NULL) AS n_null, count(*) FILTER (WHERE bytes_per_s_raw IS NOT NULL AND ({RAW}) IS NULL) AS n_invalid FROM flows")
def q7(spark, d):
    return quality.feature_gaps(flows(spark, d), ["fwd_len_mean", "fwd_len_std", "bytes_per_s_raw"])


@query("Q8", "SELECT 'empty' AS feature, count(*) FILTER (WHERE FALSE) AS n_valid FROM flows")
def q8(spark, d):
    df = flows(spark, d).withColumn("empty", F.when(F.col("row_id") % 2 == 0, "abc"))
    return quality.empty_columns(df, ["fwd_len_mean", "empty", "bytes_per_s_raw"])


@query("Q9", """WITH f AS (SELECT source_file, label, CASE WHEN label = 1 THEN user_id % 2 ELSE (user_id + CASE WHEN user_id % 50 = 1 THEN row_id ELSE 0 END) % 3 END AS fold FROM flows),
s AS (SELECT fold, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM f GROUP BY 1)
SELECT 'source_crosses_folds' AS kind, source_file AS item, count(*) AS n FROM f GROUP BY 2 HAVING count(DISTINCT fold) > 1
UNION ALL SELECT 'fold_side_lacks_class', CAST(fold AS STRING), n0 + n1 FROM s WHERE n0 = 0 OR n1 = 0""")
def q9(spark, d):
    u, i = F.col("user_id"), F.col("row_id")
    fold = F.when(F.col("label") == 1, u % 2).otherwise((u + F.when(u % 50 == 1, i).otherwise(0)) % 3)
    return quality.fold_violations(flows(spark, d).withColumn("fold", fold), "source_file", "label", "fold")


@query("Q10", "SELECT row_id, CAST(1 AS BIGINT) AS n_rows, CAST(CASE WHEN row_id % 100 = 0 THEN 0 ELSE 2 END AS BIGINT) AS n_predictions FROM flows WHERE row_id % 100 = 0 OR row_id % 111 = 1")
def q10(spark, d):
    df = flows(spark, d)
    predictions = df.where("row_id % 100 <> 0").unionByName(df.where("row_id % 100 <> 0 AND row_id % 111 = 1"))
    return quality.coverage_violations(df, predictions, "row_id").where("NOT (n_rows = 1 AND n_predictions = 1)")


@query("Q11", """SELECT row_id, CASE WHEN row_id % 91 = 0 THEN 'not_in_manifest' ELSE 'values_differ' END AS kind FROM flows WHERE row_id % 91 = 0 OR row_id % 77 = 0
UNION ALL SELECT -1 - row_id, 'not_in_rows' FROM flows WHERE row_id % 500 = 3""")
def q11(spark, d):
    df = flows(spark, d).select("row_id", "source_file", "label")
    manifest = df.where("row_id % 91 <> 0").withColumn("label", F.when(F.col("row_id") % 77 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    extra = df.where("row_id % 500 = 3").withColumn("row_id", -1 - F.col("row_id"))
    return quality.manifest_mismatches(df, manifest.unionByName(extra), "row_id", ["source_file", "label"])


@query("Q12", f"SELECT row_id, CAST(1 - (lstm_probability >= {T1})::INT AS INT) AS stored FROM flows WHERE row_id % 123 = 0")
def q12(spark, d):
    right = decide(F.col("lstm_probability"), T1)
    df = flows(spark, d).withColumns(
        {"threshold": F.lit(T1), "stored": F.when(F.col("row_id") % 123 == 0, 1 - right).otherwise(right)}
    )
    return quality.prediction_mismatches(df, "lstm_probability", "threshold", "stored").select("row_id", "stored")


@query("Q13", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q13(spark, d):
    return quality.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("Q14", f"""WITH c AS (SELECT dataset, count(*) FILTER (WHERE ts IS NULL) AS a, count(*) FILTER (WHERE label NOT IN (0, 1)) AS b, count(*) FILTER (WHERE source_file IS NULL) AS c, count(*) FILTER (WHERE NOT isfinite(fwd_len_mean)) AS e FROM flows GROUP BY 1),
l AS (SELECT dataset, count(*) FILTER (WHERE p > ts) AS n FROM (SELECT dataset, ts, lag(ts) OVER (PARTITION BY dataset, source_file ORDER BY row_id) AS p FROM flows) GROUP BY 1)
SELECT dataset, 'missing_timestamp' AS "check", a AS n FROM c UNION ALL SELECT dataset, 'label_domain', b FROM c UNION ALL SELECT dataset, 'missing_source', c FROM c UNION ALL SELECT dataset, 'invalid fwd_len_mean', e FROM c
UNION ALL SELECT dataset, 'mixed_source', CAST(0 AS BIGINT) FROM c UNION ALL SELECT dataset, 'time_regression', n FROM l""")
def q14(spark, d):
    return quality.dataset_checks(flows(spark, d), "dataset", "source_file", "label", "ts", "row_id", ["fwd_len_mean"])


@query("Q15", f"SELECT count(*) AS n, bit_xor(h) AS hash_xor, CAST(sum(h) AS VARCHAR) AS hash_sum FROM (SELECT {sql_draw('row_id', 'source_file', 'label', 'split')} AS h FROM flows)")
def q15(spark, d):
    return quality.fingerprint(flows(spark, d), ["row_id", "source_file", "label", "split"])
