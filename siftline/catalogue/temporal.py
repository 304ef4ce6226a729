"""Windows (W), sorts and top-k (R), and splits (G)."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as txt
from ..functions.decision import decide, error_type
from ..functions.numeric import safe_ratio
from ..operators import alignment, filters, forensic, quality, reporting, rules, sequence, splits, temporal
from ..operators import metrics as met
from ..operators.ordered import Ordered
from ..session import scratch_path
from ..streaming.history import run_history
from .base import FEATURES, FLOW_COLUMNS, SCORES, T1, T2, T3, flows, items, query, r, sql_draw, sql_confusion, sql_error_type, sql_metrics, sql_ratio

ENDPOINT = "PARTITION BY source_file, src_ip, dst_ip ORDER BY ts, row_id"


def history(spark, d, windows=(5,), within=()):
    return temporal.history_features(
        flows(spark, d), source="source_file", src_ip="src_ip", dst_ip="dst_ip", ts="ts", row_id="row_id",
        features=FEATURES, windows=windows, within=within,
    )


def sql_history(windows=(5,), within="") -> str:
    part = f"PARTITION BY {within}source_file, src_ip, dst_ip ORDER BY ts, row_id"
    cols = []
    for k in windows:
        frame = f"({part} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
        for f in [*FEATURES, "delta"]:
            cols.append(f"avg({f}) OVER {frame} AS {f}_mean{k}, stddev_pop({f}) OVER {frame} AS {f}_std{k}")
    return (
        f"WITH g AS (SELECT *, row_number() OVER ({part}) - 1 AS history_count, "
        f"greatest((epoch_us(ts) - epoch_us(lag(ts) OVER ({part}))) / 1e6, CASE WHEN lag(ts) OVER ({part}) IS NOT NULL THEN 0 END) AS delta FROM flows), "
        f"h AS (SELECT *, {', '.join(cols)} FROM g)"
    )


def history_columns(windows=(5,)):
    """Output columns of the history with plain names."""
    out = [F.col("Endpoint History Count").alias("history_count"), F.col("InterFlow Delta").alias("delta")]
    for k in windows:
        for f, name, digits in [*((x, x, 6) for x in FEATURES), ("InterFlow Delta", "delta", 3)]:
            out += [F.round(f"{f} Prev{k} {s}", digits).alias(f"{name}_{s.lower()}{k}") for s in ("Mean", "Std")]
        out.append(F.col(f"InterFlow Delta Prev{k} CV").alias(f"delta_cv{k}"))
    return out


def sql_history_columns(windows=(5,)) -> str:
    out = ["history_count", f"{r('delta')} AS delta"]
    for k in windows:
        for f in [*FEATURES, "delta"]:
            out += [f"{r(f'{f}_{s}{k}', 3 if f == 'delta' else 6)} AS {f}_{s}{k}" for s in ("mean", "std")]
        out.append(f"{r(sql_ratio(f'delta_std{k}', f'abs(delta_mean{k})'))} AS delta_cv{k}")
    return ", ".join(out)


@query("W1", f"{sql_history((3, 5, 10))} SELECT row_id, {sql_history_columns((3, 5, 10))} FROM h")
def w1(spark, d):
    return history(spark, d, (3, 5, 10)).select("row_id", *history_columns((3, 5, 10)))


# Of a stream: flows whose time the watermark, ten minutes behind the newest, has passed.
_SQL_PASSED = "epoch_us(ts) <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM flows) * 1000"


@query("W1_stream", f"{sql_history()} SELECT row_id, {sql_history_columns()} FROM h WHERE {_SQL_PASSED}")
def w1_stream(spark, d):
    """The events read as a stream: keyed state holds the last flows of an endpoint."""
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*").selectExpr(*[f"{e} AS {n}" for n, e in FLOW_COLUMNS.items()])
    out = scratch_path(spark, "stream")
    run_history(
        spark, stream, f"{out}/rows", f"{out}/progress", source="source_file", src_ip="src_ip", dst_ip="dst_ip", ts="ts", row_id="row_id",
        features=FEATURES, delay="10 minutes",
    )
    return spark.read.parquet(f"{out}/rows").select("row_id", *history_columns())


@query("W1_sliced", f"{sql_history((5,))} SELECT row_id, {sql_history_columns((5,))} FROM h")
def w1_sliced(spark, d):
    """The same history with one window."""
    return history(spark, d).select("row_id", *history_columns())


@query("W2", f"SELECT row_id, row_number() OVER ({ENDPOINT}) - 1 AS history_count FROM flows")
def w2(spark, d):
    return temporal.source_positions(flows(spark, d), ["source_file", "src_ip", "dst_ip"], "ts", "row_id", "history_count").select(
        "row_id", "history_count"
    )


@query("W3", f"{sql_history((5,), 'split, ')} SELECT row_id, {r('delta')} AS delta FROM h")
def w3(spark, d):
    return history(spark, d, within=["split"]).select("row_id", F.col("InterFlow Delta").alias("delta"))


@query("W4", f"{sql_history((5,))} SELECT row_id, {r(sql_ratio('delta_std5', 'abs(delta_mean5)'))} AS delta_cv5 FROM h")
def w4(spark, d):
    return history(spark, d).select("row_id", F.col("InterFlow Delta Prev5 CV").alias("delta_cv5"))


SQL_POSITION = "row_number() OVER (PARTITION BY split, source_file ORDER BY ts, row_id) - 1"


@query("W5", f"SELECT row_id, split, source_file, {SQL_POSITION} AS position FROM flows")
def w5(spark, d):
    return temporal.source_positions(flows(spark, d), ["split", "source_file"], "ts", "row_id").select("row_id", "split", "source_file", "position")


@query("W5_sliced", f"SELECT row_id, row_number() OVER (PARTITION BY label ORDER BY ts, row_id) - 1 AS position FROM flows")
def w5_sliced(spark, d):
    """Positions in two very large groups, cut into slices of 500 rows."""
    return temporal.source_positions(flows(spark, d), ["label"], "ts", "row_id").select("row_id", "position")


@query("W6", "SELECT row_id, row_number() OVER (PARTITION BY source_file, CAST(ts AS DATE), label ORDER BY row_id) - 1 AS occurrence FROM flows")
def w6(spark, d):
    df = flows(spark, d).withColumn("day", F.to_date("ts"))
    return temporal.occurrence_number(df, ["source_file", "day", "label"], "row_id").select("row_id", "occurrence")


def _sequence_query(pad, length, value, stride):
    def run(spark, d):
        df = sequence.sliding_sequences(
            flows(spark, d), ["split", "source_file"], "ts", "row_id", ["fwd_len_mean", "flow_iat_std"], length,
            stride=stride, pad=pad,
        )
        flat = F.flatten("sequence")
        weighted = F.aggregate(
            F.zip_with(flat, F.sequence(F.lit(1), F.size(flat)), lambda v, i: v.cast("double") * i), F.lit(0.0), lambda a, v: a + v
        )
        return df.select("row_id", "position", "sequence_length", F.size(flat).cast("long").alias("cells"), F.round(weighted, 2).alias("checksum"))

    return run


def _sequence_sql(pad, length, value, stride):
    fill = f"[CAST({value} AS FLOAT) FOR x IN range(2 * ({length} - len(l)))]"
    flat = f"list_concat(s, {fill})" if pad == "right" else f"list_concat({fill}, s)"
    return f"""WITH p AS (SELECT row_id, {SQL_POSITION} AS position, list([CAST(fwd_len_mean AS FLOAT), CAST(flow_iat_std AS FLOAT)]) OVER (PARTITION BY split, source_file ORDER BY ts, row_id ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS l FROM flows),
q AS (SELECT *, flatten(l) AS s FROM p WHERE position % {stride} = 0), f AS (SELECT *, {flat} AS v FROM q)
SELECT row_id, position, CAST(len(l) AS INT) AS sequence_length, len(v) AS cells,
(round(list_sum(list_transform(v, lambda x, i: CAST(x AS DOUBLE) * i)), 2) + 0.0) AS checksum FROM f"""


query("W7", _sequence_sql("right", 20, -1e6, 1))(_sequence_query("right", 20, -1e6, 1))
query("W7_left", _sequence_sql("left", 40, 0.0, 5))(_sequence_query("left", 40, 0.0, 5))
query("W7_sliced", _sequence_sql("right", 6, -1e6, 1))(_sequence_query("right", 6, -1e6, 1))


SQL_MARGINS = f"""WITH m AS (SELECT row_id, split, CAST(lstm_probability >= {T1} AS INT) AS pred, CASE WHEN lstm_probability >= {T1} THEN lstm_probability - {T1} ELSE {T1} - lstm_probability END AS margin FROM flows)"""


@query("W9", f"""{SQL_MARGINS} SELECT row_id, {r("coalesce((SELECT CAST(count(*) FILTER (WHERE v.margin <= t.margin) AS DOUBLE) / nullif(count(*), 0) FROM m v WHERE v.split = 'validation' AND v.pred = t.pred), 0.5)")} AS percentile FROM m t WHERE split = 'test'""")
def w9(spark, d):
    return _percentiles(spark, d)


@query("W9_sliced", f"""{SQL_MARGINS} SELECT row_id, {r("coalesce((SELECT CAST(count(*) FILTER (WHERE v.margin <= t.margin) AS DOUBLE) / nullif(count(*), 0) FROM m v WHERE v.split = 'validation' AND v.pred = t.pred), 0.5)")} AS percentile FROM m t WHERE split = 'test'""")
def w9_sliced(spark, d):
    return _percentiles(spark, d)


def _percentiles(spark, d):
    from ..functions.decision import support_margin

    df = flows(spark, d).withColumns(
        {"pred": decide(F.col("lstm_probability"), T1), "margin": support_margin(F.col("lstm_probability"), T1)}
    )
    out = alignment.support_percentiles(
        df.where("split = 'validation'"), df.where("split = 'test'"), ["pred"], "margin", "percentile"
    )
    return out.select("row_id", "percentile")


SQL_P = "CAST((user_id * 7919) % 1000 + 1 AS DOUBLE) / 2000"


@query("W10", f"""WITH p AS (SELECT dst_ip, source_file, any_value({SQL_P}) AS p FROM flows GROUP BY ALL),
k AS (SELECT *, p * count(*) OVER (PARTITION BY dst_ip) / row_number() OVER (PARTITION BY dst_ip ORDER BY p, source_file) AS raw, row_number() OVER (PARTITION BY dst_ip ORDER BY p, source_file) AS i FROM p)
SELECT dst_ip, source_file, {r('p')} AS p, {r('least(1.0, min(raw) OVER (PARTITION BY dst_ip ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS q FROM k""")
def w10(spark, d):
    p = (F.pmod(F.col("user_id") * 7919, F.lit(1000)) + 1).cast("double") / 2000
    df = flows(spark, d).groupBy("dst_ip", "source_file").agg(F.min(p).alias("p"))
    return forensic.false_discovery(df, ["dst_ip"], "p", "source_file", "q")


@query("W11", f"""WITH v AS (SELECT dst_ip, fwd_len_mean, count(*) AS t FROM flows GROUP BY ALL)
SELECT dst_ip, {r('fwd_len_mean')} AS fwd_len_mean, t, {r('sum(t) OVER (PARTITION BY dst_ip ORDER BY fwd_len_mean) - t + (t + 1) / 2')} AS mid_rank FROM v""")
def w11(spark, d):
    counts = flows(spark, d).groupBy("dst_ip", "fwd_len_mean").agg(F.count(F.lit(1)).alias("t"))
    out = Ordered(counts, ["dst_ip"], ["fwd_len_mean"]).running({"c": F.col("t")}).done()
    return out.select("dst_ip", "fwd_len_mean", "t", (F.col("c") - F.col("t") + (F.col("t") + 1) / 2).alias("mid_rank"))


@query("W12", f"""WITH g AS (SELECT row_id, source_file, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY source_file ORDER BY ts, row_id))) / 1e6 AS gap FROM flows),
h AS (SELECT *, median(gap) OVER (PARTITION BY source_file ORDER BY ts, row_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM g)
SELECT row_id, {r('gap')} AS gap, {r('CASE WHEN abs(m) > 1e-12 THEN gap / m END')} AS ratio FROM h""")
def w12(spark, d):
    from ..functions import arrays
    from ..functions.numeric import ratio_or_null
    from ..functions.times import micros

    df = flows(spark, d).select("row_id", "source_file", "ts", micros(F.col("ts")).alias("us"))
    o = Ordered(df, ["source_file"], ["ts", "row_id"], halo=6)
    o.add({"gap": (F.col("us") - F.lag("us").over(o.window())) / 1e6})
    o.add({"recent": F.collect_list("gap").over(o.window(-4, 0))})
    return o.done().select("row_id", "gap", ratio_or_null(F.col("gap"), arrays.median(F.col("recent"))).alias("ratio"))


@query("W13", """WITH p AS (SELECT row_id, row_number() OVER (PARTITION BY source_file ORDER BY ts, row_id) AS i, count(*) OVER (PARTITION BY source_file) AS n FROM flows),
b AS (SELECT *, least(greatest(CAST(floor(n * 0.7) AS BIGINT), 1), n - 2) AS t FROM p)
SELECT row_id, CASE WHEN i <= t THEN 'train' WHEN i <= least(greatest(CAST(floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) AS BIGINT), t + 1), n - 1) THEN 'validation' ELSE 'test' END AS part FROM b""")
def w13(spark, d):
    return temporal.chronological_split(flows(spark, d), ["source_file"], "ts", "row_id", "cut", "part").select("row_id", "part")


def fold_results(spark, d):
    """Metrics per source fold and event type, standing for configurations and runs."""
    df = flows(spark, d).withColumns({"fold": (F.col("user_id") / 5).cast("long") % 3, "predicted": decide(F.col("lstm_probability"), T1)})
    return met.rates(met.confusion(df, ["dst_ip", "dataset", "fold"], "label", "predicted"))


SQL_FOLDS = f"""WITH c AS (SELECT dst_ip, dataset, CAST(floor(user_id / 5) AS BIGINT) % 3 AS fold, {sql_confusion(f'CAST(lstm_probability >= {T1} AS INT)')} FROM flows GROUP BY ALL),
f AS (SELECT dst_ip, dataset, fold, tn, fp, fn, tp, {', '.join(f'{e} AS {n}' for n, e in sql_metrics().items())} FROM c)"""


@query("W14", f"""{SQL_FOLDS}, m AS (SELECT dst_ip, avg(f1) AS f1, avg(fpr) AS fpr FROM f GROUP BY dst_ip)
SELECT dst_ip, round(f1, 5) AS f1, round(fpr, 5) AS fpr, CAST(row_number() OVER (ORDER BY f1 DESC, fpr, dst_ip) AS INT) AS selection_rank, row_number() OVER (ORDER BY f1 DESC, fpr, dst_ip) = 1 AS selected FROM m""")
def w14(spark, d):
    runs = fold_results(spark, d).groupBy("dst_ip").agg(F.avg("f1").alias("f1"), F.avg("fpr").alias("fpr"))
    ranked = reporting.rank_rows(runs, [F.col("f1").desc(), F.col("fpr"), F.col("dst_ip")])
    return ranked.withColumns({"f1": F.round("f1", 5), "fpr": F.round("fpr", 5)})


# -- sorts and top-k ---------------------------------------------------------------------


@query("R1", "SELECT row_id, source_file, epoch_us(ts) AS us, row_number() OVER (ORDER BY source_file, ts, row_id) - 1 AS place FROM flows")
def r1(spark, d):
    df = temporal.row_ids(flows(spark, d), ["source_file", "ts", "row_id"], "place")
    return df.orderBy("source_file", "ts", "row_id").select("row_id", "source_file", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "place")


@query("R2", "SELECT row_id, row_number() OVER (PARTITION BY source_file ORDER BY CASE WHEN row_id % 7 <> 0 THEN ts END NULLS LAST, row_id) - 1 AS position FROM flows")
def r2(spark, d):
    df = flows(spark, d).withColumn("t", F.when(F.col("row_id") % 7 != 0, F.col("ts")))
    return temporal.source_positions(df, ["source_file"], "t", "row_id").select("row_id", "position")


@query("R6", f"""{SQL_FOLDS} SELECT dataset, dst_ip, fold, f1, fpr, fnr FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, fpr, fnr, dst_ip, fold) AS k FROM (SELECT dataset, dst_ip, fold, {r('f1')} AS f1, {r('fpr')} AS fpr, {r('fnr')} AS fnr FROM f)) WHERE k = 1""")
def r6(spark, d):
    df = fold_results(spark, d)
    round6 = df.withColumns({c: F.round(c, 6) for c in ("f1", "fpr", "fnr")})
    order = [-F.col("f1"), F.col("fpr"), F.col("fnr"), F.col("dst_ip"), F.col("fold")]
    return reporting.best_row(round6, ["dataset"], order).select("dataset", "dst_ip", "fold", "f1", "fpr", "fnr")


@query("R7", "SELECT dataset, source_file, n AS rows FROM (SELECT dataset, source_file, count(*) AS n, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, source_file) AS k FROM flows GROUP BY 1, 2) WHERE k = 1")
def r7(spark, d):
    table = met.source_table(flows(spark, d), "source_file", "label", ["dataset"])
    return reporting.best_row(table.select("dataset", "source_file", "rows"), ["dataset"], [-F.col("rows"), F.col("source_file")])


@query("R8", "SELECT row_id, source_file FROM flows WHERE lstm_probability >= 0.9 ORDER BY source_file, ts, row_id LIMIT 50")
def r8(spark, d):
    return flows(spark, d).where(F.col("lstm_probability") >= 0.9).orderBy("source_file", "ts", "row_id").limit(50).select("row_id", "source_file")


@query("R9", f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 0) AS b, count(*) FILTER (WHERE label = 1) AS m FROM flows), p AS (SELECT *, least(m, 600, 1000) AS m0, least(b, 2000 - least(m, 600, 1000)) AS b0 FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_draw('row_id', '42')}, row_id) AS i FROM flows)
SELECT row_id, label, {', '.join(f'{r(x)} AS {x}' for x in SCORES)} FROM o, p WHERE n <= 2000 OR i <= CASE WHEN label = 0 THEN b0 ELSE least(m, 2000 - b0) END""")
def r9(spark, d):
    from ..operators.augment import capped_sample

    return capped_sample(flows(spark, d), "label", "row_id", 2000, 600).select("row_id", "label", *SCORES)


@query("R10", f"SELECT round(rf_probability, 2) AS threshold, min(row_id) AS first_row, count(*) AS n FROM flows GROUP BY 1")
def r10(spark, d):
    return flows(spark, d).groupBy(F.round("rf_probability", 2).alias("threshold")).agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n"))


# -- splits ----------------------------------------------------------------------------------


def _placed(sources: str, shares, seeded: str) -> str:
    """SQL of the placement rule over (source_file, label, rows): source_file, label, rows, part."""
    k = len(shares)
    gaps = [f"greatest(CAST({share!r} AS DOUBLE) * all_rows - s{j}, 0.0)" for j, share in enumerate(shares)]
    total = f"greatest({' + '.join(f'g{j}' for j in range(k))}, 1.0)"
    held = " + ".join(f"s{j}" for j in range(k))
    filled = " + ".join(f"CAST(middle > ({' + '.join(f'g{x}' for x in range(j + 1))}) / {total} AS INT)" for j in range(k - 1))
    return f"""(WITH o AS (SELECT *, row_number() OVER c AS i, sum(rows) OVER c AS cum, sum(rows) OVER (PARTITION BY label) AS all_rows FROM {sources} WINDOW c AS (PARTITION BY label ORDER BY rows DESC, source_file ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, {seeded} AND i <= {k} AS is_seed FROM o), e AS (SELECT label, {', '.join(f"coalesce(sum(rows) FILTER (WHERE is_seed AND i = {j + 1}), 0) AS s{j}" for j in range(k))} FROM h GROUP BY label),
t AS (SELECT h.*, e.* EXCLUDE (label), (cum - ({held}) - CAST(rows AS DOUBLE) / 2) / nullif(CAST(all_rows - ({held}) AS DOUBLE), 0) AS middle, {', '.join(f'CAST({g} AS DOUBLE) AS g{j}' for j, g in enumerate(gaps))} FROM h JOIN e USING (label))
SELECT source_file, label, rows, CASE WHEN is_seed THEN CAST(i - 1 AS INT) ELSE {filled} END AS part FROM t)"""


_SHARES = [K.SPLIT_RATIOS[s] for s in K.SPLITS]
_SPLIT_OF = "CASE part WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END"
_HUGE = "CASE WHEN label = 0 AND user_id % 10 <> 3 THEN 'benign/huge' ELSE source_file END"


@query("G1", f"""WITH s AS (SELECT source_file, label, count(*) AS rows FROM flows GROUP BY ALL), p AS {_placed('s', _SHARES, 'true')}
SELECT row_id, source_file, f.label, {_SPLIT_OF} AS split, 'whole_sourcefile' AS assignment_mode FROM flows f JOIN p USING (source_file)""")
def g1(spark, d):
    """Whole-source manifest over all rows."""
    return splits.source_aware_split(flows(spark, d), source="source_file", label="label", ts="ts", row_id="row_id").select(
        "row_id", "source_file", "label", "split", "assignment_mode"
    )


@query("G2", f"""WITH f AS (SELECT row_id, label, ts, {_HUGE} AS source_file FROM flows), s AS (SELECT source_file, label, count(*) AS rows FROM f WHERE source_file <> 'benign/huge' GROUP BY ALL), p AS {_placed('s', _SHARES, 'label = 1')},
c AS (SELECT row_id, row_number() OVER (ORDER BY ts, row_id) AS i, count(*) OVER () AS n FROM f WHERE source_file = 'benign/huge'),
b AS (SELECT *, least(greatest(floor(n * CAST(0.7 AS DOUBLE)), 1), n - 2) AS t FROM c),
cut AS (SELECT row_id, CASE WHEN i <= t THEN 'train' WHEN i <= least(greatest(floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))), t + 1), n - 1) THEN 'validation' ELSE 'test' END AS part_name FROM b)
SELECT f.row_id, f.source_file, f.label, coalesce(part_name, {_SPLIT_OF}) AS split, 'hybrid_oversized_source_chronological' AS assignment_mode, 'benign/huge' AS oversized_source FROM f LEFT JOIN p USING (source_file) LEFT JOIN cut ON f.row_id = cut.row_id""")
def g2(spark, d):
    """One source holds about 60 % of the rows and is cut by time."""
    df = flows(spark, d).withColumn(
        "source_file", F.when((F.col("label") == 0) & (F.col("user_id") % 10 != 3), "benign/huge").otherwise(F.col("source_file"))
    )
    return splits.source_aware_split(df, source="source_file", label="label", ts="ts", row_id="row_id").select(
        "row_id", "source_file", "label", "split", "assignment_mode", "oversized_source"
    )


@query("G3", "SELECT count(*) AS n, count(DISTINCT row_id) AS ids, CAST(0 AS BIGINT) AS crossing FROM flows")
def g3(spark, d):
    """The manifest is written, checked against the rows and read again."""
    from ..session import scratch_path

    path = scratch_path(spark, "split")
    args = dict(source="source_file", label="label", ts="ts", row_id="row_id")
    splits.shared_split(flows(spark, d), path, **args)
    stored = splits.shared_split(flows(spark, d), path, **args)
    per = stored.groupBy("source_file").agg((F.min("split") != F.max("split")).cast("long").alias("x"))
    ids = stored.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids"))
    return ids.withColumn("crossing", per.agg(F.sum("x").alias("x")).scalar())


@query("G4", f"WITH s AS (SELECT source_file, label, count(*) AS rows FROM flows GROUP BY ALL), p AS {_placed('s', [1.0 / 5] * 5, 'true')} SELECT source_file, CAST(label AS INT) AS label, rows, CAST(part + 1 AS INT) AS fold FROM p")
def g4(spark, d):
    return splits.source_folds(flows(spark, d), source="source_file", label="label")


@query("G5", "SELECT row_id, 1 + user_id % 5 AS fold, source_file, label FROM flows")
def g5(spark, d):
    df = flows(spark, d)
    folds = df.groupBy("source_file").agg(F.min(1 + F.col("user_id") % 5).alias("fold"))
    return splits.fold_manifest(df, folds, "row_id", "source_file", "label")


@query("G6", """WITH p AS (SELECT row_id, row_number() OVER (PARTITION BY source_file, dst_ip ORDER BY ts, row_id) AS i, count(*) OVER (PARTITION BY source_file, dst_ip) AS n FROM flows),
a AS (SELECT *, greatest(1, CAST(floor(n * 0.7) AS BIGINT)) AS t, greatest(1, CAST(floor(n * 0.15) AS BIGINT)) AS v FROM p),
s AS (SELECT *, greatest(0, t + v + 1 - n) AS s FROM a),
c AS (SELECT *, CASE WHEN n <= 2 THEN 1 ELSE t - least(s, t - 1) END AS te, CASE WHEN n <= 2 THEN 1 ELSE t - least(s, t - 1) + v - least(s - least(s, t - 1), v - 1) END AS ve FROM s)
SELECT row_id, CASE WHEN i <= te THEN 'train' WHEN i <= ve THEN 'validation' ELSE 'test' END AS part FROM c""")
def g6(spark, d):
    return temporal.chronological_split(flows(spark, d), ["source_file", "dst_ip"], "ts", "row_id", "allocate", "part").select("row_id", "part")


@query("G7")
def g7(spark, d):
    from ..operators.splits import repeated_holdouts

    return repeated_holdouts(
        flows(spark, d), source="source_file", label="label", ts="ts", row_id="row_id", min_train_benign=1000
    ).select(
        "repeat", "row_id", "source_file", "label", "split", "split_mode", "objective"
    )


@query("G8", "SELECT row_id, split FROM flows")
def g8(spark, d):
    number = F.floor(F.col("user_id") / 5)
    return flows(spark, d).select("row_id", splits.hash_split(number).alias("split"))


# -- flagship ------------------------------------------------------------------------------------


@query("flagship", f"""{sql_history((5,))}, z AS (SELECT *, CASE WHEN history_count >= 5 AND fwd_len_mean_std5 IS NOT NULL AND abs(CASE WHEN abs(fwd_len_mean_std5) > 1e-12 THEN (fwd_len_mean - fwd_len_mean_mean5) / fwd_len_mean_std5 ELSE 0.0 END) >= 1.0 THEN 1 ELSE 0 END AS predicted FROM h),
e AS (SELECT source_file, {sql_confusion('predicted')} FROM z GROUP BY source_file)
SELECT source_file, tn, fp, fn, tp, tn + fp + fn + tp AS rows, {r('CASE WHEN tn + fp <> 0 THEN CAST(fp AS DOUBLE) / (tn + fp) END')} AS source_fpr, {r('CASE WHEN fn + tp <> 0 THEN CAST(fn AS DOUBLE) / (fn + tp) END')} AS source_fnr,
{r('CAST(fp + fn AS DOUBLE) / (tn + fp + fn + tp)')} AS source_error_rate,
{r('CAST(fp AS DOUBLE) / (SELECT sum(fp) FROM e)')} AS share_of_fp, {r('CAST(fn AS DOUBLE) / (SELECT sum(fn) FROM e)')} AS share_of_fn FROM e""")
def flagship(spark, d):
    """Endpoint behaviour change: distance of a flow from its previous five, judged and summed per source."""
    df = history(spark, d)
    distance = safe_ratio(F.col("fwd_len_mean") - F.col("fwd_len_mean Prev5 Mean"), F.col("fwd_len_mean Prev5 Std"))
    hit = (F.col("Endpoint History Count") >= 5) & (F.abs(distance) >= 1.0)
    judged = df.withColumn("predicted", F.coalesce(hit, F.lit(False)).cast("int"))
    led = judged.select("source_file", F.lit("all").alias("model"), error_type(F.col("label"), F.col("predicted")).alias("error_type"))
    return forensic.errors_by_source(led, ["model"], "source_file").drop("model")
