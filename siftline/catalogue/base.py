"""Registry of queries with their SQL twins, and the flow-shaped views both run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Flow view over the events table; the texts are valid in Spark SQL and in DuckDB.
FLOW_COLUMNS = {
    "row_id": "event_id",
    "dataset": "CASE WHEN user_id % 2 = 0 THEN 'dsA' ELSE 'dsB' END",
    "source_file": "concat(CASE WHEN user_id % 5 = 0 THEN 'malicious/u' ELSE 'benign/u' END, CAST(user_id AS STRING))",
    "label": "CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END",
    "ts": "ts",
    "src_ip": "concat('10.0.0.', CAST(user_id % 250 AS STRING))",
    "dst_ip": "event_type",
    "src_port": "1024 + event_id % 5000",
    "dst_port": "CASE WHEN event_id % 3 = 0 THEN 80 ELSE 443 END",
    "protocol": "CASE WHEN event_id % 10 < 8 THEN 6 ELSE 17 END",
    "fwd_len_mean": "value",
    "fwd_len_std": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)",
    "flow_iat_std": "value - 40",
    "bytes_per_s_raw": """CASE WHEN event_id % 97 = 0 THEN 'Infinity' WHEN event_id % 89 = 0 THEN '-inf'
        WHEN event_id % 83 = 0 THEN 'abc' WHEN event_id % 79 = 0 THEN NULL
        ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) END""",
    "split": """CASE WHEN CAST(floor(user_id / 5) AS BIGINT) % 20 < 14 THEN 'train'
        WHEN CAST(floor(user_id / 5) AS BIGINT) % 20 < 17 THEN 'validation' ELSE 'test' END""",
    "lstm_probability": "CAST((event_id * 7919) % 1009 + 500 * (CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / 1509",
    "litemv_probability": "CAST((event_id * 104729) % 997 + 300 * (CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / 1297",
    "rf_probability": "CAST((event_id * 1299709) % 991 + 400 * (CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / 1391",
    "user_id": "user_id",
}
FLOWS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in FLOW_COLUMNS.items()) + " FROM events"

# Flow view over the line items, for operators without row order.
ITEM_COLUMNS = {
    "source_file": "l_suppkey",
    "label": "CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END",
    "fold": "1 + l_suppkey % 5",
    "quantity": "l_quantity",
    "price": "l_extendedprice",
    "discount": "l_discount",
    "tax": "l_tax",
    "score": "CAST((l_partkey * 31 + l_suppkey * 17 + CAST(l_quantity AS BIGINT) * 7) % 499 + 90 * (CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / 589",
}
ITEMS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in ITEM_COLUMNS.items()) + " FROM lineitem"

# Thresholds of the three pseudo-scores.
T1, T2, T3 = 0.6, 0.55, 0.5
THRESHOLDS = {"lstm": T1, "litemv": T2, "rf": T3}
SCORES = ["lstm_probability", "litemv_probability", "rf_probability"]
FEATURES = ["fwd_len_mean", "fwd_len_std", "flow_iat_std"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in FLOW_COLUMNS.items()])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in ITEM_COLUMNS.items()])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded, without negative zero, for comparison across engines."""
    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def sql_draw(*parts: str) -> str:
    """SQL twin of ``draw``."""
    text = ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"CAST(concat('0x', substr(md5(concat_ws('|', {text})), 1, 12)) AS BIGINT)"


def r(expression: str, digits: int = 6) -> str:
    """SQL twin of ``rounded`` for one expression."""
    return f"(round({expression}, {digits}) + 0.0)"


def with_views(sql: str) -> str:
    """Puts the flow views a text uses in front of it."""
    views = []
    if "flows" in sql:
        views.append(f"flows AS ({FLOWS_SQL})")
    if "items" in sql:
        views.append(f"items AS ({ITEMS_SQL})")
    text = sql.strip()
    if not views:
        return text
    if text.upper().startswith("WITH "):
        return "WITH " + ", ".join(views) + ", " + text[5:]
    return "WITH " + ", ".join(views) + " " + text


def query(key: str, sql: str | None = None):
    """Registers a query under ``key``; its result is rounded, its SQL gets the views."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return rounded(fn(spark, sf_dir))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return fn

    return register


# -- SQL building blocks -------------------------------------------------------------


def sql_metrics(tn="tn", fp="fp", fn="fn", tp="tp") -> dict[str, str]:
    """Rates from confusion counts; a zero denominator gives 0."""
    d = lambda a, b: f"CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END"
    recall, spec = d(tp, f"({tp} + {fn})"), d(tn, f"({tn} + {fp})")
    return {
        "accuracy": d(f"({tp} + {tn})", f"({tp} + {tn} + {fp} + {fn})"),
        "balanced_accuracy": f"(({recall}) + ({spec})) / (CASE WHEN {tp} + {fn} > 0 THEN 1 ELSE 0 END + CASE WHEN {tn} + {fp} > 0 THEN 1 ELSE 0 END)",
        "precision": d(tp, f"({tp} + {fp})"),
        "recall_tpr": recall,
        "specificity_tnr": spec,
        "fpr": d(fp, f"({fp} + {tn})"),
        "fnr": d(fn, f"({fn} + {tp})"),
        "f1": d(f"(2.0 * {tp})", f"(2.0 * {tp} + {fn} + {fp})"),
        "f2": d(f"(5.0 * {tp})", f"(5.0 * {tp} + 4.0 * {fn} + {fp})"),
        "mcc": f"CASE WHEN ({tp}+{fp})*({tp}+{fn})*({tn}+{fp})*({tn}+{fn}) = 0 THEN 0.0 ELSE (CAST({tp} AS DOUBLE)*{tn} - CAST({fp} AS DOUBLE)*{fn}) / (sqrt(CAST({tp}+{fp} AS DOUBLE)*({tp}+{fn})) * sqrt(CAST({tn}+{fp} AS DOUBLE)*({tn}+{fn}))) END",
    }


def sql_rates(names=None, **cells) -> str:
    every = sql_metrics(**cells)
    return ", ".join(f"{r(every[n])} AS {n}" for n in (names or every))


def sql_confusion(predicted: str, label: str = "label") -> str:
    cell = lambda y, p: f"count(*) FILTER (WHERE {label} = {y} AND {predicted} = {p})"
    return f"{cell(0, 0)} AS tn, {cell(0, 1)} AS fp, {cell(1, 0)} AS fn, {cell(1, 1)} AS tp"


def sql_error_type(label="label", predicted="predicted") -> str:
    return (
        f"CASE WHEN {label} = 0 AND {predicted} = 0 THEN 'TN' WHEN {label} = 0 THEN 'FP' "
        f"WHEN {predicted} = 0 THEN 'FN' ELSE 'TP' END"
    )


def sql_number(text: str) -> str:
    """Finite decimal number from text, else null."""
    return (
        f"CASE WHEN regexp_full_match({text}, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') "
        f"THEN TRY_CAST({text} AS DOUBLE) END"
    )


def sql_ratio(n: str, d: str) -> str:
    return f"CASE WHEN {n} IS NOT NULL AND {d} IS NOT NULL THEN CASE WHEN abs({d}) > 1e-12 THEN ({n}) / ({d}) ELSE 0.0 END END"


def sql_log(x: str) -> str:
    return f"(sign({x}) * ln(1 + abs({x})))"


SQL_DECISIONS = (
    f"CAST(lstm_probability >= {T1} AS INT) AS lstm_pred, CAST(litemv_probability >= {T2} AS INT) AS litemv_pred, "
    f"CAST(rf_probability >= {T3} AS INT) AS rf_pred"
)
