"""Operators against brute force on small frames, and invariants on the given tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftline import constants as K
from siftline.catalogue import base
from siftline.operators import (
    alignment, augment, calibrate, columns, filters, forensic, metrics, models, prep, quality, reporting, rules, sequence, splits,
    temporal,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def flows(spark):
    return base.flows(spark, SF)


# -- columns ---------------------------------------------------------------------------


def test_feature_lists():
    assert len(K.FLOW_COLUMNS) == 89 and len(set(K.FLOW_COLUMNS)) == 89
    assert len(K.selected_features(K.FLOW_COLUMNS)) == 57
    assert len(K.hardened_features(K.selected_features(K.FLOW_COLUMNS))) == 43
    assert len(K.forest_features()) == 32
    timing, rates = augment.warp_features(K.hardened_features(K.selected_features(K.FLOW_COLUMNS)))
    assert len(timing) == 15 and len(rates) == 5


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "`﻿a ` int, ` b` int")
    assert columns.clean_names(df).columns == ["a", "b"]
    with pytest.raises(ValueError):
        columns.clean_names(spark.createDataFrame([(1, 2)], "`a ` int, ` a` int"))
    df = spark.createDataFrame([(1, 2, 3)], "`Source IP` int, `Src IP` int, `Total TCP Flow Time` int")
    assert columns.canonical_names(df).columns == ["Src IP", "Total Connection Flow Time"]
    assert columns.resolve_alias(["SRC_ip", "x"], ["Src IP"], "address") == "SRC_ip"
    with pytest.raises(ValueError):
        columns.resolve_alias(["x"], ["Src IP"], "address")


def test_schema_violations(spark):
    got = lambda cols, exp: {(r["kind"], r["column"]) for r in quality.schema_violations(spark, cols, exp).collect()}
    assert got(["a", "b"], ["a", "b"]) == set()
    assert got(["a", "x", "a"], ["a", "b"]) == {("missing", "b"), ("unexpected", "x"), ("repeated", "a")}
    assert got(["b", "a"], ["a", "b"]) == {("misplaced", "b"), ("misplaced", "a")}


def test_fingerprint_ignores_order_and_sees_changes(spark, flows):
    one = quality.fingerprint(flows, ["row_id", "split"]).first()
    assert quality.fingerprint(flows.orderBy(F.desc("row_id")), ["row_id", "split"]).first() == one
    assert quality.fingerprint(flows.withColumn("split", F.lit("x")), ["row_id", "split"]).first() != one


def test_public_addresses(spark):
    import ipaddress

    ips = ["8.8.8.8", "10.1.2.3", "172.15.0.1", "172.16.0.1", "192.168.1.1", "127.0.0.1", "192.0.0.9", "192.0.0.8", "100.64.0.1", "224.0.0.1",
           "240.0.0.1", "1.2.3", "01.2.3.4", "256.1.1.1", "2001:4860::8888", "::1", "fe80::1", "fc00::2", "junk:", "203.0.113.9"]
    rows = [(ip, "Benign", "0") for ip in ips] + [("9.9.9.9", "Attack", "0"), ("9.9.9.8", "Benign", "1")]
    got = {r["ip"] for r in filters.public_addresses(spark.createDataFrame(rows, "ip string, c string, l string"), "ip", "c", "l").collect()}

    def public(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return False
        return not a.is_private and not a.is_loopback

    assert got == {ip for ip in ips if public(ip)}


# -- history -----------------------------------------------------------------------------


def history(df, **options):
    return temporal.history_features(
        df, source="source_file", src_ip="src_ip", dst_ip="dst_ip", ts="ts", row_id="row_id", features=["fwd_len_mean"], **options
    )


def test_history_is_causal(flows):
    whole = history(flows).toPandas().set_index("row_id")
    cut = history(flows.where("ts < timestamp_ntz'2024-01-15 00:00:00'")).toPandas().set_index("row_id")
    for c in ("Endpoint History Count", "InterFlow Delta", "fwd_len_mean Prev5 Mean", "fwd_len_mean Prev5 Std", "InterFlow Delta Prev5 CV"):
        assert np.allclose(whole.loc[cut.index, c].astype(float), cut[c].astype(float), equal_nan=True)


def test_history_edges(spark):
    rows = [(0, "s", None, "d", "2024-01-01 00:00:05", 1.0), (1, "s", None, "d", "2024-01-01 00:00:05", 3.0), (2, "s", None, "d", None, 5.0),
            (3, "s", None, "d", "2024-01-01 00:00:01", None), (4, "s", "a", "d", "2024-01-01 00:00:09", 9.0)]
    df = spark.createDataFrame(rows, "row_id long, source_file string, src_ip string, dst_ip string, t string, fwd_len_mean double")
    got = {r["row_id"]: r for r in history(df.withColumn("ts", F.to_timestamp("t"))).collect()}
    assert [got[i]["Endpoint History Count"] for i in range(5)] == [1, 2, 3, 0, 0]
    assert [got[i]["InterFlow Delta"] for i in range(5)] == [4.0, 0.0, None, None, None]
    assert [got[i]["fwd_len_mean Prev5 Mean"] for i in range(5)] == [None, 1.0, 2.0, None, None]
    assert got[1]["fwd_len_mean Prev5 Std"] == 0.0 and got[2]["fwd_len_mean Prev5 Std"] == 1.0
    assert got[2]["InterFlow Delta Prev5 CV"] == 1.0


@pytest.mark.parametrize("rule", ["cut", "allocate"])
def test_chronological_split_parts(spark, rule):
    rows = [(f"s{n}", i, i) for n in (1, 2, 3, 4, 7, 20, 101) for i in range(n) if not (rule == "cut" and n < 3)]
    df = spark.createDataFrame(rows, "s string, t long, id long")
    got = temporal.chronological_split(df, ["s"], "t", "id", rule).toPandas()
    for s, part in got.groupby("s"):
        order = part.sort_values("t")["split"].map({"train": 0, "validation": 1, "test": 2}).tolist()
        assert order == sorted(order)
        if len(order) >= 3:
            assert set(order) == {0, 1, 2}
    if rule == "allocate":
        assert got[got.s == "s2"].sort_values("t")["split"].tolist() == ["train", "test"]


def test_sequences_are_padded(spark):
    df = spark.createDataFrame([("a", i, i, float(i)) for i in range(4)] + [("b", 0, 9, 7.0)], "s string, t long, id long, x double")
    run = lambda **o: {(r["s"], r["position"]): [v[0] for v in r["sequence"]] for r in sequence.sliding_sequences(df, ["s"], "t", "id", ["x"], 3, **o).collect()}
    right = run()
    assert right[("a", 0)] == [0.0, -1e6, -1e6] and right[("a", 3)] == [1.0, 2.0, 3.0] and right[("b", 0)] == [7.0, -1e6, -1e6]
    left = run(pad="left", stride=2)
    assert set(left) == {("a", 0), ("a", 2), ("b", 0)} and left[("a", 0)] == [0.0, 0.0, 0.0] and left[("b", 0)] == [0.0, 0.0, 7.0]


# -- metrics and thresholds --------------------------------------------------------------


CASES = {
    "ties": ([0, 0, 1, 1, 0, 1, 1, 0], [0.1, 0.4, 0.4, 0.8, 0.8, 0.9, 0.9, 0.2]),
    "perfect": ([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]),
    "inverted": ([1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9]),
    "equal": ([0, 1, 0, 1], [0.5] * 4),
}


def frame(spark, y, s):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")


@pytest.mark.parametrize("name", CASES)
def test_areas_by_definition(spark, name):
    y, s = map(np.array, CASES[name])
    got = metrics.areas(metrics.curve(frame(spark, y, s), [], "label", "score", rows_per_slice=2), []).first()
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in s[y == 1] for b in s[y == 0]]
    ap, last = 0.0, 0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        tp = int((hit & (y == 1)).sum())
        ap += (tp - last) / y.sum() * tp / hit.sum()
        last = tp
    assert got["roc_auc"] == pytest.approx(np.mean(pairs)) and got["pr_auc"] == pytest.approx(ap)


def test_one_class_has_no_area(spark):
    got = metrics.areas(metrics.curve(frame(spark, [0, 0], [0.1, 0.2]), [], "label", "score"), []).first()
    assert got["roc_auc"] is None and got["pr_auc"] is None


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, p int")
    got = metrics.rates(metrics.confusion(df, [], "label", "p")).first()
    assert (got["precision"], got["recall_tpr"], got["f1"], got["mcc"], got["fnr"]) == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert got["balanced_accuracy"] == 1.0
    assert metrics.rates(metrics.confusion(df, [], "label", "p"), empty=None).first()["fnr"] is None


def test_roc_corners(spark):
    # scores 5..1: steps (tp,fp) = (1,0), (1,0), (0,1), (0,1), (1,0): collinear middles are dropped
    df = frame(spark, [1, 1, 0, 0, 1], [5, 4, 3, 2, 1])
    got = {r["score"]: r["corner"] for r in metrics.curve(df, [], "label", "score", rows_per_slice=1).collect()}
    assert got == {5.0: True, 4.0: True, 3.0: False, 2.0: True, 1.0: True}


def test_thresholds(spark):
    y, s = [0, 0, 1, 0, 1, 1], [0.1, 0.3, 0.4, 0.6, 0.7, 0.9]
    points = metrics.curve(frame(spark, y, s), [], "label", "score")
    one = lambda df: df.first()["threshold"]
    assert one(calibrate.best_fbeta(points, [], 1.0)) == 0.4
    assert one(calibrate.recall_at_fpr(points, [], 0.0)) == 0.7
    assert one(calibrate.recall_at_fpr(points, [], 0.5)) == 0.4
    nothing = metrics.curve(frame(spark, [1, 0], [0.1, 0.9]), [], "label", "score")
    assert one(calibrate.recall_at_fpr(nothing, [], 0.0)) == math.nextafter(0.9, 2)
    assert one(calibrate.best_f1(points, [])) == 0.4
    assert one(calibrate.benign_quantile(frame(spark, y, s), [], "label", "score", 0.5)) == 0.3
    got = calibrate.calibrate(frame(spark, y, s), [], "label", "score").collect()
    assert sum(r["selected"] for r in got) == 1 and len(got) == 3
    assert [r["method"] for r in calibrate.report_thresholds(frame(spark, y, s), [], "label", "score").collect() if r["selected"]] == ["validation_f1"]


# -- forensic ------------------------------------------------------------------------------


def test_rank_statistics_and_p(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 8, 40).astype(float), rng.integers(1, 10, 55).astype(float)
    df = spark.createDataFrame([("f", 1, float(v)) for v in a] + [("f", 0, float(v)) for v in b], "feature string, g int, value double")
    got = forensic.rank_p_values(forensic.rank_statistics(df, ["feature"], "g", "value", rows_per_slice=2)).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    both = np.concatenate([a, b])
    t = np.unique(both, return_counts=True)[1].astype(float)
    n1, n0, n = len(a), len(b), len(both)
    sd = math.sqrt(n1 * n0 / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1))))
    z = (max(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sd
    assert got["u"] == u and got["effect"] == pytest.approx(2 * u / (n1 * n0) - 1)
    assert got["p_value"] == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))))


def test_false_discovery(spark):
    p = {"a": 0.01, "b": 0.02, "c": 0.02, "d": 0.9, "e": None}
    df = spark.createDataFrame([("x", k, v) for k, v in p.items()], "c string, f string, p double")
    got = {r["f"]: r["q_value"] for r in forensic.false_discovery(df, ["c"], "p", "f").collect()}
    assert got["a"] == pytest.approx(0.08 / 3) and got["b"] == got["c"] == pytest.approx(0.08 / 3) and got["d"] == 0.9 and got["e"] is None


def test_representatives_merge(spark):
    df = spark.createDataFrame([(1, "FP", 0.3), (2, "FN", 0.1), (3, "FN", 0.5), (4, "FN", 0.5), (5, "TP", 9.0)], "id long, error_type string, abs_margin double")
    got = sorted((r["error_type"], r["representative_kind"], r["id"]) for r in forensic.representative_errors(df.withColumn("m", F.lit("m")), ["m"], "id").collect())
    assert got == [("FN", "borderline", 2), ("FN", "high_confidence", 3), ("FP", "borderline_and_high_confidence", 1)]


def test_percentile_edges(spark):
    ref = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", float("inf"))], "k string, v double")
    tgt = spark.createDataFrame([("a", 0.5), ("a", 2.0), ("a", 3.0), ("b", 1.0)], "k string, v double")
    for rows_per_slice in (None, 1):
        got = {(r["k"], r["v"]): r["p"] for r in alignment.support_percentiles(ref, tgt, ["k"], "v", "p", rows_per_slice).collect()}
        assert got == {("a", 0.5): 0.0, ("a", 2.0): 1.0, ("a", 3.0): 1.0, ("b", 1.0): 0.5}


def test_rule_without_safe_candidate_is_disabled(spark):
    df = spark.createDataFrame([("d", 1, 0.9, 0.1, 0.1), ("d", 0, 0.1, 0.1, 0.1)] * 3, "k string, label int, a double, b double, c double")
    found = rules.search_three_score(df, ["k"], "label", ["a", "b", "c"], [0.5, 0.5, 0.5])
    assert found.where("safe").count() == 0
    selected = rules.select_rule(found, ["k"], disabled_fallback=True)
    assert selected.first()["enabled"] is False
    out = rules.apply_rule(df, selected, ["k"], ["a", "b", "c"])
    assert out.where("prediction <> baseline OR route <> 'LSTM_DIRECT'").count() == 0


# -- splits -----------------------------------------------------------------------------------


def made(spark, sizes):
    rows = [(s, y, i) for s, (y, n) in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "source string, label int, t long").withColumn("row_id", F.xxhash64("source", "t"))


ARGS = dict(source="source", label="label", ts="t", row_id="row_id")


def test_whole_sources_stay_whole(spark):
    df = made(spark, {f"b{i}": (0, 40 + i) for i in range(20)} | {f"m{i}": (1, 10 + i) for i in range(20)})
    got = splits.source_aware_split(df, **ARGS).toPandas()
    assert len(got) == df.count() and got.row_id.is_unique
    assert (got.groupby("source")["split"].nunique() == 1).all()
    assert set(got.assignment_mode) == {"whole_sourcefile"}
    share = got.split.value_counts(normalize=True)
    assert all(abs(share[s] - r) <= K.WHOLE_TOLERANCE for s, r in K.SPLIT_RATIOS.items())
    assert (got.groupby("split")["label"].nunique() == 2).all()


def test_placement_is_one_rule_for_any_number_of_sources(spark):
    few = {f"b{i}": (0, 40 + i) for i in range(30)} | {f"m{i}": (1, 10 + i) for i in range(30)}
    for times in (1, 40):
        sizes = {f"{k}-{c}": v for k, v in few.items() for c in range(times)}
        table = spark.createDataFrame([(k, y, n) for k, (y, n) in sizes.items()], "source string, label int, rows long")
        got = splits.assign_sources(table, "source", [0.7, 0.15, 0.15], (0, 1)).toPandas().set_index("source")
        for y in (0, 1):
            order = sorted((k for k, v in sizes.items() if v[0] == y), key=lambda k: (-sizes[k][1], k))
            total = sum(sizes[k][1] for k in order)
            seeds = [sizes[k][1] for k in order[:3]]
            gaps = [max(r * total - n, 0.0) for r, n in zip((0.7, 0.15, 0.15), seeds)]
            want, cum = dict(zip(order[:3], range(3))), 0
            for k in order[3:]:
                middle = (cum + sizes[k][1] / 2) / (total - sum(seeds))
                cum += sizes[k][1]
                want[k] = sum(middle > sum(gaps[: j + 1]) / sum(gaps) for j in range(2))
            assert got.part[order].tolist() == [want[k] for k in order]


def test_manifest_of_other_rows_is_refused(spark, tmp_path):
    df = made(spark, {f"b{i}": (0, 40 + i) for i in range(20)} | {f"m{i}": (1, 10 + i) for i in range(20)})
    path = str(tmp_path / "manifest")
    first = splits.shared_split(df, path, **ARGS)
    assert splits.shared_split(df, path, **ARGS).count() == first.count() == df.count()
    with pytest.raises(splits.SplitError):
        splits.shared_split(df.where("t > 0"), path, **ARGS)


def test_oversized_source_is_cut_by_time(spark):
    df = made(spark, {"b0": (0, 600)} | {f"b{i}": (0, 30) for i in range(1, 5)} | {f"m{i}": (1, 30) for i in range(8)})
    got = splits.source_aware_split(df, **ARGS).toPandas()
    assert set(got.oversized_source) == {"b0"}
    big = got[got.source == "b0"].sort_values("t")["split"].tolist()
    assert big == ["train"] * 420 + ["validation"] * 90 + ["test"] * 90
    assert (got[got.source != "b0"].groupby("source")["split"].nunique() == 1).all()


def test_mixed_source_is_refused(spark):
    df = made(spark, {f"b{i}": (0, 9) for i in range(4)} | {f"m{i}": (1, 9) for i in range(4)})
    mixed = df.withColumn("label", F.when((F.col("source") == "b1") & (F.col("t") == 0), 1).otherwise(F.col("label")))
    with pytest.raises(splits.SplitError):
        splits.source_aware_split(mixed, **ARGS)


def test_folds_have_both_classes(spark):
    df = made(spark, {f"b{i}": (0, 5 + 7 * i) for i in range(9)} | {f"m{i}": (1, 3 + i) for i in range(6)})
    got = splits.source_folds(df, source="source", label="label", folds=5)
    rows = alignment.map_sources(df, got, "source", ["fold"])
    assert quality.fold_violations(rows, "source", "label", "fold").count() == 0
    assert got.count() == 15


def test_repeated_holdouts_cover_every_row(spark):
    df = made(spark, {f"b{i}": (0, 30 + i) for i in range(15)} | {f"m{i}": (1, 20 + i) for i in range(15)})
    got = splits.repeated_holdouts(df, **ARGS, candidates=300, min_train_benign=50).toPandas()
    assert (got.groupby("repeat").size() == df.count()).all()
    assert (got.groupby(["repeat", "source"])["split"].nunique() == 1).all()
    assert (got.groupby(["repeat", "split"])["label"].nunique() == 2).all()


def test_holdouts_cut_a_dominating_source(spark):
    df = made(spark, {"b0": (0, 900)} | {f"b{i}": (0, 20) for i in range(1, 8)} | {f"m{i}": (1, 20) for i in range(8)})
    got = splits.repeated_holdouts(df, **ARGS, candidates=300, repeats=2, min_train_benign=50).toPandas()
    big = got[got.source == "b0"]
    assert set(big.split_mode) == {"chronological"} and (big.groupby("repeat")["split"].nunique() == 3).all()
    assert len(got) == 2 * df.count()


# -- models ---------------------------------------------------------------------------------------


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(400, 2)))] + [(999, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    forest = models.IsolationForest.fit(df, ["x", "y"], "id", trees=30, sample=64)
    assert len(forest.trees) == 30 and forest.sample == 64
    scores = forest.score(df).toPandas().set_index("id")["anomaly_score"]
    assert scores.idxmax() == 999 and scores.between(0, 1).all()
    again = models.IsolationForest.fit(df.repartition(3), ["x", "y"], "id", trees=30, sample=64).score(df).toPandas().set_index("id")["anomaly_score"]
    assert np.allclose(scores, again.loc[scores.index])


def test_isolation_samples_are_full_and_distinct(spark):
    df = spark.range(5000).withColumnRenamed("id", "row")
    got = models.isolation_samples(df, "row", 20, 100).groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("row").alias("d")).toPandas()
    assert len(got) == 20 and (got.n == 100).all() and (got.d == 100).all()


def test_reconstruction_error_is_zero_inside_the_plane(spark):
    rng = np.random.default_rng(2)
    u = rng.normal(size=(200, 2))
    x = u @ rng.normal(size=(2, 4))
    rows = [(0, *map(float, r)) for r in x] + [(1, 9.0, -9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "label int, a double, b double, c double, d double")
    got = models.Reconstruction.fit(df, ["a", "b", "c", "d"], "label", 2).score(df, "mse").toPandas()
    assert got[got.label == 0].anomaly_score.max() < 1e-18 and got[got.label == 1].anomaly_score.min() > 1e-3


def test_forest_round_trip(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3 == 0), float(rng.normal() + 2 * (i % 3 == 0)), None if i % 10 == 0 else float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, x double, y double")
    forest = models.Forest.fit(df, ["x", "y"], "label", {**K.FOREST, "numTrees": 8, "maxDepth": 4})
    forest.save(spark, str(tmp_path / "f"))
    one = forest.score(df).toPandas().set_index("id")["rf_probability"]
    two = models.Forest.load(spark, str(tmp_path / "f")).score(df).toPandas().set_index("id")["rf_probability"]
    assert np.allclose(one, two.loc[one.index]) and one[::3].mean() > one[1::3].mean()
    with pytest.raises(ValueError):
        models.Forest.fit(df.where("label = 0"), ["x", "y"], "label")


def test_preprocessor_edges(spark, tmp_path):
    df = spark.createDataFrame([("1", 5.0), ("3", 5.0), ("inf", 5.0), ("x", None)], "a string, b double")
    fitted = prep.RobustPreprocessor.fit(df, ["a", "b"])
    assert fitted.state["a"]["median"] == 2.0 and fitted.state["b"]["iqr"] == 0.0
    assert [r["b"] for r in fitted.transform(df).collect()] == [0.0] * 4
    with pytest.raises(ValueError):
        prep.RobustPreprocessor.fit(df.withColumn("a", F.lit("x")), ["a"])
    with pytest.raises(ValueError):
        fitted.transform(df.drop("b"))


def test_sample_weights_keep_class_share(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    weights = prep.class_weights(df, "label")
    copies = df.where("label = 1").unionByName(df.where("label = 1"))
    total = augment.sample_weights(df.unionByName(copies), weights, "label").groupBy("label").agg(F.sum("sample_weight").alias("w")).toPandas()
    assert np.allclose(total["w"], 4.0)


def test_capped_sample_quotas(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    got = augment.capped_sample(df, "label", "id", 200, 50).groupBy("label").count().toPandas().set_index("label")["count"]
    assert got[0] == 150 and got[1] == 50
    assert augment.capped_sample(df, "label", "id", 5000, 50).count() == 1000


def test_noise_is_repeatable(spark):
    df = spark.range(2000).withColumn("x", F.lit(1.0))
    one = augment.add_noise(df, ["x"], 0.5, "id").toPandas().set_index("id")["x"]
    two = augment.add_noise(df.repartition(5), ["x"], 0.5, "id").toPandas().set_index("id")["x"]
    assert (one == two.loc[one.index]).all() and abs(one.mean() - 1) < 0.05 and abs(one.std() - 0.5) < 0.05


def test_candidates_are_summed_by_expressions(spark):
    """The sums of every candidate equal plain ones and need no Python; sources are dealt to tasks."""
    from siftline.operators.splits import _candidate_table, _draw

    groups = spark.createDataFrame([(f"s{i}", i % 3 // 2, 10 + i, i % 3) for i in range(40)], "s string, label int, rows long, prev1 int").coalesce(1)
    table = _candidate_table(groups, "s", 2, 1, 6, 7)
    assert "InPandas" not in table._jdf.queryExecution().executedPlan().toString()
    for row in table.collect():
        drawn = groups.withColumn("place", _draw("s", F.lit(row["candidate"]), 2, 7)).collect()
        for k, name in enumerate(("train", "validation", "test")):
            for y, kind in enumerate(("benign", "malicious")):
                assert row[f"{name}_{kind}"] == sum(r["rows"] for r in drawn if r["place"] == k and r["label"] == y)
            if k:
                assert row[f"both_{name}1"] == sum(r["place"] == k == r["prev1"] for r in drawn)
                assert row[f"either_{name}1"] == sum(k in (r["place"], r["prev1"]) for r in drawn)
    assert table.count() == 6
