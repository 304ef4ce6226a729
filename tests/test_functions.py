"""Scalar functions on edge values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import arrays, cascade, decision, evidence, numeric, text, times


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_text_numbers(spark):
    good = ["1", " -2.5 ", "+3e2", ".5", "7."]
    bad = ["Infinity", "-Infinity", "+Infinity", "inf", "-inf", "+inf", "INF", "-INF", "+INF", "NaN", "abc", "", "12d", "1f", "0x10", None]
    got = values(spark, [(t,) for t in good + bad], "t string", numeric.number_from_text(F.col("t")))
    assert got[:5] == [1.0, -2.5, 300.0, 0.5, 7.0]
    assert got[5:] == [None] * len(bad)


def test_safe_ratio(spark):
    rows = [(6.0, 3.0), (6.0, 0.0), (6.0, 1e-13), (None, 2.0), (1.0, None), (float("inf"), 2.0), (float("nan"), 1.0)]
    assert values(spark, rows, "a double, b double", numeric.safe_ratio(F.col("a"), F.col("b"))) == [2.0, 0.0, 0.0, None, None, None, None]
    assert values(spark, rows, "a double, b double", numeric.ratio_or_null(F.col("a"), F.col("b")))[:3] == [2.0, None, None]


def test_next_up_is_the_adjacent_double(spark):
    xs = [0.1, 0.5, 1.0, 2.0, 0.999999, 1e-300, 3.7e12, -1.0, -0.3, 0.0, 1.0 - 2**-53]
    assert values(spark, [(x,) for x in xs], "x double", numeric.next_up(F.col("x"))) == [math.nextafter(x, math.inf) for x in xs]


def test_signed_log_and_scaling(spark):
    got = values(spark, [(-3.0,), (0.0,), (3.0,)], "x double", numeric.signed_log1p(F.col("x")))
    assert got == pytest.approx([-math.log(4), 0, math.log(4)])
    got = values(spark, [(5.0,)], "x double", numeric.robust_scale(F.col("x"), F.lit(3.0), F.lit(0.0)))
    assert got == [2.0]


def test_clip_keeps_null(spark):
    assert values(spark, [(-1.0,), (None,), (2.0,)], "x double", numeric.clip(F.col("x"), 0.0, 1.0)) == [0.0, None, 1.0]


def test_reconstruction_scores(spark):
    rows = [([3.0, -1.0, 2.0, 0.5, 4.0, 1.0, 0.0],)]
    score = lambda mode: values(spark, rows, "e array<double>", numeric.reconstruction_score(F.col("e"), mode))[0]
    sq = sorted([9.0, 1.0, 4.0, 0.25, 16.0, 1.0, 0.0])
    assert score("mse") == pytest.approx(sum(sq) / 7)
    assert score("mae") == pytest.approx(11.5 / 7)
    assert score("top5_mse") == pytest.approx(sum(sq[-5:]) / 5)
    assert score("top10_mse") == pytest.approx(sum(sq) / 7)


def test_mixed_times(spark):
    rows = [("2017-07-03 08:00:01",), ("7/3/2017 8:00:01",), ("13/7/2017 8:00:01",), ("3/7/2017 8:00:01 PM",), ("junk",), (None,)]
    day = lambda c: F.date_format(c, "MM-dd HH")
    assert values(spark, rows, "t string", day(times.parse_mixed(F.col("t")))) == ["07-03 08", "07-03 08", "07-13 08", "03-07 20", None, None]
    assert values(spark, rows, "t string", day(times.parse_mixed(F.col("t"), day_first=True)))[1:4] == ["03-07 08", "07-13 08", "07-03 20"]


def test_levels_and_strengths(spark):
    rows = [(0.15, 3), (0.35, 3), (0.36, 3), (0.1, 2), (None, 9), (float("nan"), 9)]
    got = values(spark, rows, "cv double, n int", decision.regularity_level(F.col("cv"), F.col("n")))
    assert got == ["HIGH_REGULARITY", "MODERATE_REGULARITY", "LOW_REGULARITY"] + ["INSUFFICIENT_HISTORY"] * 3
    assert values(spark, [(0.499,), (0.5,), (0.9,)], "p double", decision.strength(F.col("p"))) == ["WEAK", "MODERATE", "STRONG"]


def test_feature_names():
    timing = ["Flow Duration", "Flow IAT Mean", "Bwd  IAT Std", "Active Max", "Idle Min"]
    rates = ["Flow Bytes/s", "Fwd Bulk Rate Avg"]
    assert all(text.is_timing_feature(n) and not text.is_rate_feature(n) for n in timing)
    assert all(text.is_rate_feature(n) and not text.is_timing_feature(n) for n in rates)
    assert not text.is_timing_feature("Fwd Packet Length Mean")


def test_cascade_routes(spark):
    rule = cascade.Rule(0.5, 0.7, 0.6, 0.6, 0.8, 0.9)
    rows = [
        (0.9, 0.0, 0.0), (0.7, 0.6, 0.0), (0.7, 0.5, 0.6), (0.5, 0.5, 0.5), (0.4, 0.8, 0.9), (0.4, 0.8, 0.89), (0.70001, 0.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = cascade.three_score(F.col("a"), F.col("b"), F.col("c"), rule)
    out = [(r[0], r[1]) for r in df.select(got["prediction"], got["route"]).collect()]
    assert out == [
        (1, "LSTM_DIRECT"), (1, "LITEMV_CONFIRMED_LSTM_POSITIVE"), (1, "RF_ARBITRATED_KEEP_MALICIOUS"),
        (0, "LITEMV_RF_FILTERED_LSTM_POSITIVE"), (1, "JOINT_LITEMV_RF_RESCUE"), (0, "LSTM_DIRECT"), (1, "LSTM_DIRECT"),
    ]


def test_cutoff_below_threshold_leaves_only_rescues(spark, events):
    s = lambda k: F.pmod(F.xxhash64("event_id", F.lit(k)), F.lit(1000)) / 1000.0
    got = cascade.three_score(s(1), s(2), s(3), cascade.Rule(0.5, 0.4, 0.9, 0.9, 0.7, 0.7))
    bad = events.select(got["baseline"].alias("b"), got["prediction"].alias("p"), got["route"].alias("r")).where(
        "b <> p AND r <> 'JOINT_LITEMV_RF_RESCUE'"
    )
    assert bad.count() == 0


def test_decision_texts(spark):
    ok = '{"recommended_action": "OVERRIDE_TO_C2", "confidence": "HIGH", "target_specificity": "SUPPORTS_C2", "evidence": ["x \\" y"], "conflict_summary": "s"}'
    texts = [ok, ok[:-20], ok[:40], "", None, "no json", ok.replace("HIGH", "SURE"), "[1]", ok.replace('["x \\" y"]', '["1","2","3","4","5"]')]
    got = values(spark, [(t,) for t in texts], "t string", evidence.parse_decision(F.col("t")))
    assert got[0]["recommended_action"] == "OVERRIDE_TO_C2" and got[0]["evidence"] == ['x " y'] and got[0]["conflict_summary"] == "s"
    assert got[1]["recommended_action"] == "OVERRIDE_TO_C2" and got[1]["conflict_summary"] == evidence.NOTE_RECOVERED
    for d in got[2:]:
        assert d["recommended_action"] == "KEEP_HYBRID" and d["evidence"] == [evidence.NOTE_INVALID]


def test_long_text_does_not_break_the_pattern(spark):
    ok = '{"recommended_action": "OVERRIDE_TO_C2", "confidence": "HIGH", "target_specificity": "SUPPORTS_C2", "evidence": ["' + "long words " * 20000
    got = values(spark, [(ok,)], "t string", evidence.parse_decision(F.col("t")))
    assert got[0]["recommended_action"] == "OVERRIDE_TO_C2"


def test_gate_reasons(spark):
    def gate(hybrid, action, confidence, specificity, strengths):
        d = F.struct(F.lit(action).alias("recommended_action"), F.lit(confidence).alias("confidence"), F.lit(specificity).alias("target_specificity"))
        row = spark.range(1).select(evidence.safety_gate(F.lit(hybrid), d, *[F.lit(s) for s in strengths]).alias("g")).first()["g"]
        return row["gate_reason"], row["final_label"], row["override_accepted"]

    weak, strong = ("WEAK", "STRONG", "STRONG"), ("STRONG",) * 3
    assert gate(1, "KEEP_HYBRID", "HIGH", "SUPPORTS_C2", weak) == ("LLM_KEEP_HYBRID", 1, False)
    assert gate(1, "OVERRIDE_TO_C2", "HIGH", "SUPPORTS_C2", weak) == ("LLM_ACTION_MATCHES_HYBRID", 1, False)
    assert gate(0, "OVERRIDE_TO_C2", "MEDIUM", "SUPPORTS_C2", weak) == ("REJECTED_NOT_HIGH_CONFIDENCE", 0, False)
    assert gate(0, "OVERRIDE_TO_C2", "HIGH", "NON_SPECIFIC", weak) == ("REJECTED_SPECIFICITY_MISMATCH", 0, False)
    assert gate(0, "OVERRIDE_TO_C2", "HIGH", "SUPPORTS_C2", strong) == ("REJECTED_NO_WEAK_UPSTREAM_MODEL", 0, False)
    assert gate(1, "OVERRIDE_TO_NON_C2", "HIGH", "CONTRADICTS_C2", weak) == ("STRICT_GATE_ACCEPTED_OVERRIDE", 0, True)


def test_array_summaries(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 9.0], 4.0), ([], 1.0), ([5.0], None)], "v array<double>, c double")
    got = arrays.add_summaries(df, {"s": (F.col("v"), F.col("c"))}).collect()
    s = got[0]["s"]
    assert (s["count"], s["median"], s["mean"], s["median_absolute_deviation"]) == (4, 3.0, 4.0, 1.5)
    assert s["std"] == pytest.approx(9.5**0.5) and s["coefficient_of_variation"] == pytest.approx(9.5**0.5 / 4)
    assert s["current_to_recent_median_ratio"] == pytest.approx(4 / 3)
    assert got[1]["s"] is None
    assert got[2]["s"]["coefficient_of_variation"] == 0.0 and got[2]["s"]["current"] is None


def test_no_gap_context_follows_each_summary(spark):
    df = spark.createDataFrame([([1_000_000],), ([3_000_000, 1_000_000, 9_000_000],)], "t array<long>")
    got = df.select(arrays.gaps(F.array_sort("t")).alias("g")).collect()
    assert got[0]["g"] == [] and got[1]["g"] == [2.0, 6.0]


def test_erfc(spark):
    from siftline.functions.numeric import erfc

    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.9999, 2.0, 2.0001, 2.5, 3.0, 5.0, 8.0, 20.0, 26.0, 30.0]
    out = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("y")).collect()
    for r in out:
        assert abs(r["y"] - math.erfc(r["x"])) < 1e-12 and (r["x"] > 26 or abs(r["y"] / math.erfc(r["x"]) - 1) < 1e-11)


def test_ipv6_equals_the_library(spark):
    from siftline.functions.addresses import ipv6_digits, is_public_ipv6

    rng = random.Random(9)
    pieces = ["", ":", "::", "0", "1", "fe80", "2001", "DB8", "3", "00ff", "ffff", "12345", "g", "1.2.3.4", "10.0.0.1", "256.1.1.1", "01.2.3.4", "%", "%eth0", "/64", " ", "\n"]
    texts = ["".join(rng.choice(pieces) + rng.choice([":", ":", "::", ""]) for _ in range(rng.randrange(1, 10))) for _ in range(3000)]
    for _ in range(1500):
        groups = [f"{rng.choice([0, 0, 1, 0x2001, 0x64, 0xFF9B, 0x100, 0xFC00, 0xFE80, rng.randrange(65536)]):x}" for _ in range(8)]
        cut = rng.randrange(9)
        texts += [":".join(groups), ":".join(groups[:cut]) + "::" + ":".join(groups[min(8, cut + rng.randrange(4)):])]
    import ipaddress

    blocks = ["::1", "::", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "::ffff:192.0.0.9", "64:ff9b:1::5", "100::5", "2001:1::1", "2001:1::3", "2001:3::9", "2001:20::", "2001:4:112::1", "2001:db8::1"]
    texts = sorted({*texts, *blocks, "", ":", ":::", "1::2%", "1::2%a%b", "1::2%a/3", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4"})
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    for r in df.select("ip", ipv6_digits(F.col("ip")).alias("d"), is_public_ipv6(F.col("ip")).alias("p")).collect():
        try:
            address = ipaddress.IPv6Address(r["ip"])
        except ValueError:
            assert r["d"] is None and not r["p"], r
            continue
        assert r["d"] == f"{int(address):032x}" and r["p"] == (not address.is_private and not address.is_loopback), r
