"""Sliced windows and bracketed quantiles against plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftline.operators import ordered
from siftline.operators.ordered import Ordered, bounded_broadcast, exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """3 000 rows, half of them in one key, with repeated and missing times."""
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 40, n).astype(str)),
            "t": rng.integers(0, 300, n).astype(float),
            "id": np.arange(n),
            "v": rng.integers(0, 50, n).astype(float),
        }
    )
    pdf.loc[pdf.id % 97 == 0, "t"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("t", F.when(~F.isnan("t"), F.col("t")))
    return pdf, df


def expected(pdf):
    out = pdf.sort_values(["k", "t", "id"], na_position="last").copy()
    g = out.groupby("k")["v"]
    out["pos"] = g.cumcount() + 1
    out["cum"] = g.cumsum()
    out["total"] = g.transform("sum")
    out["lagged"] = g.shift(1)
    out["mean3"] = g.transform(lambda s: s.shift(1).rolling(3, min_periods=1).mean())
    return out.sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("rows_per_slice", [None, 4, 33, 100, 5000])
def test_windows_do_not_depend_on_slicing(skewed, rows_per_slice):
    pdf, df = skewed
    o = Ordered(df, ["k"], ["t", "id"], halo=3, rows_per_slice=rows_per_slice)
    o.add({"lagged": F.lag("v").over(o.window()), "mean3": F.avg("v").over(o.window(-3, -1))})
    o.position("pos").running({"cum": F.col("v")}).totals({"total": F.col("v")})
    got = o.done()
    assert set(got.columns) == {"k", "t", "id", "v", "lagged", "mean3", "pos", "cum", "total"}
    got = got.toPandas().sort_values("id").reset_index(drop=True)
    want = expected(pdf)
    assert len(got) == len(pdf)
    for c in ("pos", "cum", "total", "lagged", "mean3"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c


def test_large_key_is_really_cut(skewed):
    _, df = skewed
    o = Ordered(df, ["k"], ["t", "id"], rows_per_slice=100)
    sizes = o.frame.groupBy("k", "__slice").count().toPandas()
    assert sizes["count"].max() <= 200
    assert (sizes.k == "hot").sum() > 8
    assert (sizes[sizes.k != "hot"].groupby("k").size() <= 2).all()


@pytest.mark.parametrize("share", [20, 100, 700])
def test_thinned_samples_give_the_same_rows(skewed, monkeypatch, share):
    """Samples above a task's share are thinned in one to three steps; windows, sums and positions stay exact."""
    pdf, df = skewed
    monkeypatch.setattr(ordered, "SAMPLE_ROWS", share)
    o = Ordered(df, ["k"], ["t", "id"], halo=3, rows_per_slice=33)
    assert o.sliced
    o.add({"lagged": F.lag("v").over(o.window()), "mean3": F.avg("v").over(o.window(-3, -1))})
    o.position("pos").running({"cum": F.col("v")}).totals({"total": F.col("v")})
    got = o.done().toPandas().sort_values("id").reset_index(drop=True)
    want = expected(pdf)
    assert len(got) == len(pdf)
    for c in ("pos", "cum", "total", "lagged", "mean3"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c
    got = Ordered(df, [], ["t", "id"], rows_per_slice=50).position("p").done().toPandas().sort_values("p")
    assert got["id"].tolist() == pdf.sort_values(["t", "id"], na_position="last")["id"].tolist()


def test_no_task_sorts_more_than_its_share(spark, monkeypatch):
    """Points of a table without keys: parts of about a share, few points at the end, slices of even size."""
    monkeypatch.setattr(ordered, "SAMPLE_ROWS", 500)
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_009).alias("v"), "id")
    o = Ordered(df, [], ["v", "id"], rows_per_slice=1000)
    sample = o.frame.select("__one_key", ordered._order_key(o.frame, o.order).alias("start"))
    points = o._points(sample, 0)
    row = points.agg(F.count("*").alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high")).first()
    assert row["n"] <= 500 and row["low"] == row["high"] == 8**3
    ranks = points.select(F.col("start.v0").alias("v")).toPandas()["v"].sort_values().to_numpy()
    assert np.abs(np.diff(ranks, prepend=0)).max() < 4000
    sizes = o.frame.groupBy("__slice").count().toPandas()["count"]
    assert 30 <= len(sizes) <= 50 and sizes.max() <= 2500


def test_global_order_without_keys(skewed):
    pdf, df = skewed
    got = Ordered(df, [], ["v", "id"], rows_per_slice=50).position("p").done().toPandas().sort_values("p")
    want = pdf.sort_values(["v", "id"])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["p"].tolist() == list(range(1, len(pdf) + 1))


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_bracketed_quantiles_are_exact(skewed, accuracy):
    pdf, df = skewed
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, ["k"], "v", probs, accuracy=accuracy).toPandas().set_index("k")["q"]
    for k, part in pdf.groupby("k"):
        assert np.allclose(got[k], np.quantile(part["v"], probs))


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    row = exact_quantiles(df, [], "v", [0.5]).first()
    assert row["q"] == [2.0] and row["n"] == 2


def test_many_cuts_are_thinned(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(ordered, "MAX_CUTS", 6)
    o = Ordered(df, ["k"], ["v", "id"], rows_per_slice=5)
    assert o.sliced and o.frame.select("k", "__slice").distinct().count() <= 6 + df.select("k").distinct().count()
    got = o.position("p").done().toPandas()
    want = pdf.sort_values(["v", "id"]).groupby("k").cumcount() + 1
    assert got.set_index("id")["p"].sort_index().tolist() == want.set_axis(pdf.loc[want.index, "id"]).sort_index().tolist()


def test_broadcast_only_within_bound(spark):
    small, large = spark.range(5), spark.range(50)
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(bounded_broadcast(small, 10)) and not hint(bounded_broadcast(large, 10))
