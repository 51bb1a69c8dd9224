"""Order statistics and running totals: the way for large groups gives the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from photospark.plans.groups import group_quantiles, split_by_size, with_group_median
from photospark.plans.lineage import pin
from photospark.plans.prefix import ordinal, prefix_sum, range_cells


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    parts = [
        pd.DataFrame({"k": 1, "x": rng.normal(1, 0.01, 6001)}),
        pd.DataFrame({"k": 2, "x": rng.exponential(1, 40)}),
        pd.DataFrame({"k": 3, "x": np.repeat([1.0, 2.0, 3.0], [2500, 10, 2500])}),
        pd.DataFrame({"k": 4, "x": np.concatenate([rng.normal(0, 1e-6, 4000), [1e9]])}),
    ]
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("max_rows", [10_000_000, 700])
def test_group_quantiles_exact(spark, values, max_rows):
    df = spark.createDataFrame(values).repartition(5)
    x = F.col("x")
    got = group_quantiles(df, ["k"], {"m": (x, 0.5), "q": (x, 0.84)}, max_rows).toPandas().set_index("k")
    for k, part in values.groupby("k"):
        assert got.loc[k, "m"] == pytest.approx(np.percentile(part.x, 50), abs=1e-12)
        assert got.loc[k, "q"] == pytest.approx(np.percentile(part.x, 84), abs=1e-12)


@pytest.mark.parametrize("max_rows", [10_000, 2])
def test_group_quantiles_of_infinite_values(spark, max_rows):
    rows = [(1, v) for v in (1.0, np.inf, np.inf)] + [(2, v) for v in (-np.inf, -np.inf, 5.0, 7.0)] + [(3, v) for v in (1.0, 2.0, np.inf)]
    got = group_quantiles(spark.createDataFrame(rows, "k int, x double"), ["k"], {"m": (F.col("x"), 0.5)}, max_rows).collect()
    assert {r.k: r.m for r in got} == {1: np.inf, 2: -np.inf, 3: 2.0}


def test_split_by_size(spark, values):
    df = spark.createDataFrame(values)
    small, large, keys = split_by_size(df, ["k"], 100)
    assert {r.k for r in keys.collect()} == {1, 3, 4}
    assert {r.k for r in small.select("k").distinct().collect()} == {2}
    assert {r.k for r in large.select("k").distinct().collect()} == {1, 3, 4}
    assert small.count() + large.count() == len(values)
    assert split_by_size(df, ["k"])[1] is None


def test_with_group_median_both_ways(spark, values):
    df = spark.createDataFrame(values)
    a = with_group_median(df, ["k"], {"m": F.col("x")}).groupBy("k").agg(F.first("m").alias("m"), F.count("*").alias("n"))
    b = with_group_median(df, ["k"], {"m": F.col("x")}, 700).groupBy("k").agg(F.first("m").alias("m"), F.count("*").alias("n"))
    a, b = a.toPandas().set_index("k").sort_index(), b.toPandas().set_index("k").sort_index()
    assert np.allclose(a.m, b.m) and (a.n == b.n).all()


def test_prefix_sum_and_ordinal_match_window(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": rng.choice([1, 2], 3000, p=[0.9, 0.1]), "s": rng.random(3000).round(3), "i": range(3000)})
    df = spark.createDataFrame(frame)
    celled = range_cells(df, [F.col("g"), F.col("s")], "c", 16)
    got = ordinal(celled, ["g"], F.col("c"), [F.col("s"), F.col("i")], "pos").toPandas()
    want = frame.sort_values(["g", "s", "i"]).assign(pos=lambda d: d.groupby("g").cumcount() + 1)
    merged = got.merge(want, on="i")
    assert (merged.pos_x == merged.pos_y).all()
    total = prefix_sum(celled, ["g"], F.col("c"), [F.col("s"), F.col("i")], {"t": F.lit(2)}).toPandas().merge(want, on="i")
    assert (total.t == (total.pos - 1) * 2).all()


def test_pin_uses_checkpoint_folder(spark):
    df = pin(spark.range(5).withColumn("x", F.rand(1)))
    assert df.count() == 5
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.checkpoint.dir").split(":")[-1] in spark.sparkContext.getCheckpointDir()


def test_group_quantiles_repeated_values_take_few_passes(spark, monkeypatch):
    """Values that repeat more often than ``max_rows`` and values of any size are found within a few passes."""
    from photospark.plans import groups

    rng = np.random.default_rng(5)
    ties = np.repeat(np.round(1 + rng.random(400), 4), 60)
    wide = np.concatenate([-(10.0 ** rng.uniform(-300, 300, 900)), 10.0 ** rng.uniform(-300, 300, 1100), [np.inf, -np.inf, 0.0]])
    frame = pd.concat([pd.DataFrame({"k": k, "x": x}) for k, x in ((1, ties), (2, wide), (3, np.full(300, 2.5)))], ignore_index=True)
    passes = []
    monkeypatch.setattr(groups, "pin", lambda df: passes.append(1) or pin(df))
    got = group_quantiles(spark.createDataFrame(frame), ["k"], {"q": (F.col("x"), 0.3)}, 20).toPandas().set_index("k").q
    for k, part in frame.groupby("k"):
        assert got[k] == pytest.approx(np.percentile(part.x, 30), rel=1e-12)
    assert len(passes) <= 8
