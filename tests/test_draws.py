"""Draws are random-like: moments, independence of bins, streams and seeds."""

import numpy as np
from pyspark.sql import functions as F

from photospark.functions import draws
from photospark.operators import learn


def test_moments_and_streams(spark):
    rows = spark.range(20_000).select(
        draws.uniform("a", 1, F.col("id")).alias("u"), draws.uniform("b", 1, F.col("id")).alias("v"), draws.uniform("a", 2, F.col("id")).alias("w"),
        draws.normal("a", 1, F.col("id")).alias("z")).toPandas()
    assert abs(rows.u.mean() - 0.5) < 0.01 and abs(rows.u.std() - 12 ** -0.5) < 0.01 and rows.u.between(0, 1, inclusive="neither").all()
    assert rows[["u", "v", "w"]].corr().abs().where(~np.eye(3, dtype=bool)).max().max() < 0.03
    assert abs(rows.z.mean()) < 0.03 and abs(rows.z.std() - 1) < 0.03 and abs((rows.z**4).mean() - 3) < 0.3


def test_noise_of_a_view_is_white(spark):
    v = [0.0] * 2000
    df = spark.createDataFrame([(i, v, v, 1.0, 3.0, 0.1) for i in range(8)],
                               "id bigint, global_view array<double>, local_view array<double>, median_flux_err double, period double, duration double")
    out = learn.augment_views(df, "id").filter("variant = 1").toPandas()
    x = np.stack([*out.global_view, *out.local_view])
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03
    for lag in range(1, 8):
        assert abs((x[:, lag:] * x[:, :-lag]).mean()) < 0.04
    assert np.abs(np.corrcoef(x) - np.eye(len(x))).max() < 0.12


def test_depth_and_place_of_a_dip_are_independent(spark):
    v = [0.0] * 300 + [-0.1]
    df = spark.createDataFrame([(i, v, v, 1e-3, 3.0, 0.1) for i in range(400)],
                               "id bigint, global_view array<double>, local_view array<double>, median_flux_err double, period double, duration double")
    out = learn.augment_views(df, "id").filter("variant >= 3").select("global_view").toPandas()
    x = np.stack(out.global_view)[:, :300]
    assert abs(np.corrcoef(x.min(axis=1), x.argmin(axis=1))[0, 1]) < 0.1


def test_another_seed_gives_other_folds_and_splits(spark):
    df = spark.range(1000).select(F.col("id").alias("tic_id"), (F.col("id") % 2).cast("int").alias("label"))
    a, b = (learn.kfold(df, 5, seed).toPandas().set_index("tic_id").fold.sort_index() for seed in (42, 43))
    together = np.equal.outer(a.to_numpy(), a.to_numpy())[np.equal.outer(b.to_numpy(), b.to_numpy())].mean()
    assert together < 0.25
    a, b = (learn.group_split(df, "tic_id", "label", seed=seed).toPandas().set_index("tic_id").split.sort_index() for seed in (42, 43))
    assert 0.38 < (a == b).mean() < 0.5
