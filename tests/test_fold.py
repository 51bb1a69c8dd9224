"""Folding and features against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import cand_df, series_df, transit_curve
from photospark.operators import features, fold


def numpy_fold(time, flux, period, t0, duration, ng, nl, flip=False):
    phase = ((time - t0) % period) / period
    phase[phase > 0.5] -= 1
    hw = min(2 * duration / period, 0.25)
    out = []
    for low, high, n in ((-0.5, 0.5, ng), (-hw, hw, nl)):
        index = np.floor((phase - low) / (high - low) * n).astype(int)
        view = np.array([
            np.median(flux[(index == i) & (phase < high)]) if ((index == i) & (phase < high)).any() else 0.0 for i in range(n)
        ])
        view = view - np.median(view)
        if view.min() < -1e-10:
            view = view / abs(view.min())
        elif flip and view.min() > 1e-10:
            view = -view / abs(view.min())
        out.append(view)
    return out


@pytest.mark.parametrize("max_rows", [1_000_000, 300])
def test_phase_fold_matches_numpy(spark, max_rows):
    f = transit_curve(n=1500)
    cands = cand_df(spark, [(1, 1, 1, 3.0, 1.5, 0.15, 0.01, 9.0, 9.0), (1, 1, 2, 2.2, 1.0, 0.1, 0.01, 6.0, 9.0), (1, 1, 3, 2.2, 1.0, 0.1, 0.01, 4.0, 9.0)])
    got = {r.planet_num: r for r in fold.phase_fold(series_df(spark, f), cands, 101, 21, max_rows=max_rows).collect()}
    assert set(got) == {1, 2}
    for n, (p, t0, d) in {1: (3.0, 1.5, 0.15), 2: (2.2, 1.0, 0.1)}.items():
        g, v = numpy_fold(f.time.to_numpy(), f.flux.to_numpy(), p, t0, d, 101, 21)
        assert np.allclose(got[n].global_view, g) and np.allclose(got[n].local_view, v)
    assert min(got[1].global_view) == -1.0 and np.median(got[1].global_view) == pytest.approx(0.0)


@pytest.mark.parametrize("empty, expected", [("zero", 0.0), ("null", None), ("median", 2.0)])
def test_empty_bins(spark, empty, expected):
    bins = spark.createDataFrame([(1, "global", 1, 2.0), (1, "local", 0, 2.0)], "k bigint, view string, bin int, value double")
    packed = bins.groupBy("k").agg(F.array_sort(F.collect_list(F.when(F.col("view") == "global", F.struct("bin", "value")))).alias("e"))
    assert packed.select(fold._view(F.col("e"), 4, empty).alias("v")).first().v == [expected, 2.0, expected, expected]


def test_normalise_edges(spark):
    rows = [([1.0, 1.0, 0.5, 1.0],), ([1.0] * 4,), ([0.0] * 4,), ([float("nan"), 1.0, 1.0, 0.5],)]
    got = [r.n for r in spark.createDataFrame(rows, "v array<double>").select(fold.normalise_view(F.col("v")).alias("n")).collect()]
    assert got[0] == [0.0, 0.0, -1.0, 0.0] and got[1] == [0.0] * 4 and got[2] == [0.0] * 4
    assert min(got[3]) == -1.0


def test_shift_view(spark):
    v = F.array(*[F.lit(float(i)) for i in range(5)])
    row = spark.range(1).select(*[fold.shift_view(v, F.lit(k)).alias(n) for n, k in (("a", 2), ("b", -2), ("c", 0))]).first()
    assert row.a == [0, 0, 0, 1, 2] and row.b == [2, 3, 4, 4, 4] and row.c == [0, 1, 2, 3, 4]


def test_v_shape_and_secondary(spark):
    box = [0.0] * 8 + [-1.0] * 4 + [0.0] * 8
    vee = [0.0] * 6 + [-0.25, -0.5, -0.75, -1.0, -1.0, -0.75, -0.5, -0.25] + [0.0] * 6
    rows = [(box,), (vee,), ([0.0] * 20,), ([1.0] * 20,)]
    df = spark.createDataFrame(rows, "v array<double>")

    def plain(v):
        v = np.array(v)
        depth = 1 - v.min()
        if depth < 1e-5:
            return 0.0
        below = np.where(v < 1 - depth / 2)[0]
        if len(below) == 0:
            return 1.0
        return 1 - (v < v.min() + 0.1 * depth).sum() / (below[-1] - below[0] + 1)

    got = [r[0] for r in df.select(features.v_shape(F.col("v"))).collect()]
    assert got == pytest.approx([plain(r[0]) for r in rows])
    eclipse = spark.createDataFrame([([-0.5] * 5 + [0.0] * 90 + [-0.5] * 5,)], "v array<double>")
    assert eclipse.select(features.secondary_depth(F.col("v"))).first()[0] == 0.5


def test_odd_even_difference(spark):
    f = transit_curve(n=6000, depth=0.0, noise=1e-3)
    k = np.round((f.time - 1.5) / 3.0).astype(int)
    near = np.abs(f.time - 1.5 - 3.0 * k) < 0.07
    f.loc[near, "flux"] -= np.where(k[near] % 2 == 1, 0.01, 0.005)
    cands = cand_df(spark, [(1, 1, 1, 3.0, 1.5, 0.14, 0.01, 9.0, 9.0), (5, 1, 1, 3.0, 1.5, 0.14, 0.01, 9.0, 9.0)])
    got = {r.tic_id: r.odd_even_depth_diff for r in features.odd_even_sigma(series_df(spark, f), cands).collect()}
    assert got[1] > 10 and got[5] == 0.0


def test_extract_features_defaults(spark):
    cands = cand_df(spark, [(1, 1, 1, 3.0, 1.5, 0.15, 0.01, 9.0, 12.0), (2, 1, 1, 3.0, 1.5, 0.15, 0.01, 4.0, 12.0)])
    df = series_df(spark, transit_curve(n=1500))
    none = fold.phase_fold(df, cands, 101, 21).limit(0)
    rows = features.extract_features(cands, df, none).collect()
    assert len(rows) == 1 and rows[0].v_shape_metric == 0.0 and rows[0].crowdsap == 1.0 and rows[0].duration_period_ratio == pytest.approx(0.05)
    assert set(features.FEATURE_COLUMNS) <= set(rows[0].asDict())


def test_transit_epochs(spark):
    df = series_df(spark, transit_curve(n=300, span=10.0))
    cands = cand_df(spark, [(1, 1, 1, 3.0, 1.5, 0.1, 0.1, 9.0, 9.0), (1, 1, 2, 50.0, 20.0, 0.1, 0.1, 9.0, 9.0)])
    got = features.transit_epochs(df, cands).toPandas()
    assert sorted(got.epoch_time) == [1.5, 4.5, 7.5] and (got.planet_num == 1).all()


def test_centroid_shift(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(200):
        time = c * 0.05
        inside = min((time % 2.0), 2.0 - time % 2.0) < 0.1
        for r in range(3):
            for k in range(3):
                base = 10.0 + rng.normal(0, 0.01) + (5.0 if inside and k == 2 else 0.0)
                rows.append((1, 1, c, float(time), r, k, float(base)))
    pixels = spark.createDataFrame(rows, "tic_id bigint, sector int, cadence bigint, time double, row int, col int, flux double")
    cands = cand_df(spark, [(1, 1, 1, 2.0, 0.0, 0.2, 0.01, 9.0, 9.0), (2, 1, 1, 2.0, 0.0, 0.2, 0.01, 8.0, 9.0), (3, 1, 1, 2.0, 0.0, 0.2, 0.01, 6.0, 9.0)])
    got = {r.tic_id: r for r in features.centroid_shift(pixels, cands).collect()}
    assert set(got) == {1, 2} and got[1].blend and not got[2].blend and got[2].centroid_shift_sigma == 0.0
    again = cands.withColumn("centroid_computed", F.col("tic_id") == 1)
    assert {r.tic_id for r in features.centroid_shift(pixels, again).collect()} == {2}


def test_training_views(spark):
    events = spark.createDataFrame(
        [(1, 1, 3.0, 1.5, 0.15, "PC"), (1, 2, 3.0, 1.5, 0.15, ""), (1, 3, 0.0, 1.5, 0.15, "PC"), (9, 4, 3.0, 1.5, 0.15, "EB")],
        "tic_id bigint, event_id bigint, period double, t0 double, duration double, label_text string",
    )
    out = fold.build_training_views(events, series_df(spark, transit_curve(n=1500)), n_global=51, n_local=11).collect()
    assert [(r.event_id, r.label) for r in out] == [(1, 0)]
