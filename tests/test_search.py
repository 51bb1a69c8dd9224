"""Period search, both ways, against injected signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import cand_df, series_df, series_frame, transit_curve
from photospark.operators import recovery, search
from photospark.schema import DAY_US

GRID = search.linear_period_grid(int(0.5 * DAY_US), int(12 * DAY_US), 1500)
DURATIONS = [int(0.15 * DAY_US)]


def test_grids():
    f = search.period_grid(27.0, 0.15)
    assert f[0] == int(0.5 * DAY_US) and f[-1] == 30 * DAY_US and (np.diff(f) > 0).all()
    drift = np.diff(f) / f[:-1] * 27.0
    assert drift.max() <= 0.15 / 2 + 1e-6
    assert search.linear_period_grid(10, 20, 11).tolist() == list(range(10, 21))


def test_fold_tree_equals_folding_at_each_drift():
    rng = np.random.default_rng(1)
    for cycles, bins in ((1, 5), (2, 7), (8, 6), (32, 11)):
        rows = rng.normal(size=(2, cycles, bins))
        got = search.fold_tree(rows)
        levels = cycles.bit_length() - 1
        for j in range(cycles):
            want = np.zeros((2, bins))
            for r in range(cycles):
                shift = sum((r >> (level - 1) & 1) * (((j >> (levels - level)) + 1) >> 1) for level in range(1, levels + 1))
                assert abs(shift - j * r / max(1, cycles - 1)) <= levels / 2 + 0.5
                want += np.roll(rows[:, r], -shift, axis=-1)
            assert np.allclose(got[:, j], want)


def test_frequency_grid():
    f = 1 / (search.frequency_grid(27.0, 0.1) / DAY_US)
    assert np.allclose([f.max(), f.min()], [2.0, 1 / 30]) and np.allclose(np.diff(f), np.diff(f)[0], rtol=1e-3)
    assert -np.diff(f)[0] * 30 * 27 <= 0.1 / 2 + 1e-9


def test_search_without_a_grid(spark, deep):
    found = {r.tic_id: r for r in search.period_search(deep).collect()}
    assert sorted(found) == [1, 2]
    r = found[1]
    assert r.period == pytest.approx(3.0, rel=0.01) and r.sde > 7 and r.depth == pytest.approx(0.01, rel=0.3)
    assert abs((r.t0 - 1.5 + 1.5) % 3.0 - 1.5) < 0.1 and r.duration in (0.1, 0.2)
    assert found[2].sde < r.sde
    assert search.fast_periodogram(deep.filter("tic_id = 9")).count() == 0
    with pytest.raises(Exception, match="bins of"):
        search.fast_periodogram(deep, max_bins=10).count()


@pytest.fixture(scope="module")
def deep(spark):
    return series_df(spark, transit_curve(), transit_curve(tic=2, seed=7, depth=0.0), series_frame(np.linspace(0, 1, 50), np.ones(50), tic=3)).cache()


def test_period_search_recovers(spark, deep):
    found = {r.tic_id: r for r in search.period_search(deep, GRID, DURATIONS).collect()}
    assert 3 not in found
    r = found[1]
    assert r.period == pytest.approx(3.0, rel=0.05) and r.sde > 5 and r.snr > 5
    assert r.depth == pytest.approx(0.01, rel=0.2)
    assert abs((r.t0 - 1.5 + 1.5) % 3.0 - 1.5) < 0.1
    assert found[2].sde < r.sde


def test_large_series_give_the_same_search(spark, deep):
    small = search.period_search(deep, GRID[::5], DURATIONS).toPandas().sort_values("tic_id").reset_index(drop=True)
    large = search.period_search(deep, GRID[::5], DURATIONS, max_rows=500).toPandas().sort_values("tic_id").reset_index(drop=True)
    for c in small.columns:
        assert np.allclose(small[c].astype(float), large[c].astype(float), rtol=1e-8), c


def test_blocks_do_not_matter(spark, deep):
    a = search.box_periodogram(deep, GRID[:50], DURATIONS, blocks=1).toPandas().sort_values(["tic_id", "period_us"])
    b = search.box_periodogram(deep, GRID[:50], DURATIONS, blocks=7).toPandas().sort_values(["tic_id", "period_us"])
    assert np.allclose(a.power, b.power)


def test_multi_search_two_planets_and_both_ways(spark):
    f = transit_curve(n=4000, noise=3e-4)
    phase = (f.time - 2.3 + 2.6) % 5.2 - 2.6
    f.loc[np.abs(phase) < 0.1, "flux"] -= 0.006
    df = series_df(spark, f)
    small = search.multi_search(df, GRID, DURATIONS).orderBy("planet_num").toPandas()
    assert list(small.planet_num) == list(range(1, len(small) + 1)) and len(small) >= 2
    assert small.period[0] == pytest.approx(3.0, rel=0.01) and small.period[1] == pytest.approx(5.2, rel=0.01)
    large = search.multi_search(df, GRID, DURATIONS, max_rows=500).orderBy("planet_num").toPandas()
    assert np.allclose(small.period, large.period) and np.allclose(small.sde, large.sde, rtol=1e-3)


def test_gap_mask_is_left_out(spark, deep):
    flagged = deep.withColumn("gap_mask", F.col("time") < 29.0)
    assert search.period_search(flagged, GRID[::50], DURATIONS).filter("tic_id = 1").count() == 1
    assert search.period_search(flagged, GRID[::50], DURATIONS, min_points=200).count() == 0


def test_search_batch_skips_done(spark, deep):
    done = spark.createDataFrame([(1, 1)], "tic_id bigint, sector int")
    assert {r.tic_id for r in search.search_batch(deep, done, GRID[::20], DURATIONS, rounds=1).collect()} == {2}


@pytest.mark.parametrize("max_rows", [1_000_000, 500])
def test_bls_consistent(spark, max_rows):
    df = series_df(spark, transit_curve(n=2000, depth=0.005, noise=1e-3))
    cands = cand_df(spark, [(1, 1, 1, 3.0, 1.5, 0.15, 0.005, 9.0, 9.0), (1, 1, 2, 3.1, 1.5, 0.15, 0.005, 9.0, 9.0), (9, 1, 1, 3.0, 1.5, 0.15, 0.005, 9.0, 9.0)])
    got = {(r.tic_id, r.planet_num): r for r in search.bls_consistent(cands, df, max_rows=max_rows).collect()}
    assert got[(1, 1)].bls_consistent and not got[(1, 2)].bls_consistent and not got[(9, 1)].bls_consistent
    assert got[(1, 2)].best_period == pytest.approx(3.0, rel=0.01)


def test_sde_gate(spark):
    rows = spark.createDataFrame([(8.5,), (7.0,), (6.0,), (5.0,), (3.5,), (float("nan"),)], "sde double")
    got = [r.disposition for r in search.sde_gate(rows).collect()]
    assert got == ["FULL_PIPELINE", "FULL_PIPELINE", "SUB_THRESHOLD", "SUB_THRESHOLD", "DISCARD", "FULL_PIPELINE"]
    flagged = rows.withColumn("bls_consistent", F.lit(None).cast("boolean"))
    assert not any(r.bls_consistent for r in search.sde_gate(flagged).collect())


def test_completeness_map(spark, deep):
    out = recovery.completeness_map(deep.filter("tic_id <> 3"), GRID, [int(0.1 * DAY_US)], [50.0, 20000.0], [2.0, 4.5], 2).toPandas()
    assert len(out) == 4 and (out.trials == 2).all()
    assert out[out.depth_ppm == 20000.0].fraction.mean() > out[out.depth_ppm == 50.0].fraction.mean()


def test_template_fit_recovers_depth(spark):
    n = 2001
    phase = -0.5 + (np.arange(n) + 0.5) / n
    flux = 1 - 0.01 * recovery.trapezoid(phase, 0.0, 0.03, 0.3)
    views = spark.createDataFrame([(1, 1, 1, [float(x) for x in flux])], "tic_id bigint, sector int, planet_num int, global_view array<double>")
    cands = cand_df(spark, [(1, 1, 1, 2.0, 0.0, 0.12, 0.01, 9.0, 9.0)])
    fit = recovery.template_fit(views, cands).first()
    assert fit.depth == pytest.approx(0.01, rel=0.1) and fit.rp_rs == pytest.approx(0.1, rel=0.1) and fit.chi2_red < 5
    assert fit.duration == pytest.approx(0.12) and fit.ingress == pytest.approx(0.3)
