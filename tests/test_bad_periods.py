"""A candidate without a usable period gets a defined result and does not end the job."""

import math

import pytest
from helpers import cand_df, series_df, transit_curve

from photospark.operators import clean, features, search


@pytest.fixture(scope="module")
def inputs(spark):
    rows = [(1, 1, i, p, 1.5, 0.15, 0.01, 8.0, 9.0) for i, p in enumerate([3.0, 0.0, -2.0, math.nan, math.inf, None], 1)]
    return series_df(spark, transit_curve()), cand_df(spark, rows)


@pytest.mark.parametrize("max_rows", [None, 100])
def test_bad_periods(inputs, max_rows):
    series, cands = inputs
    found = {r.planet_num: r for r in search.bls_consistent(cands, series, n_periods=50, max_rows=max_rows).collect()}
    assert found[1].bls_consistent and not any(found[i].bls_consistent for i in range(2, 7))
    depth = {r.planet_num: r.odd_even_depth_diff for r in features.odd_even_sigma(series, cands, max_rows=max_rows).collect()}
    assert all(depth[i] == 0.0 for i in range(2, 7))
    kept = {r.planet_num: r.preserved for r in clean.transit_preserved(series, cands, max_rows=max_rows).collect()}
    assert kept[1] and not any(kept[i] for i in range(2, 7))


def test_epochs_and_masks(inputs):
    series, cands = inputs
    assert {r.planet_num for r in features.transit_epochs(series, cands).collect()} == {1}
    assert clean.mask_transits(series, cands).filter("flux = 1.0").count() > 0


def test_both_ways_agree_where_the_duration_fills_the_period(spark):
    series = series_df(spark, transit_curve(n=900, period=1.0, duration=0.4))
    cands = cand_df(spark, [(1, 1, 1, 1.0, 0.5, 1.2, 0.01, 8.0, 9.0), (1, 1, 2, 2.0, 0.5, 2.0, 0.01, 8.0, 9.0), (1, 1, 3, 3.0, 0.5, 0.2, 0.01, 8.0, 9.0)])
    ways = [
        sorted((r.planet_num, r.best_period) for r in search.bls_consistent(cands, series, n_periods=60, max_rows=m).collect()) for m in (None, 50)
    ]
    assert ways[0] == ways[1]
