"""The rank tree against sorting every window."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from photospark.functions.ranktree import RankTree, biweight_location
from photospark.operators import clean


def windows(n, rng):
    first = rng.integers(0, n, 60)
    return first, first + 1 + (rng.random(60) * (n - first)).astype(int)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, -1.0, 1e-9, 2.5, 1e6]) | st.floats(-1e3, 1e3), min_size=1, max_size=70), st.integers(0, 1000))
def test_order_statistics(values, seed):
    v = np.array(values)
    rng = np.random.default_rng(seed)
    tree = RankTree(v)
    first, last = windows(len(v), rng)
    k = (rng.random(60) * (last - first)).astype(int)
    assert [np.sort(v[a:b])[i] for a, b, i in zip(first, last, k, strict=True)] == tree.kth(first, last, k).tolist()
    median, deviation = tree.medians(first, last)
    want = [np.median(v[a:b]) for a, b in zip(first, last, strict=True)]
    assert median.tolist() == want
    assert np.allclose(deviation, [np.median(np.abs(v[a:b] - m)) for a, b, m in zip(first, last, want, strict=True)], rtol=1e-12, atol=0)


def test_weighted_sums_do_not_cancel():
    rng = np.random.default_rng(4)
    v = 1e4 * np.sin(np.linspace(0, 9, 500)) + rng.normal(0, 1e-4, 500)
    tree = RankTree(v)
    first, last = windows(500, rng)
    centre, scale = v[first], np.full(60, 3.0)
    weight, moment = tree.bisquare(first, last, centre, scale)
    for i in range(60):
        u = (v[first[i]:last[i]] - centre[i]) / scale[i]
        u = u[np.abs(u) < 1]
        assert weight[i] == pytest.approx(((1 - u * u) ** 2).sum(), rel=1e-10)
        assert moment[i] == pytest.approx(((1 - u * u) ** 2 * u).sum(), rel=1e-7, abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 900])
def test_both_kernels_agree(n, monkeypatch):
    rng = np.random.default_rng(n)
    times = np.sort(rng.integers(0, 10_000, n))
    values = rng.normal(0, 1, n) + (rng.random(n) < 0.1) * 40
    values[rng.random(n) < 0.3] = 0.5
    half = np.full(n, 900)
    direct = clean.sliding_biweight(times, values, half, 6, 5.0)
    assert np.allclose(direct, biweight_location(times, values, half, 6, 5.0), rtol=1e-11, atol=1e-12)
    monkeypatch.setattr(clean, "DIRECT_WINDOW", 1)
    assert np.allclose(direct, clean.sliding_biweight(times, values, half, 6, 5.0), rtol=1e-11, atol=1e-12)


def test_values_that_are_no_number_take_no_part():
    times, values = np.arange(60), np.ones(60)
    values[[5, 20]], values[[7, 30]] = np.nan, np.inf
    out = clean.sliding_biweight(times, values, np.full(60, 4), 3, 5.0)
    assert out.tolist() == [1.0] * 60
    assert np.isnan(clean.sliding_biweight(times, np.full(60, np.nan), np.full(60, 4), 3, 5.0)).all()


def test_time_per_cadence_is_nearly_flat():
    import time

    def spent(n):
        rng = np.random.default_rng(1)
        at, values = np.sort(rng.integers(0, 5 * 86_400, n)), rng.normal(1, 1e-3, n)
        start = time.process_time()
        biweight_location(at, values, np.full(n, 32_400), 6, 5.0)
        return (time.process_time() - start) / n

    spent(3000)
    assert spent(30_000) < 4 * spent(3000)
