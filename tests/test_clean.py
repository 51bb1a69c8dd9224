"""Cleaning operators on small synthetic series."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import cand_df, series_df, series_frame, transit_curve
from photospark.functions.ranktree import biweight_location
from photospark.functions import rules
from photospark.operators import clean


def test_quality_mask(spark):
    f = series_frame([0, 1, 2, 3, 4], [1, np.nan, 1, 1, 1])
    f.loc[2, "flux_err"] = np.nan
    f.loc[3, "quality"] = 128
    f.loc[4, "quality"] = 16
    assert sorted(r.time for r in clean.quality_mask(series_df(spark, f)).collect()) == [0.0, 4.0]
    assert clean.quality_mask(series_df(spark, f).drop("quality")).count() == 3


@pytest.mark.parametrize("max_rows", [1_000_000, 300])
def test_sigma_clip_and_normalise(spark, max_rows):
    rng = np.random.default_rng(0)
    flux = 10 + rng.normal(0, 0.01, 2000)
    flux[500], flux[900] = 100.0, 10.4
    df = series_df(spark, series_frame(np.linspace(0, 27, 2000), flux), series_frame(np.arange(50.0), np.ones(50), tic=2))
    kept = clean.sigma_clip(df, max_rows=max_rows)
    left = kept.filter("tic_id = 1").toPandas()
    expected = np.asarray(flux)
    for _ in range(5):
        expected = expected[~(np.abs(expected - np.median(expected)) > 5 * expected.std())]
    assert sorted(left.flux) == sorted(expected) and left.flux.max() < 10.2
    normal = clean.median_normalise(kept, max_rows=max_rows).filter("tic_id = 1").toPandas()
    assert np.median(normal.flux) == pytest.approx(1.0)
    assert normal.flux_err.iloc[0] == pytest.approx(5e-4 / np.median(expected))


def test_normalise_keeps_zero_series(spark):
    out = clean.median_normalise(series_df(spark, series_frame([0, 1, 2], [0, 0, 0])))
    assert [r.flux for r in out.collect()] == [0.0, 0.0, 0.0]


def test_gaps_and_edges(spark):
    time = np.concatenate([np.linspace(0, 5, 500), np.linspace(19, 27, 500)])
    df = series_df(spark, series_frame(time, np.ones(1000)), series_frame([3.0], [1.0], tic=2))
    gaps = clean.find_gaps(df).collect()
    assert [(g.tic_id, g.gap_start, g.gap_end) for g in gaps] == [(1, 5.0, 19.0)]
    marked = clean.mark_gap_edges(df, clean.find_gaps(df)).toPandas()
    assert len(marked) == 1001
    near = ((marked.time >= 4.5) & (marked.time <= 19.5) & (marked.tic_id == 1))
    assert (marked.gap_mask == near).all()


def test_gaps_against_brute_force(spark):
    rng = np.random.default_rng(5)
    time = np.sort(rng.uniform(0, 30, 700))
    df = series_df(spark, series_frame(time, np.ones(700)))
    got = sorted((g.gap_start, g.gap_end) for g in clean.find_gaps(df, 0.1).collect())
    d = np.diff(time)
    assert got == [(time[i], time[i + 1]) for i in np.where(d > 0.1)[0]]
    marked = clean.mark_gap_edges(df, clean.find_gaps(df, 0.1), 0.2).toPandas().sort_values("time")
    want = np.zeros(700, bool)
    for a, b in got:
        want |= (time >= a - 0.2) & (time <= b + 0.2)
    assert (marked.gap_mask.to_numpy() == want).all()


def test_biweight_removes_slow_variation_and_ignores_chunks(spark):
    rng = np.random.default_rng(2)
    time = np.linspace(0, 27, 2000)
    flux = 1 + 0.05 * np.sin(0.5 * time) + rng.normal(0, 1e-3, 2000)
    df = series_df(spark, series_frame(time, flux))
    a = clean.biweight_detrend(df).toPandas().sort_values("time_us")
    assert len(a) == 2000 and a.flux.std() < flux.std() / 10
    b = clean.biweight_detrend(df, chunk_days=30.0).toPandas().sort_values("time_us")
    assert np.allclose(a.trend, b.trend)


def test_biweight_short_span(spark):
    rng = np.random.default_rng(2)
    df = series_df(spark, series_frame(np.linspace(0, 0.5, 100), 1 + rng.normal(0, 1e-3, 100)))
    out = clean.biweight_detrend(df).toPandas()
    assert len(out) == 100 and abs(out.flux.median() - 1) < 0.01


def test_transit_preserved(spark):
    df = series_df(spark, transit_curve(duration=0.125, depth=0.005, noise=2e-4), transit_curve(depth=0.0, tic=2))
    cands = cand_df(spark, [
        (1, 1, 1, 3.0, 1.5, 0.125, 0.005, 9.0, 9.0), (2, 1, 1, 5.0, 1.5, 0.125, 0.005, 9.0, 9.0), (3, 1, 1, 5.0, 1.5, 0.125, 0.005, 9.0, 9.0),
    ])
    got = {r.tic_id: r.preserved for r in clean.transit_preserved(df, cands).collect()}
    assert got == {1: True, 2: False, 3: False}
    flat = clean.biweight_detrend(df.filter("tic_id = 1"))
    assert clean.transit_preserved(flat, cands.filter("tic_id = 1")).first().preserved


def test_preprocess_statuses(spark):
    df = series_df(
        spark, transit_curve(n=2000, depth=0.001, tic=1), transit_curve(n=2000, depth=0.001, tic=2), series_frame(np.linspace(0, 1, 100), np.ones(100), tic=3),
    )
    meta = spark.createDataFrame([(1, 1, 10.0), (2, 1, 5.0), (3, 1, None), (4, 1, 9.0)], "tic_id bigint, sector int, tmag double")
    curves, status = clean.preprocess(df, meta)
    got = {r.tic_id: (r.status, r.n_cadences, r.n_gaps) for r in status.collect()}
    assert got == {
        1: ("PREPROCESSED", 2000, 0), 2: ("SATURATED", None, None), 3: ("TOO_FEW_CADENCES", None, None), 4: ("MISSING_RAW", None, None),
    }
    assert {r.tic_id for r in curves.select("tic_id").distinct().collect()} == {1}


@pytest.mark.parametrize("max_rows", [None, 1_000_000, 500])
def test_preprocess_ways_agree_and_a_broken_series_is_told(spark, max_rows):
    broken = transit_curve(n=700, tic=5).assign(time_us=0)
    gappy = transit_curve(n=1500, tic=2)
    gappy = gappy[(gappy.time < 8) | (gappy.time > 11)]
    df = series_df(spark, transit_curve(n=1200, tic=1), gappy, transit_curve(n=330, tic=3), broken)
    meta = spark.createDataFrame([(t, 1, 10.0) for t in range(1, 7)] + [(1, 1, 3.0)], "tic_id bigint, sector int, tmag double")
    if max_rows == 500:  # the step-by-step way has no kernel that could fail
        df, meta = df.filter("tic_id < 5"), meta.filter("tic_id <> 5")
    curves, status = clean.preprocess(df, meta, min_cadences=200, max_rows=max_rows)
    got = sorted((r.tic_id, r.status, r.n_cadences, r.n_gaps) for r in status.collect())
    n = int(((gappy.time < 7.5) | (gappy.time > 11.5)).sum())
    want = [(1, "PREPROCESSED", 1200, 0), (1, "SATURATED", None, None), (2, "PREPROCESSED", n, 1), (3, "PREPROCESSED", 330, 0),
            (4, "MISSING_RAW", None, None), (5, "ERROR: 699 of 700 cadences have two different times", None, None), (6, "MISSING_RAW", None, None)]
    assert [g[:2] for g in got] == [w[:2] for w in want if max_rows != 500 or w[0] != 5]
    assert abs(dict((g[0], g[2]) for g in got)[2] - n) <= 2
    rows = curves.toPandas().sort_values(["tic_id", "time_us"])
    assert set(rows.tic_id) == {1, 2, 3} and rows.columns.tolist() == [*df.columns, "flux_norm", "trend"]
    assert rows.trend.between(0.98, 1.02).all() and np.allclose(rows.flux * rows.trend / rows.flux_norm, 1, atol=0.02)


def odd_series(spark):
    """Series and stars that are broken, bright, unsorted, without key, without times, infinite, flagged or listed twice."""
    def curve(tic, n=300, span=6.0, **changes):
        return transit_curve(n=n, tic=tic, span=span, seed=tic).assign(**changes)

    frames = {t: curve(t) for t in range(1, 17)}
    gappy = curve(6, 400, 8.0)
    frames[6] = gappy[(gappy.time < 3) | (gappy.time > 4.5)].sample(frac=1, random_state=1)
    frames[2]["time"] += 1.0
    frames[3].loc[7, "time"] = np.inf
    frames[4].loc[:5, "flux"] = np.nan
    frames[5]["time"] += np.random.default_rng(0).uniform(-0.4, 0.4, 300) / 86_400  # within the slack, so out of order
    frames[7].loc[10:12, "flux"] = np.inf
    frames[8].loc[:200, ["flux", "flux_err"]] = np.inf
    frames[9]["flux"] = np.repeat([-np.inf, np.inf], 150)
    frames[10] = pd.concat([frames[10]] * 2)
    frames[11]["quality"] = 128
    frames[12].loc[::37, "flux"] *= 1.5
    frames[14]["flux"] *= -1
    df = series_df(spark, *frames.values()).withColumns({
        "tic_id": F.when(F.col("tic_id") != 13, F.col("tic_id")), "flux_err": F.col("flux_err").cast("float"),
        "time_us": F.when(~((F.col("tic_id") == 15) & (F.col("time_us") % 3 == 0)), F.col("time_us")),
        "exact": F.when(F.col("time_us") % 2 == 0, F.lit(2**60 + 1) + F.col("time_us")), "at": F.timestamp_micros("time_us"),
        "odd": F.when(F.col("time_us") % 3 == 0, float("nan")).otherwise(1.0), "held": F.array(F.struct(F.timestamp_micros("time_us").alias("at"))), "note": F.concat(F.lit("n"), F.col("time_us")),
    })
    tmags = [(t, 1, 10.0) for t in (1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 14, 15)]
    tmags += [(None, 1, 9.0), (None, 1, 3.0), (1, 1, 3.0), (1, 1, float("nan")), (5, 1, None), (99, 1, 5.0), (2, 1, 3.0)]
    return df, spark.createDataFrame(tmags, "tic_id int, sector int, tmag double")


@pytest.mark.parametrize("min_cadences, options", [(100, {}), (0, {"gap_threshold": 0.05, "edge_days": 0.02})])
def test_preprocess_rows_do_not_depend_on_the_length_of_a_series(spark, min_cadences, options):
    """A series taken step by step has the rows, errors included, and the types of one taken by the kernel."""
    df, meta = odd_series(spark)

    def rows(max_rows):
        found = clean.preprocess_rows(df, meta, min_cadences=min_cadences, max_rows=max_rows, **options)
        told = found.filter("status is not null").select("tic_id", "status", "n_cadences", "n_gaps", "median_flux_err")
        curves = found.filter("status is null").toPandas()
        return (
            found.schema.simpleString(), sorted(told.collect(), key=repr),
            curves.sort_values(["tic_id", "time_us", "time", "flux_norm"]).reset_index(drop=True),
        )

    kinds, told, curves = rows(None)
    other_kinds, other_told, other_curves = rows(50)
    assert other_kinds == kinds and other_told == told
    pd.testing.assert_frame_equal(other_curves, curves, rtol=1e-9)
    status = {}
    for row in told:
        status.setdefault(row.tic_id, []).append(row.status)
    assert status[2] == ["ERROR: 300 of 300 cadences have two different times"] * 2
    assert status[3] == ["ERROR: 1 of 300 cadences have two different times"]
    assert status[11] == ["TOO_FEW_CADENCES" if min_cadences else "ERROR: no cadence is left"]
    assert sorted(status[None]) == ["PREPROCESSED", "SATURATED"] and status[99] == ["MISSING_RAW"]
    assert set(curves.tic_id.dropna()) == {t for t, s in status.items() if t is not None and "PREPROCESSED" in s} >= {1, 5, 6, 15, 16}


def test_preprocess_of_broken_long_series_only(spark):
    df = series_df(spark, transit_curve(n=700, tic=5).assign(time_us=0))
    meta = spark.createDataFrame([(6, 1, 10.0)], "tic_id bigint, sector int, tmag double")
    curves, status = clean.preprocess(df, meta, max_rows=500)
    assert sorted((r.tic_id, r.status) for r in status.collect()) == [(5, "ERROR: 699 of 700 cadences have two different times"), (6, "MISSING_RAW")]
    assert curves.count() == 0


def test_long_series_that_can_not_be_detrended_is_told(spark, monkeypatch):
    whole = clean.sliding_biweight

    def failing(times, values, *rest):
        if values.max() > 1.5:
            raise ValueError("too bright")
        return whole(times, values, *rest)

    monkeypatch.setattr(clean, "sliding_biweight", failing)
    bright = transit_curve(n=700, tic=2)
    bright.loc[350:, "flux"] *= 8.0
    df = series_df(spark, transit_curve(n=700, tic=1), bright)
    meta = spark.createDataFrame([(1, 1, 10.0), (2, 1, 9.0), (2, 1, 3.0)], "tic_id bigint, sector int, tmag double")
    curves, status = clean.preprocess(df, meta, max_rows=500)
    assert sorted((r.tic_id, r.status, r.n_cadences) for r in status.collect()) == [(1, "PREPROCESSED", 700)] + [(2, "ERROR: too bright", None)] * 2
    assert {r.tic_id for r in curves.collect()} == {1} and curves.columns == [*df.columns, "flux_norm", "trend"]
    with pytest.raises(Exception, match="too bright"):
        clean.biweight_detrend(df).collect()


def test_clip_of_long_series_at_a_limit_met_exactly(spark):
    """Two of 50 values lie 5 deviations from the rest, which is not further than 5."""
    rng = np.random.default_rng(0)
    frames = []
    for tic in range(60):
        flux = np.zeros(50)
        flux[[3, 40]] = [5.0 * (1 + tic % 7), -5.0 * (1 + tic % 7)]
        frames.append(series_frame(np.arange(50) / 100, rng.permutation(flux), tic=tic))
    assert all(clean.clip_mask(f.flux.to_numpy()).all() for f in frames)
    assert clean.sigma_clip(series_df(spark, *frames).repartition(6), max_rows=0).count() == 3_000


def test_preprocess_shuffles_the_series_once(spark):
    df = series_df(spark, transit_curve(n=700))
    meta = spark.createDataFrame([(1, 1, 10.0)], "tic_id bigint, sector int, tmag double")
    plan = clean.preprocess_rows(df, meta)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 2 and plan.count("FlatMapCoGroups") == 1


def test_exclusion_boundaries(spark):
    rows = spark.createDataFrame(
        [(5.9, 1000), (6.0, 1000), (5.0, 10), (None, 499), (float("nan"), 500), (10.0, 499)], "tmag double, n int"
    )
    got = [r[0] for r in rows.select(rules.exclusion_reason(F.col("tmag"), F.col("n"))).collect()]
    assert got == ["SATURATED", "NONE", "SATURATED", "TOO_FEW_CADENCES", "NONE", "TOO_FEW_CADENCES"]


def test_no_python_udf_in_masks(spark):
    df = series_df(spark, transit_curve(n=600))
    plan = clean.sigma_clip(clean.quality_mask(df))._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "InPandas" not in plan


def test_rank_trees_of_a_long_series_are_bounded(monkeypatch):
    """A long series is detrended by trees over stretches of it, with the trend of one tree over all of it."""
    rng = np.random.default_rng(8)
    times = np.sort(rng.integers(0, 10**9, 12_000))
    values = 1 + rng.normal(0, 0.01, len(times))
    values[::50] = np.nan
    half = np.full(len(times), 25_000_000)
    want = clean.biweight_location(times, values, half, 6, 5.0)
    sizes = []
    monkeypatch.setattr(clean, "TREE_ROWS", 3_000)
    monkeypatch.setattr(clean, "biweight_location", lambda t, *rest: sizes.append(len(t)) or biweight_location(t, *rest))
    np.testing.assert_allclose(clean.sliding_biweight(times, values, half, 6, 5.0), want, rtol=1e-12)
    assert len(sizes) == 4 and max(sizes) <= 4_500


def test_preprocess_takes_many_series_and_stars_in_a_call(spark, monkeypatch, tmp_path):
    """Calls of the kernel grow with the cadences and stars, not with the number of series; their size changes no row."""
    whole = getattr(clean, "_clean_batch", None)

    def counted(*args):
        (tmp_path / uuid.uuid4().hex).touch()
        return whole(*args)

    monkeypatch.setattr(clean, "_clean_batch", counted, raising=False)
    frames = [transit_curve(n=60 + t % 3, tic=t, seed=t, span=3.0) for t in range(300)]
    frames[7] = frames[7].assign(time=frames[7].time + 1.0)
    frames[8].loc[:5, "flux"] = np.nan
    frames[9].loc[:30, "quality"] = 128
    df = series_df(spark, *frames, transit_curve(n=900, tic=300, span=9.0)).withColumns({
        "tic_id": F.when(F.col("tic_id") != 11, F.col("tic_id")), "flux": F.col("flux").cast("float"), "note": F.concat(F.lit("n"), F.col("time_us")),
        "exact": F.when(F.col("tic_id") != 12, F.lit(2**60 + 1) + F.col("time_us")),
    })
    # magnitudes of integer keys: some stars bright, one listed twice, one without key, many without cadences
    meta = spark.range(3_000).selectExpr("int(nullif(id, 11)) tic_id", "1 sector", "if(id % 50 = 3, 4.0D, if(id % 50 = 4, double('NaN'), 10.0D)) tmag")
    meta = meta.union(spark.createDataFrame([(20, 1, 3.0)], meta.schema))

    def rows():
        found = clean.preprocess_rows(df, meta, min_cadences=40).toPandas()
        return found.sort_values(["status", "tic_id", "time_us", "n_cadences"]).reset_index(drop=True)

    got = rows()
    assert 0 < len(list(tmp_path.iterdir())) <= 64
    told = got[got.status.notna()].set_index("tic_id").status
    assert len(told) == 3_001 and (told == "MISSING_RAW").sum() == 2_699
    assert told[7] == "ERROR: 61 of 61 cadences have two different times" and told[9] == "TOO_FEW_CADENCES" and told[53] == "SATURATED"
    assert sorted(told[20]) == ["PREPROCESSED", "SATURATED"] and told[np.isnan(told.index)].tolist() == ["PREPROCESSED"]
    assert got[got.status.notna()].set_index("tic_id").n_cadences[[4, 8, 300]].tolist() == [61, 56, 900]
    curves = got[got.status.isna()]
    assert curves.note.eq("n" + curves.time_us.astype("int64").astype(str)).all() and (curves.trend - 1).abs().max() < 0.02
    assert {r.exact - r.time_us for r in clean.preprocess_rows(df, meta, min_cadences=40).filter("exact is not null").select("exact", "time_us").collect()} == {2**60 + 1}
    # every series in a call of its own
    monkeypatch.setattr(clean, "ALONE_ROWS", 0)
    pd.testing.assert_frame_equal(got, rows())
    assert len(list(tmp_path.iterdir())) > 300
