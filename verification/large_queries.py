"""The ways of the operators for groups too large for one task, against the same SQL.

``max_rows`` is set so low that every series counts as large; rows, SQL and
rounding are those of the query without ``_large``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from photospark.operators import clean, features, fold, search
from photospark.schema import SERIES_KEY
from verification import search_queries as s
from verification import views
from verification.fold_queries import _long
from verification.registry import ORACLES, query, r6, rounded

MAX_ROWS = 100


def _same(name: str):
    return query(f"{name}_large", ORACLES[name])


def _clipped(spark, sf):
    return clean.sigma_clip(clean.quality_mask(views.lc(spark, sf)), max_rows=MAX_ROWS)


@_same("ag1_sigma_clip")
def _(spark, sf):
    return rounded(_clipped(spark, sf).groupBy(*SERIES_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.median("flux").alias("med"), F.stddev_pop("flux").alias("sd")
    ), 9)


@_same("ag2_median_normalise")
def _(spark, sf):
    normal = clean.median_normalise(_clipped(spark, sf), max_rows=MAX_ROWS)
    return normal.select(
        "tic_id", F.col("sector").cast("bigint").alias("sector"), "time_us", r6(F.col("flux")).alias("flux"), r6(F.col("flux_err"), 9).alias("flux_err"),
    )


@_same("ag4_phase_bin")
def _(spark, sf):
    return rounded(fold.phase_bin(views.lc_dip(spark, sf), views.cand(spark, sf), 101, 21, max_rows=MAX_ROWS), 9)


@_same("ag7_odd_even_sigma")
def _(spark, sf):
    return rounded(features.odd_even_sigma(views.lc_dip(spark, sf), views.cand(spark, sf), max_rows=MAX_ROWS))


@_same("dm2_box_periodogram")
def _(spark, sf):
    found = search.box_periodogram(views.lc_dip(spark, sf), s.PERIODS, s.DURATIONS, max_rows=MAX_ROWS)
    return rounded(found.select("tic_id", "period_us", "power"), 3)


@_same("dm3_period_search")
def _(spark, sf):
    found = search.sde_gate(search.period_search(views.lc_dip(spark, sf), s.PERIODS, s.DURATIONS, max_rows=MAX_ROWS))
    return rounded(found.select("tic_id", "period", "t0", "depth", "sde", "snr", "chi2", "chi2_red", "disposition"), 4)


@_same("dm6_bls_consistent")
def _(spark, sf):
    checked = search.bls_consistent(s._narrow(spark, sf), views.lc_dip(spark, sf), max_rows=MAX_ROWS)
    return rounded(checked.select("tic_id", "planet_num", "best_period", "bls_consistent"))


@_same("dm7_phase_fold")
def _(spark, sf):
    return _long(fold.phase_fold(views.lc_dip(spark, sf), views.cand(spark, sf), max_rows=MAX_ROWS))
