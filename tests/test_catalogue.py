"""Catalogue joins and merges."""

import pytest
from pyspark.sql import functions as F

from helpers import cand_df
from photospark.operators import catalogue as cat
from photospark.operators import contracts, publish, recovery
from photospark.sources.tables import ld_table


def test_nearest_ld_ties_and_defaults(spark):
    ld = spark.createDataFrame(
        [(0, 3000.0, 0.4, 0.1), (1, 4000.0, 0.3, 0.15), (2, 5000.0, 0.25, 0.2), (3, 6000.0, 0.2, 0.25), (4, 7000.0, 0.1, 0.3)],
        "row_no bigint, teff double, u1 double, u2 double",
    )
    stars = spark.createDataFrame(
        [(1, 5000.0), (2, 4800.0), (3, 4500.0), (4, None), (5, float("nan")), (6, 99999.0), (7, 100.0)], "tic_id bigint, teff double"
    )
    got = {r.tic_id: (r.u1, r.u2) for r in cat.nearest_ld(stars, ld).collect()}
    assert got == {1: (0.25, 0.2), 2: (0.25, 0.2), 3: (0.3, 0.15), 4: (0.3, 0.3), 5: (0.3, 0.3), 6: (0.1, 0.3), 7: (0.4, 0.1)}
    assert cat.nearest_ld(stars, ld.limit(0)).first().u1 == 0.3
    table = ld_table(spark).toPandas()
    assert len(table) == 36 and table.u1.iloc[0] == 0.45 and table.u1.iloc[-1] == pytest.approx(0.2) and table.u2.iloc[-1] == pytest.approx(0.2)


def test_keyed_update(spark):
    df = spark.createDataFrame([(100, 1, 1, 2.0), (200, 1, 1, 3.0)], "tic_id bigint, sector int, planet_num int, period double")
    new = spark.createDataFrame([(100, 1, 1, 2.5, 0.1)], "tic_id bigint, sector int, planet_num int, period double, rp double")
    got = {r.tic_id: (r.period, r.rp) for r in cat.keyed_update(df, new).collect()}
    assert got == {100: (2.5, 0.1), 200: (3.0, None)}


def test_merges(spark):
    a = spark.createDataFrame([(1, 1, "a")], "tic_id bigint, sector int, v string")
    b = spark.createDataFrame([(1, 1, "b", 5), (2, 1, "b", 6)], "tic_id bigint, sector int, v string, w int")
    first = {r.tic_id: (r.v, r.w) for r in cat.upsert(a, b, ["tic_id", "sector"]).collect()}
    last = {r.tic_id: (r.v, r.w) for r in cat.merge_keep_last([a, b]).collect()}
    assert first == {1: ("a", None), 2: ("b", 6)} and last == {1: ("b", 5), 2: ("b", 6)}


def test_known_planets(spark):
    known = recovery.known_planets(spark)
    assert known.count() == 7
    found = known.select("tic_id", (F.col("known_period") * 1.005).alias("period"), F.lit("FULL_PIPELINE").alias("disposition"))
    assert recovery.recovery_passed(recovery.match_known(found, known)).first().passed
    one_missing = found.filter("tic_id <> 22529346")
    assert not recovery.recovery_passed(recovery.match_known(one_missing, known)).first().passed
    discarded = found.withColumn("disposition", F.when(F.col("tic_id") == 22529346, "DISCARD").otherwise("SUB_THRESHOLD"))
    assert recovery.recovery_passed(recovery.match_known(discarded, known)).first().n_recovered == 6


def test_published(spark):
    published = recovery.published_parameters(spark)
    assert published.count() == 8
    fits = published.select("target", "period", "depth_ppm", "duration_days").filter("target <> 'TOI-700d'")
    fits = fits.withColumn("depth_ppm", F.when(F.col("target") == "WASP-121b", F.col("depth_ppm") * 1.06).otherwise(F.col("depth_ppm") * 1.04))
    got = {r.target: r.status for r in recovery.validation_report(fits, published).collect()}
    assert got.pop("WASP-121b") == "FAIL" and got.pop("TOI-700d") == "MISSING" and set(got.values()) == {"PASS"}


def test_best_model_sources(spark):
    c = spark.createDataFrame([(1,), (2,), (3,)], "tic_id bigint")
    post = spark.createDataFrame(
        [(1, True, 0.1, 88.0, 9.0, None, 2.0), (2, False, 0.1, 88.0, 9.0, 0.1, 2.0)],
        "tic_id bigint, mcmc_converged boolean, mcmc_rp_rs double, mcmc_inclination double, mcmc_a_rs double, mcmc_t0 double, mcmc_period double",
    )
    nm = spark.createDataFrame(
        [(1, 0.2, 87.0, 8.0, 0.0, 2.0), (2, 0.2, 87.0, 8.0, 0.0, 2.0)],
        "tic_id bigint, nm_rp_rs double, nm_inclination double, nm_a_rs double, nm_t0 double, nm_period double",
    )
    got = {r.tic_id: (r.model_source, r.model.rp if r.model else None) for r in cat.best_model(c, post, nm).collect()}
    assert got == {1: ("mcmc", 0.1), 2: ("nelder_mead", 0.2), 3: ("none", None)}


def test_resolve_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 9.0)], "ticid bigint, tls_period double, TLS_SDE double")
    out, missing = cat.resolve_columns(df)
    assert out.columns == ["tic_id", "period", "sde"] and missing == ["sector", "t0", "snr", "depth", "duration"]


def test_paging_and_search(spark):
    df = spark.createDataFrame([(i, "GOLD" if i % 2 else "BRONZE", float(i)) for i in range(45)], "tic_id bigint, confidence_tier string, sde double")
    order = [F.col("sde").desc()]
    assert [r.tic_id for r in cat.page(df, order, 2).collect()] == [4, 3, 2, 1, 0]
    assert {r.tic_id for r in cat.search_candidates(df, "4", "GOLD").collect()} == {41, 43}
    assert tuple(cat.search_counts(df, "4", "ALL").first()) == (9, 45)
    assert cat.candidate_by_id(df, "1 2").first().tic_id == 12


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 2.0, -1.0, 3.0)], "x double")
    assert [r.n for r in cat.histogram(df, "x", 0.0, 2.0, 2).orderBy("bin").collect()] == [2, 2]
    assert [r.n for r in cat.histogram(df, "x", 0.0, 2.0, 2, clip=False).orderBy("bin").collect()] == [2, 2]


def test_catalogue_contract(spark):
    row = {c: (1 if k == "int" else 0.5 if k == "float" else "Gold") for c, k in contracts.CATALOGUE_CONTRACT.items()}
    good = spark.createDataFrame([row])
    assert contracts.validate_catalogue(good).count() == 0
    bad = good.drop("ra").withColumn("prob_pc", F.lit(1.5)).withColumn("sde", F.lit("x"))
    got = {(r.rule, r.column, r.severity) for r in contracts.validate_catalogue(bad).collect()}
    assert got == {("missing", "ra", "FAIL"), ("type", "sde", "WARN"), ("range", "prob_pc", "FAIL")}


def test_phase1_gate(spark):
    cands = cand_df(spark, [(1, 1, 1, 1.0, 1.0, 0.1, 0.1, 4.0, 1.0)])
    none = spark.createDataFrame([], "tic_id bigint, sector int")
    got = {r.rule: r.passed for r in contracts.validate_phase1(cands.drop("snr"), none).collect()}
    assert got == {"required_columns": False, "significant_candidates": False, "series_present": False}
    assert all(r.passed for r in contracts.validate_phase1(cands.withColumn("sde", F.lit(5.0)), cands.select("tic_id", "sector")).collect())


def test_sector_matrix_statuses(spark):
    rows = [
        (1, 1, 1, 3.0, 0.0, 0.1, 0.01, 9.0, 9.0), (1, 2, 1, 3.001, 0.0, 0.1, 0.011, 8.0, 8.0), (2, 1, 1, 3.0, 0.0, 0.1, 0.01, 9.0, 9.0),
        (3, 1, 1, 3.0, 0.0, 0.1, 0.01, 9.0, 9.0), (3, 2, 1, 4.0, 0.0, 0.1, 0.01, 8.0, 8.0), (3, 3, 1, 5.0, 0.0, 0.1, 0.01, 8.0, 8.0),
    ]
    got = {r.tic_id: (r.overallRecoveryStatus, r.sectors) for r in publish.sector_matrix(cand_df(spark, rows)).collect()}
    assert got == {1: ("RECOVERED", [1, 2]), 2: ("INSUFFICIENT_DATA", [1]), 3: ("NOT_RECOVERED", [1, 2, 3])}
