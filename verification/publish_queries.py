"""Contracts and published rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from photospark.operators import contracts, publish, search
from photospark.schema import CANDIDATE_KEY
from verification import views
from verification.catalogue_queries import _TIER_SQL, CK
from verification.registry import query, r6, rounded, sql_r6, table
from verification.rule_queries import _CLASS_SQL, _DISP_SQL
from verification.search_queries import DURATIONS, PERIODS, PTS
from verification.views import with_views

KEY = ("tic_id", "sector", "planet_num")


def _catalogue(spark, sf):
    """A catalogue with one out-of-range column, one wrong tier word and some contract columns missing."""
    return views.cand(spark, sf).withColumns({
        "tmag": F.lit(9.0), "ra": F.lit(1.0), "dec": F.lit(2.0), "candidate_num": F.col("planet_num"), "cdpp": F.lit(0.0),
        "n_cadences": F.lit(1000), "crowdsap": F.lit("1.0"), "prob_eb": F.col("prob_pc") * 1.1, "prob_blend": F.lit(0.0),
        "prob_sv": F.lit(0.0), "confidence_tier": F.when(F.col("status") == "P", "copper").otherwise("gold"),
    })


_MISSING = ("odd_even_depth_diff", "secondary_eclipse_depth", "centroid_shift_sigma", "v_shape_metric", "duration_period_ratio")


@query(
    "pr21_validate_catalogue",
    with_views("cand") + " UNION ALL ".join(f"SELECT 'missing' AS rule, '{c}' AS column, 'FAIL' AS severity, 1::BIGINT AS n" for c in _MISSING)
    + " UNION ALL SELECT 'type', 'crowdsap', 'WARN', 1 UNION ALL SELECT * FROM (SELECT 'range', 'prob_eb', 'FAIL', count(*) AS n FROM cand WHERE prob_pc * 1.1::DOUBLE > 1) WHERE n > 0 "
    "UNION ALL SELECT * FROM (SELECT 'allowed', 'confidence_tier', 'FAIL', count(*) AS n FROM cand WHERE status = 'P') WHERE n > 0",
)
def _(spark, sf):
    return contracts.validate_catalogue(_catalogue(spark, sf))


@query(
    "pr23_validate_phase1",
    with_views("cand", "lc_user") + """, k AS (SELECT DISTINCT tic_id, sector FROM cand), a AS (SELECT count(*) AS total,
  count(*) FILTER (WHERE (tic_id, sector) NOT IN (SELECT (tic_id, sector) FROM lc_user)) AS n FROM k)
SELECT 'required_columns' AS rule, '' AS detail, 0::BIGINT AS n, TRUE AS passed
UNION ALL SELECT 'significant_candidates', '', count(*) FILTER (WHERE sde >= 5), count(*) FILTER (WHERE sde >= 5) > 0 FROM cand
UNION ALL SELECT 'series_present', '', n, n <= total * 0.5 FROM a""",
)
def _(spark, sf):
    renamed = views.cand(spark, sf).withColumnsRenamed({"period": "tls_period", "sde": "tls_sde", "tic_id": "TIC_ID"})
    return contracts.validate_phase1(renamed, views.lc_user(spark, sf))


_NUM = "nullif({0}, 0)"


@query(
    "dm25_catalogue_report",
    with_views("cand") + f"SELECT tic_id, {sql_r6('period')} AS period, {sql_r6('depth')} AS depth, {sql_r6('duration')} AS duration, {sql_r6('sde')} AS sde, {sql_r6('snr')} AS snr, "
    f"{_CLASS_SQL} AS classification, {_DISP_SQL} AS disposition, {sql_r6('prob_pc')} AS confidence_score, {_TIER_SQL} AS confidence_tier, "
    + ", ".join(f"NULL::DOUBLE AS {c}" for c in ("period_err", "depth_err", "duration_err", "rp_rs", "rp_rs_err", "inclination", "inclination_err")) + " FROM cand",
)
def _(spark, sf):
    return rounded(publish.catalogue_report(views.cand(spark, sf)))


@query(
    "io10_report_text",
    with_views("cand") + "SELECT tic_id, printf('%.6f', period) AS period, printf('%.6f', sde) AS sde, "
    f"{_DISP_SQL} AS disposition, printf('%.6f', prob_pc) AS confidence_score FROM cand",
)
def _(spark, sf):
    text = publish.report_text(publish.catalogue_report(views.cand(spark, sf)))
    return text.select("tic_id", "period", "sde", "disposition", "confidence_score")


@query(
    "io11_candidate_list",
    with_views("cand") + f"SELECT CAST(tic_id AS VARCHAR) AS tic_id, {sql_r6(_NUM.format('period'))} AS period, {sql_r6(_NUM.format('depth'))} AS depth, {sql_r6('sde')} AS sde, "
    f"{sql_r6(_NUM.format('snr'))} AS snr, {_CLASS_SQL} AS classification, {_DISP_SQL} AS disposition, {sql_r6('prob_pc')} AS confidence_score, {_TIER_SQL} AS confidence_tier, "
    f"{sql_r6(_NUM.format('duration'))} AS duration FROM cand",
)
def _(spark, sf):
    return rounded(publish.candidate_list(views.cand(spark, sf)))


_TRI = ("tri AS (SELECT s_suppkey AS tic_id, s_nationkey / 25.0::DOUBLE AS fpp, s_acctbal / 1e6::DOUBLE AS nfpp FROM supplier), "
        "post AS (SELECT c_custkey AS tic_id FROM customer WHERE c_mktsegment = 'BUILDING')")


def _tri(spark, sf):
    n = F.col("s_nationkey")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("tic_id"), (n / 25.0).alias("fpp"), (F.col("s_acctbal") / 1e6).alias("nfpp"),
        (F.lit(1.0) - n / 25.0).alias("tp"), (n / 50.0).alias("eb"), (n / 100.0).alias("heb"),
        F.when(F.col("s_suppkey") % 9 == 0, F.lit(0.9)).otherwise(n / 100.0).alias("bgob"),
    )


@query(
    "io12_star_documents",
    with_views("cand", "meta") + f", {_TRI} SELECT CAST(c.tic_id AS VARCHAR) AS tic_id, CAST(c.sector AS BIGINT) AS sector, CAST(planet_num AS BIGINT) AS planet_num, {_CLASS_SQL} AS classification, {sql_r6(_NUM.format('ra'))} AS ra, "
    "'/plots/' || c.tic_id || '/corner.png' AS corner, "
    f"tri.tic_id IS NOT NULL AS has_triceratops, {sql_r6('fpp')} AS fpp, post.tic_id IS NOT NULL AS mcmc_available "
    "FROM cand c LEFT JOIN meta m ON m.tic_id = c.tic_id AND m.sector = c.sector LEFT JOIN tri ON tri.tic_id = c.tic_id LEFT JOIN post ON post.tic_id = c.tic_id WHERE sde >= 7",
)
def _(spark, sf):
    from photospark.operators.catalogue import attach_meta

    catalogue = attach_meta(views.cand(spark, sf), views.meta(spark, sf))
    posterior = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("tic_id"))
    docs = publish.star_documents(catalogue, _tri(spark, sf), posterior)
    return rounded(docs.select(
        *KEY, "classification", "ra", F.col("plots.corner").alias("corner"), F.col("triceratops").isNotNull().alias("has_triceratops"),
        F.col("triceratops.fpp").alias("fpp"), "mcmc_available",
    ))


_MATRIX = f"""se AS (SELECT tic_id, sector, arg_max({{'p': period, 'd': depth, 'r': snr, 's': sde, 'n': planet_num}}, {{'s': sde, 'n': -planet_num}}) AS x FROM cand GROUP BY ALL),
be AS (SELECT tic_id, arg_max(x, {{'s': x.s, 'k': -sector, 'n': -x.n}}) AS b FROM se GROUP BY tic_id),
mx AS (SELECT se.tic_id, sector, x.r AS snr, abs(x.p - b.p) / b.p < 0.01::DOUBLE AS pm,
  coalesce(abs(x.d - b.d) / nullif(b.d, 0) < 0.3::DOUBLE, x.d = b.d) AS dc FROM se JOIN be USING (tic_id)),
st AS (SELECT tic_id, CASE WHEN count(*) < 2 THEN 'INSUFFICIENT_DATA' WHEN count(*) FILTER (WHERE pm AND dc) * 2 >= count(*) THEN 'RECOVERED' ELSE 'NOT_RECOVERED' END AS status FROM mx GROUP BY tic_id)"""


@query(
    "dm27_sector_matrix",
    with_views("cand") + f", {_MATRIX} SELECT tic_id, CAST(sector AS BIGINT) AS sector, pm AS period_match, dc AS depth_consistency, {sql_r6('snr')} AS snr, "
    "CASE WHEN pm AND dc THEN 'PASS' ELSE 'FAIL' END AS sector_status, status AS overall FROM mx JOIN st USING (tic_id)",
)
def _(spark, sf):
    rows = publish.sector_matrix(views.cand(spark, sf)).select("tic_id", "overallRecoveryStatus", F.explode("passFailMatrix").alias("e"))
    return rounded(rows.select(
        "tic_id", "e.sector", F.col("e.periodMatch").alias("period_match"), F.col("e.depthConsistency").alias("depth_consistency"),
        "e.snr", F.col("e.status").alias("sector_status"), F.col("overallRecoveryStatus").alias("overall"),
    ))


def _payload(spark, sf):
    from photospark.operators.catalogue import attach_meta

    cands = attach_meta(views.cand(spark, sf), views.meta(spark, sf), ["tic_id"])
    empty = cands.select(*KEY).filter("sector = 1").withColumns({
        "global_view": F.array(F.lit(0.0), F.lit(-1.0), F.lit(0.0)), "local_view": F.array(F.lit(-1.0), F.lit(0.0)),
    })
    entries = publish.payload_entries(cands, empty, _tri(spark, sf), publish.sector_matrix(cands), 3, 3)
    return publish.build_payload(entries, 8, "2026-01-31T12:00:00Z")


_BEST = "bst AS (SELECT tic_id, arg_max({'sector': sector, 'n': planet_num, 'period': period, 'depth': depth, 'sde': sde, 'dur': duration, 'p': prob_pc, 'c': predicted_class}, {'s': sde, 'k': -sector, 'n': -planet_num}) AS b FROM cand GROUP BY tic_id)"


@query(
    "io13_build_payload",
    with_views("cand", "meta") + f", {_BEST}, {_MATRIX} SELECT CAST(tic_id AS VARCHAR) AS ticId, 'TIC ' || tic_id AS name, {sql_r6('b.period')} AS period, {sql_r6('b.depth * 1000')} AS depth, "
    f"{sql_r6('b.dur * 24')} AS duration, CASE WHEN b.p >= 0.9::DOUBLE THEN 'GOLD' WHEN b.p >= 0.7::DOUBLE THEN 'SILVER' ELSE 'BRONZE' END AS tier, "
    "CASE b.c WHEN 0 THEN 'CONFIRMED_PLANET' WHEN 1 THEN 'BINARY_STAR_ECLIPSE' WHEN 2 THEN 'BACKGROUND_STELLAR_CONTAMINATION' ELSE 'FALSE_ALARM' END AS disposition, "
    "CASE WHEN b.sector = 1 THEN 3 ELSE NULL END::BIGINT AS n_raw, status AS recovery, '2026-01-31T12:00:00Z' AS timestamp FROM bst JOIN st USING (tic_id)",
)
def _(spark, sf):
    rows = _payload(spark, sf).select("timestamp", F.explode("candidates").alias("ticId", "e"))
    return rounded(rows.select(
        "ticId", "e.signal.name", "e.signal.period", "e.signal.depth", "e.signal.duration", F.col("e.signal.confidenceTier").alias("tier"),
        "e.signal.disposition", F.when(F.col("e.lightCurve").isNotNull(), F.size("e.lightCurve.rawPhase")).alias("n_raw"),
        F.col("e.validation.sherlock.overallRecoveryStatus").alias("recovery"), "timestamp",
    ))


@query(
    "pr22_validate_payload",
    with_views("cand", "meta") + f", {_BEST}, t AS (SELECT s_suppkey AS tic_id, abs(1.0::DOUBLE - s_nationkey / 25.0 + s_nationkey / 50.0 + s_nationkey / 100.0 + "
    "CASE WHEN s_suppkey % 9 = 0 THEN 0.9 ELSE s_nationkey / 100.0 END - 1.0) > 0.05 AS off FROM supplier), "
    "j AS (SELECT b.tic_id, b.b.sector AS sector, m.tic_id IS NULL AS no_meta, t.tic_id IS NULL AS no_tri, off FROM bst b LEFT JOIN meta m ON m.tic_id = b.tic_id LEFT JOIN t ON t.tic_id = b.tic_id), "
    "v AS (SELECT 'lightCurve' AS path, 'required' AS rule, 'FAIL' AS severity, count(*) AS n FROM j WHERE sector <> 1 "
    "UNION ALL SELECT 'lightCurve.model', 'length', 'FAIL', count(*) FROM j WHERE sector = 1 "
    "UNION ALL SELECT 'validation', 'required', 'FAIL', count(*) FROM j WHERE no_tri "
    "UNION ALL SELECT 'validation.triceratops.fpp', 'range', 'FAIL', count(*) FROM j WHERE no_tri "
    "UNION ALL SELECT 'validation.triceratops.nfpp', 'required', 'FAIL', count(*) FROM j WHERE no_tri "
    "UNION ALL SELECT 'validation.triceratops.modes', 'required', 'FAIL', count(*) FROM j WHERE no_tri "
    "UNION ALL SELECT 'validation.triceratops.modes', 'sum', 'WARN', count(*) FROM j WHERE off "
    "UNION ALL SELECT 'signal.ra', 'range', 'FAIL', count(*) FROM j WHERE no_meta UNION ALL SELECT 'signal.dec', 'range', 'FAIL', count(*) FROM j WHERE no_meta) "
    "SELECT * FROM v WHERE n > 0",
)
def _(spark, sf):
    found = contracts.validate_payload(_payload(spark, sf))
    return found.groupBy("path", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dm26_class_bars",
    with_views("cand") + " UNION ALL ".join(
        f"SELECT {CK}, '{n}' AS class, {sql_r6(x)} AS probability FROM cand" for n, x in
        (("PC", "prob_pc"), ("EB", "1.0::DOUBLE - prob_pc"), ("Blend", "0.0::DOUBLE"), ("StellarVar", "0.0::DOUBLE"))
    ),
)
def _(spark, sf):
    probs = views.cand(spark, sf).withColumns({"prob_eb": F.lit(1.0) - F.col("prob_pc"), "prob_blend": F.lit(0.0), "prob_sv": F.lit(0.0)})
    return rounded(publish.class_bars(probs))


def _diagnostics(spark, sf, series, periodogram=None):
    cand = views.cand(spark, sf).withColumns({"prob_eb": F.lit(0.0), "prob_blend": F.lit(0.0), "prob_sv": F.lit(0.0)})
    flat = cand.select(*CANDIDATE_KEY, F.array(F.lit(1.0)).alias("global_view"))
    fits = cand.select(*CANDIDATE_KEY, "period", "duration", "depth", F.lit(0.0).alias("t0_shift"), F.lit(0.5).alias("ingress"))
    return publish.diagnostic_tables(cand, series, flat, series if periodogram is None else periodogram, fits, 1)


@query(
    "dm26_light_curve",
    with_views("lc_user", "cand") + f"SELECT tic_id, sector, time_us, {sql_r6('CASE WHEN isnan(flux) THEN NULL ELSE flux END')} AS flux FROM lc_user "
    "WHERE (tic_id, sector) IN (SELECT (tic_id, sector) FROM cand)",
)
def _(spark, sf):
    return rounded(_diagnostics(spark, sf, views.lc_user(spark, sf))["light_curve"].select("tic_id", "sector", "time_us", "flux"))


@query(
    "dm26_epochs",
    with_views("lc_user", "cand") + f""", sp AS (SELECT tic_id, sector, min(time) AS a, max(time) AS b FROM lc_user GROUP BY ALL)
SELECT {CK}, count(*) AS n, {sql_r6('min(t0 + e * period)')} AS first, {sql_r6('max(t0 + e * period)')} AS last
FROM (SELECT {CK}, period, t0, unnest(range(CAST(ceil((a - t0) / period) AS BIGINT), CAST(floor((b - t0) / period) AS BIGINT) + 1)) AS e
  FROM cand JOIN sp USING (tic_id, sector)) GROUP BY {CK}""",
)
def _(spark, sf):
    epochs = _diagnostics(spark, sf, views.lc_user(spark, sf))["epochs"]
    return rounded(epochs.groupBy(*CANDIDATE_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("epoch_time").alias("first"), F.max("epoch_time").alias("last")))


@query(
    "dm26_periodogram",
    with_views("lc_dip", "cand") + PTS + f"SELECT tic_id, p AS period_us, {sql_r6('power', 3)} AS power FROM bestbox "
    "WHERE (tic_id, 1) IN (SELECT (tic_id, sector) FROM cand)",
)
def _(spark, sf):
    series = views.lc_dip(spark, sf)
    table_ = _diagnostics(spark, sf, series, search.box_periodogram(series, PERIODS, DURATIONS))["periodogram"]
    return rounded(table_.select("tic_id", "period_us", "power"), 3)


@query(
    "dm26_folded_model",
    with_views("view64") + f""", f AS (SELECT vec_id, v, 2.0::DOUBLE AS period, 0.4::DOUBLE AS dur, 0.01::DOUBLE * (vec_id % 10) AS depth FROM view64),
b AS (SELECT vec_id, i, v[i + 1] AS flux, depth, dur / period / 2.0 AS half, -0.5::DOUBLE + (i + 0.5::DOUBLE) / 64 AS ph FROM f, range(64) r(i)),
m AS (SELECT vec_id, i, flux, ph, 1.0::DOUBLE - depth * greatest(least((half - abs(ph)) / (half * 0.5::DOUBLE), 1.0), 0.0) AS model FROM b)
SELECT vec_id, i AS bin, {sql_r6('ph', 9)} AS phase, {sql_r6('flux', 9)} AS flux, {sql_r6('model', 9)} AS model, {sql_r6('flux - model', 9)} AS residual FROM m""",
)
def _(spark, sf):
    df = views.view64(spark, sf)
    fits = df.select(
        "vec_id", F.lit(2.0).alias("period"), F.lit(0.4).alias("duration"), F.lit(0.0).alias("t0_shift"), F.lit(0.5).alias("ingress"),
        (F.lit(0.01) * (F.col("vec_id") % 10)).alias("depth"),
    )
    out = publish.folded_model(df.withColumnRenamed("v", "global_view"), fits, 64, keys=("vec_id",))
    return rounded(out.select("vec_id", "bin", "phase", "flux", "model", "residual"), 9)
