"""Joins, merges, ordering and counts on catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from photospark.functions import rules
from photospark.operators import catalogue as cat
from photospark.sources.tables import ld_table
from verification import views
from verification.registry import query, r6, rounded, sql_r6, table
from verification.views import DISPOSITION_TEXTS, with_views

CK = "tic_id, sector, planet_num"
LD_SQL = (
    "ld AS (SELECT i AS row_no, 3000.0::DOUBLE + 200.0::DOUBLE * i AS teff, "
    "0.45::DOUBLE - 0.25::DOUBLE * ((200.0::DOUBLE * i) / 7000.0::DOUBLE) AS u1, "
    "0.25::DOUBLE - 0.05::DOUBLE * ((200.0::DOUBLE * i) / 7000.0::DOUBLE) AS u2 FROM range(36) r(i))"
)


@query(
    "jn1_attach_series",
    with_views("cand", "lc_user")
    + f"SELECT {CK}, count(time_us) AS n, bool_or(time_us IS NOT NULL) AS has_series, {sql_r6('sum(l.flux)')} AS total "
    "FROM cand c LEFT JOIN (SELECT * FROM lc_user WHERE NOT isnan(flux)) l USING (tic_id, sector) GROUP BY ALL",
)
def _(spark, sf):
    series = views.lc_user(spark, sf).filter(~F.isnan("flux"))
    joined = cat.attach_series(views.cand(spark, sf), series)
    return rounded(joined.groupBy("tic_id", "sector", "planet_num").agg(
        F.count("time_us").alias("n"), F.bool_or("has_series").alias("has_series"), F.sum("flux").alias("total")
    ))


@query(
    "jn1_series_available",
    with_views("cand", "lc_user") + f"SELECT {CK}, (tic_id, sector) IN (SELECT (tic_id, sector) FROM lc_user) AS has_series FROM cand",
)
def _(spark, sf):
    flagged = cat.series_available(views.cand(spark, sf), views.lc_user(spark, sf))
    return rounded(flagged.select("tic_id", "sector", "planet_num", "has_series"))


@query(
    "jn2_attach_meta",
    with_views("cand", "meta") + f"SELECT {CK}, {sql_r6('sde')} AS sde, {sql_r6('tmag')} AS tmag, {sql_r6('ra')} AS ra, "
    f"{sql_r6('dec')} AS dec FROM cand LEFT JOIN meta USING (tic_id, sector)",
)
def _(spark, sf):
    joined = cat.attach_meta(views.cand(spark, sf), views.meta(spark, sf))
    return rounded(joined.select("tic_id", "sector", "planet_num", "sde", "tmag", "ra", "dec"))


def case_label_sql(codes: dict[str, int], rest: str, code: str = "upper(trim(disposition))") -> str:
    cases = " ".join(f"WHEN {code} = '{k}' THEN {v}" for k, v in codes.items())
    return f"CASE WHEN disposition IS NULL OR trim(disposition) = '' THEN -1 {cases} {rest} END"


_C = "upper(trim(disposition))"


def _has(word):
    return f"contains({_C}, '{word}')"


TFOP_REST = (
    f"WHEN ({_has('PLANET')} OR starts_with({_C}, 'P')) THEN CASE WHEN {_has('BACKGROUND')} THEN 2 ELSE 0 END "
    f"WHEN {_has('BINARY')} OR {_has('EB')} THEN CASE WHEN {_has('BACKGROUND')} OR {_has('NEARBY')} THEN 2 ELSE 1 END "
    f"WHEN {_has('BLEND')} OR {_has('CONTAM')} THEN 2 "
    f"WHEN {_has('VARIABLE')} OR {_has('STELLAR')} OR {_has('FALSE')} OR {_has('INSTRUMENT')} THEN 3 ELSE -1"
)
KEPLER_REST = (
    f"WHEN {_has('PLANET')} OR {_C} = 'CP' THEN 0 WHEN {_has('BINARY')} OR {_has('EB')} THEN 1 "
    f"WHEN {_has('BLEND')} THEN 2 ELSE 3"
)
TOI_REST = f"WHEN {_has('PLANET')} THEN 0 WHEN {_has('EB')} OR {_has('BINARY')} THEN 1 ELSE -1"

# The tables of the SQL side are written out again on purpose: they check the ones of the library.
TFOP_SQL = case_label_sql(
    dict(KP=0, CP=0, PC=0, APC=0, VPC=0, EB=1, SB=1, BEB=2, NEB=2, BTP=2, V=3, IS=3, O=3, FA=3, FP=3, SG=3), TFOP_REST
)
KEPLER_SQL = case_label_sql(dict(PC=0, KP=0, EB=1, AFP=1, BEB=2, NTP=3, V=3, UNK=3, IS=3), KEPLER_REST)
TOI_SQL = case_label_sql(
    dict(CP=0, KP=0, PC=0, EB=1, SB=1, FP=1, BEB=2, BTP=2, NEB=2, FA=3, IS=3, V=3), TOI_REST
)


@query(
    "jn3_attach_labels",
    with_views("cand", "disp") + f", d AS (SELECT tic_id % 800 AS tic_id, row_no, disposition FROM disp), "
    f"f AS (SELECT tic_id, arg_min({TFOP_SQL}, row_no) AS label FROM d GROUP BY tic_id) "
    f"SELECT {CK}, CAST(nullif(label, -1) AS BIGINT) AS label FROM cand LEFT JOIN f USING (tic_id)",
)
def _(spark, sf):
    rows = views.disp(spark, sf).withColumn("tic_id", F.col("tic_id") % 800)
    labelled = cat.attach_labels(views.cand(spark, sf), rows)
    return rounded(labelled.select("tic_id", "sector", "planet_num", "label"))


@query(
    "ag28_first_label",
    with_views("disp") + f"SELECT tic_id % 800 AS tic_id, CAST(arg_min({TFOP_SQL}, row_no) AS BIGINT) AS label FROM disp GROUP BY ALL",
)
def _(spark, sf):
    return rounded(cat.first_label(views.disp(spark, sf).withColumn("tic_id", F.col("tic_id") % 800)))


@query(
    "jn4_nearest_ld",
    with_views("meta") + f", {LD_SQL}, d AS (SELECT m.tic_id, arg_min({{'u1': u1, 'u2': u2}}, {{'d': abs(m.teff - ld.teff), 'i': row_no}}) AS x "
    "FROM meta m, ld WHERE m.teff IS NOT NULL GROUP BY m.tic_id) "
    f"SELECT m.tic_id, {sql_r6('coalesce(x.u1, 0.3)')} AS u1, {sql_r6('coalesce(x.u2, 0.3)')} AS u2 "
    "FROM meta m LEFT JOIN d USING (tic_id)",
)
def _(spark, sf):
    return rounded(cat.nearest_ld(views.meta(spark, sf), ld_table(spark)).select("tic_id", "u1", "u2"))


_LD_CAT = (
    "lc_cat AS (SELECT tic_id, CASE WHEN tic_id % 5 = 0 THEN 'NaN'::DOUBLE ELSE teff / 10000.0::DOUBLE END AS ld_u1, "
    "tmag / 100.0::DOUBLE AS ld_u2 FROM meta)"
)


@query(
    "jn5_ld_lookup",
    with_views("cand", "meta") + f", {_LD_CAT} SELECT {CK}, "
    f"{sql_r6('CASE WHEN ok THEN ld_u1 ELSE 0.4 END', 9)} AS ld_u1, {sql_r6('CASE WHEN ok THEN ld_u2 ELSE 0.2 END', 9)} AS ld_u2 "
    "FROM (SELECT *, ld_u1 IS NOT NULL AND ld_u2 IS NOT NULL AND NOT isnan(ld_u1) AND NOT isnan(ld_u2) AS ok "
    "FROM cand LEFT JOIN lc_cat USING (tic_id))",
)
def _(spark, sf):
    stars = views.meta(spark, sf).select(
        "tic_id",
        F.when(F.col("tic_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("teff") / 10000.0).alias("ld_u1"),
        (F.col("tmag") / 100.0).alias("ld_u2"),
    )
    found = cat.ld_lookup(views.cand(spark, sf), stars)
    return rounded(found.select("tic_id", "sector", "planet_num", "ld_u1", "ld_u2"), 9)


@query(
    "jn9_only_available",
    with_views("disp", "lc_user") + "SELECT tic_id, row_no FROM disp WHERE tic_id IN (SELECT tic_id FROM lc_user)",
)
def _(spark, sf):
    return cat.only_available(views.disp(spark, sf), views.lc_user(spark, sf)).select("tic_id", "row_no")


@query(
    "jn10_pending",
    with_views("cand") + f"SELECT {CK} FROM cand WHERE (tic_id, sector) NOT IN (SELECT (tic_id, sector) FROM cand WHERE status = 'F')",
)
def _(spark, sf):
    work = views.cand(spark, sf)
    done = work.filter(F.col("status") == "F")
    return rounded(cat.pending(work, done).select("tic_id", "sector", "planet_num"))


_FITS_SQL = """, post AS (SELECT s_suppkey AS tic_id, s_suppkey % 3 = 0 AS ok, s_acctbal / 20000.0::DOUBLE AS rp, s_nationkey AS n FROM supplier),
simp AS (SELECT c_custkey AS tic_id, c_acctbal / 30000.0::DOUBLE AS rp FROM customer WHERE c_mktsegment <> 'MACHINERY')
"""


def _fits(spark, sf):
    post = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("tic_id"), (F.col("s_suppkey") % 3 == 0).alias("mcmc_converged"),
        (F.col("s_acctbal") / 20000.0).alias("mcmc_rp_rs"), F.lit(88.0).alias("mcmc_inclination"),
        F.lit(10.0).alias("mcmc_a_rs"), F.lit(None).cast("double").alias("mcmc_t0"), F.lit(2.0).alias("mcmc_period"),
    )
    simplex = table(spark, sf, "customer").filter(F.col("c_mktsegment") != "MACHINERY").select(
        F.col("c_custkey").alias("tic_id"), (F.col("c_acctbal") / 30000.0).alias("nm_rp_rs"),
        F.lit(87.0).alias("nm_inclination"), F.lit(9.0).alias("nm_a_rs"), F.lit(0.1).alias("nm_t0"),
        F.lit(2.0).alias("nm_period"),
    )
    return post, simplex


@query(
    "jn11_attach_results",
    with_views("cand") + _FITS_SQL + f"SELECT {CK}, post.tic_id IS NOT NULL AS available, ok AS converged, {sql_r6('post.rp')} AS rp "
    "FROM cand LEFT JOIN post USING (tic_id)",
)
def _(spark, sf):
    post, _simplex = _fits(spark, sf)
    joined = cat.attach_results(views.cand(spark, sf), post, "posterior")
    return rounded(joined.select(
        "tic_id", "sector", "planet_num", F.col("posterior").isNotNull().alias("available"),
        F.col("posterior.mcmc_converged").alias("converged"), F.col("posterior.mcmc_rp_rs").alias("rp"),
    ))


@query(
    "jn12_best_model",
    with_views("cand") + _FITS_SQL + f"""SELECT {CK},
CASE WHEN p.ok THEN 'mcmc' WHEN s.tic_id IS NOT NULL THEN 'nelder_mead' ELSE 'none' END AS model_source,
{sql_r6('CASE WHEN p.ok THEN p.rp ELSE s.rp END')} AS rp,
{sql_r6('CASE WHEN p.ok THEN 0.0::DOUBLE WHEN s.tic_id IS NOT NULL THEN 0.1::DOUBLE END')} AS t0
FROM cand LEFT JOIN post p USING (tic_id) LEFT JOIN simp s USING (tic_id)""",
)
def _(spark, sf):
    best = cat.best_model(views.cand(spark, sf), *_fits(spark, sf))
    return rounded(best.select(
        "tic_id", "sector", "planet_num", "model_source", F.col("model.rp").alias("rp"), F.col("model.t0").alias("t0")
    ))


_SPLIT_SQL = ", sp AS (SELECT tic_id, sector, planet_num, CASE status WHEN 'F' THEN 'train' WHEN 'O' THEN 'calibration' ELSE 'test' END AS split FROM cand) "


def _split(spark, sf):
    status = F.col("status")
    return views.cand(spark, sf).select(
        "tic_id", "sector", "planet_num",
        F.when(status == "F", "train").when(status == "O", "calibration").otherwise("test").alias("split"),
    )


@query(
    "jn13_in_split",
    with_views("cand") + _SPLIT_SQL + f"SELECT {CK} FROM cand WHERE (tic_id, sector, planet_num) IN "
    "(SELECT (tic_id, sector, planet_num) FROM sp WHERE split = 'test')",
)
def _(spark, sf):
    test = cat.in_split(views.cand(spark, sf), _split(spark, sf), "test")
    return rounded(test.select("tic_id", "sector", "planet_num"))


@query(
    "jn14_cross_grid",
    with_views("meta") + "SELECT tic_id, d AS depth_ppm, p AS period, t AS trial FROM meta, "
    "(VALUES (50.0::DOUBLE), (300.0::DOUBLE), (2000.0::DOUBLE)) a(d), (VALUES (0.5::DOUBLE), (4.0::DOUBLE), (30.0::DOUBLE)) b(p), "
    "(VALUES (0::BIGINT), (1::BIGINT)) c(t)",
)
def _(spark, sf):
    grid = cat.cross_grid(views.meta(spark, sf), depth_ppm=[50.0, 300.0, 2000.0], period=[0.5, 4.0, 30.0], trial=[0, 1])
    return rounded(grid.select("tic_id", "depth_ppm", "period", "trial"))


@query(
    "jn15_keyed_update",
    with_views("cand") + f"SELECT {CK}, {sql_r6('CASE WHEN status = chr(70) THEN NULL WHEN status = chr(79) THEN period * 2 ELSE period END')} AS period, "
    f"{sql_r6('CASE WHEN status = chr(79) THEN depth * 1e6 END')} AS depth_ppm FROM cand",
)
def _(spark, sf):
    rows = views.cand(spark, sf)
    updates = rows.filter(F.col("status") != "P").select(
        "tic_id", "sector", "planet_num",
        F.when(F.col("status") == "O", F.col("period") * 2).alias("period"),
        F.when(F.col("status") == "O", F.col("depth") * 1e6).alias("depth_ppm"),
    )
    updated = cat.keyed_update(rows, updates)
    return rounded(updated.select("tic_id", "sector", "planet_num", "period", "depth_ppm"))


@query(
    "jn16_identifier_lookup",
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)
def _(spark, sf):
    basic = table(spark, sf, "nation").withColumn("oid", F.col("n_regionkey"))
    ident = table(spark, sf, "region").select(F.col("r_regionkey").alias("oidref"), F.col("r_name").alias("id"))
    return rounded(cat.identifier_lookup(spark, basic, ident, "ASIA").select("n_nationkey", "n_name"))


@query(
    "jn17_split_overlap",
    with_views("cand") + _SPLIT_SQL + "SELECT tic_id, count(DISTINCT split) AS n_splits FROM sp GROUP BY tic_id HAVING count(DISTINCT split) > 1",
)
def _(spark, sf):
    return cat.split_overlap(_split(spark, sf), "tic_id")


# ---- sets ----------------------------------------------------------------------

_TWO_SQL = (
    ", old AS (SELECT tic_id, sector, planet_num, sde, 'old' AS origin FROM cand WHERE status <> 'O'), "
    "new AS (SELECT tic_id, sector, planet_num, sde + 1.0::DOUBLE AS sde, 'new' AS origin FROM cand WHERE status <> 'F') "
)


def _two(spark, sf):
    rows = views.cand(spark, sf)
    cols = ("tic_id", "sector", "planet_num")
    old = rows.filter(F.col("status") != "O").select(*cols, "sde", F.lit("old").alias("origin"))
    new = rows.filter(F.col("status") != "F").select(*cols, (F.col("sde") + 1.0).alias("sde"), F.lit("new").alias("origin"))
    return old, new


def _merged_sql(first, second):
    """Rows of ``first``, then those rows of ``second`` whose (tic_id, sector) is not in ``first``; best planet each."""
    return (
        f", u AS (SELECT *, CASE origin WHEN '{first}' THEN 0 ELSE 1 END AS part FROM (SELECT * FROM old UNION ALL SELECT * FROM new)), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY tic_id, sector ORDER BY part, {order}) AS rn FROM u) "
        f"SELECT {CK}, {sql_r6('sde')} AS sde, origin FROM r WHERE rn = 1"
    )


@query("st1_upsert", with_views("cand") + _TWO_SQL + _merged_sql("old", "new").replace("{order}", "planet_num"))
def _(spark, sf):
    return rounded(cat.upsert(*_two(spark, sf), ["tic_id", "sector"], ["planet_num"]))


@query("st2_merge_keep_last", with_views("cand") + _TWO_SQL + _merged_sql("new", "old").replace("{order}", "planet_num DESC"))
def _(spark, sf):
    return rounded(cat.merge_keep_last(list(_two(spark, sf)), order=["planet_num"]))


@query("dm28_merge_catalogues", with_views("cand") + """, parts AS (SELECT *, 1 AS part FROM cand WHERE status = 'F'
UNION ALL SELECT *, 2 FROM cand WHERE status = 'O' UNION ALL SELECT *, 3 FROM cand WHERE status = 'P'),
r AS (SELECT *, row_number() OVER (PARTITION BY tic_id, sector ORDER BY part DESC, planet_num DESC) AS rn FROM parts)
SELECT """ + CK + f", {sql_r6('sde')} AS sde, status FROM r WHERE rn = 1")
def _(spark, sf):
    rows = views.cand(spark, sf)
    parts = [rows.filter(F.col("status") == s) for s in ("F", "O", "P")]
    merged = cat.merge_catalogues(parts, order=["planet_num"])
    return rounded(merged.select("tic_id", "sector", "planet_num", "sde", "status"))


@query(
    "st3_union_priority",
    with_views("cand") + _TWO_SQL + f"SELECT {CK}, {sql_r6('sde')} AS sde, origin FROM new UNION ALL SELECT {CK}, {sql_r6('sde')}, origin "
    "FROM old WHERE (tic_id, sector, planet_num) NOT IN (SELECT (tic_id, sector, planet_num) FROM new)",
)
def _(spark, sf):
    old, new = _two(spark, sf)
    return rounded(cat.union_priority(new, old, ["tic_id", "sector", "planet_num"]))


@query(
    "st4_invalid_values",
    with_views("disp") + "SELECT DISTINCT disposition FROM disp WHERE disposition NOT IN ('PC', 'EB', 'FP') OR disposition IS NULL",
)
def _(spark, sf):
    return cat.invalid_values(views.disp(spark, sf), "disposition", ["PC", "EB", "FP"])


@query("st5_shared_groups", with_views("cand") + _TWO_SQL + "SELECT tic_id FROM old INTERSECT SELECT tic_id FROM new")
def _(spark, sf):
    return cat.shared_groups(*_two(spark, sf), "tic_id")


@query("st6_distinct_ids", with_views("cand") + "SELECT DISTINCT tic_id FROM cand")
def _(spark, sf):
    return cat.distinct_ids(views.cand(spark, sf))


# ---- order ----------------------------------------------------------------------


@query(
    "sl1_sort_by_sde",
    with_views("cand") + f"SELECT {CK}, {sql_r6('sde')} AS sde FROM cand ORDER BY cand.sde DESC, tic_id, sector, planet_num",
)
def _(spark, sf):
    return rounded(cat.sort_by_sde(views.cand(spark, sf)).select("tic_id", "sector", "planet_num", "sde"))


_TOP = "ORDER BY {0} DESC, tic_id, sector, planet_num LIMIT {1}"


@query("sl2_top_by_sde", with_views("cand") + f"SELECT {CK}, {sql_r6('sde')} AS s FROM cand WHERE sde >= 7 " + _TOP.format("sde", 200))
def _(spark, sf):
    return rounded(cat.top_by_sde(views.cand(spark, sf)).select("tic_id", "sector", "planet_num", F.col("sde").alias("s")))


@query(
    "sl3_top_by_score",
    with_views("cand") + f"SELECT {CK}, {sql_r6('sde * prob_pc')} AS score FROM cand WHERE sde >= 7 AND prob_pc > 0.85::DOUBLE "
    + _TOP.format("sde * prob_pc", 15),
)
def _(spark, sf):
    top = cat.top_by_score(views.cand(spark, sf), 15)
    return rounded(top.select("tic_id", "sector", "planet_num", (F.col("sde") * F.col("prob_pc")).alias("score")))


@query(
    "sl4_head",
    with_views("disp") + "SELECT upper(trim(disposition)) AS code, count(*) AS n FROM disp GROUP BY ALL ORDER BY n DESC, code LIMIT 15",
)
def _(spark, sf):
    return cat.code_counts(views.disp(spark, sf), 15)


@query("sl4_head_rows", with_views("cand") + f"SELECT {CK} FROM cand " + _TOP.format("period", 10))
def _(spark, sf):
    order = [F.col("period").desc(), "tic_id", "sector", "planet_num"]
    return rounded(cat.head(views.cand(spark, sf), 10, order).select("tic_id", "sector", "planet_num"))


@query(
    "sl5_best_of",
    with_views("cand") + "SELECT tic_id, " + f"{sql_r6('max(sde)')} AS sde, {sql_r6('arg_max(period, {0})')} AS period FROM cand GROUP BY tic_id".replace(
        "{0}", "{'s': sde, 'p': -period}"
    ),
)
def _(spark, sf):
    return rounded(cat.best_of(views.cand(spark, sf), ["tic_id"], "sde", ["period"]))


@query(
    "sl6_page",
    with_views("cand") + f"SELECT {CK}, {sql_r6('sde')} AS s FROM cand ORDER BY sde DESC, tic_id, sector, planet_num LIMIT 20 OFFSET 60",
)
def _(spark, sf):
    order = [F.col("sde").desc(), "tic_id", "sector", "planet_num"]
    return rounded(cat.page(views.cand(spark, sf), order, 3).select("tic_id", "sector", "planet_num", F.col("sde").alias("s")))


@query(
    "wn7_rank_by",
    with_views("cand") + f"SELECT {CK}, row_number() OVER (ORDER BY sde * prob_pc DESC, tic_id, sector, planet_num) AS rank "
    "FROM cand QUALIFY rank <= 50",
)
def _(spark, sf):
    ranked = cat.rank_by(views.cand(spark, sf), F.col("sde") * F.col("prob_pc"), 50)
    return rounded(ranked.select("tic_id", "sector", "planet_num", "rank"))


# ---- counts ---------------------------------------------------------------------

_TIER_SQL = "CASE WHEN prob_pc >= 0.90::DOUBLE THEN 'GOLD' WHEN prob_pc >= 0.70::DOUBLE THEN 'SILVER' ELSE 'BRONZE' END"


def _tiered(spark, sf):
    return views.cand(spark, sf).withColumns({
        "confidence_tier": rules.confidence_tier(F.col("prob_pc")),
        "disposition": F.when(F.col("predicted_class") == 0, "CONFIRMED_PLANET").otherwise("FALSE_ALARM"),
    })


@query("ag11_count_by", with_views("cand") + "SELECT status, count(*) AS n FROM cand GROUP BY status")
def _(spark, sf):
    return cat.count_by(views.cand(spark, sf), "status")


@query(
    "ag11_recent_counts",
    with_views("cand") + "SELECT status, count(*) AS n FROM (SELECT status FROM cand ORDER BY sde DESC, tic_id, sector, planet_num LIMIT 100) GROUP BY status",
)
def _(spark, sf):
    order = [F.col("sde").desc(), "tic_id", "sector", "planet_num"]
    return cat.recent_counts(views.cand(spark, sf), "status", order)


@query(
    "ag12_class_distribution",
    with_views("disp") + f", l AS (SELECT nullif({TFOP_SQL}, -1) AS label FROM disp), t AS (SELECT count(label) AS tot FROM l) "
    "SELECT CAST(c.i AS BIGINT) AS label, c.name, count(l.label) AS n, "
    f"{sql_r6('100.0::DOUBLE * count(l.label) / any_value(tot)')} AS pct FROM (VALUES (0, 'PC'), (1, 'EB'), (2, 'Blend'), (3, 'StellarVar')) c(i, name) "
    "CROSS JOIN t LEFT JOIN l ON l.label = c.i GROUP BY ALL",
)
def _(spark, sf):
    from photospark.functions.labels import map_label_tfop

    label = F.nullif(map_label_tfop(F.col("disposition")), F.lit(-1))
    return rounded(cat.class_distribution(views.disp(spark, sf).select(label.alias("label"))))


@query(
    "ag13_kpi",
    with_views("cand") + f"SELECT count(*) AS total, count(*) FILTER (WHERE {_TIER_SQL} = 'GOLD') AS gold, "
    f"count(*) FILTER (WHERE predicted_class = 0) AS planets, {sql_r6('coalesce(avg(sde), 0)')} AS avg_sde FROM cand",
)
def _(spark, sf):
    return rounded(cat.kpi(_tiered(spark, sf)))


@query(
    "ag14_tier_counts",
    with_views("cand") + "SELECT count(*) AS total, count(*) FILTER (WHERE prob_pc >= 0.9::DOUBLE) AS gold, "
    "count(*) FILTER (WHERE prob_pc >= 0.7::DOUBLE AND prob_pc < 0.9::DOUBLE) AS silver FROM cand",
)
def _(spark, sf):
    return cat.tier_counts(views.cand(spark, sf))


def _hist_sql(source, x, low, high, bins):
    w = (high - low) / bins
    return (
        f"SELECT CAST(i AS BIGINT) AS bin, {sql_r6(f'{low}::DOUBLE + i * {w!r}::DOUBLE')} AS bin_start, coalesce(n, 0) AS n "
        f"FROM range({bins}) r(i) LEFT JOIN (SELECT least(floor(({x} - {low}::DOUBLE) / {w!r}::DOUBLE), {bins - 1}) AS b, count(*) AS n "
        f"FROM {source} WHERE {x} BETWEEN {low} AND {high} GROUP BY b) h ON h.b = r.i"
    )


@query("ag26_sde_histogram", with_views("cand") + _hist_sql("cand", "sde", 0.0, 20.0, 100))
def _(spark, sf):
    return rounded(cat.histogram(views.cand(spark, sf), "sde", 0.0, 20.0, 100))


@query(
    "ag26_period_histogram",
    with_views("cand") + ", f AS (SELECT least(greatest(period, 0.0), 30.0) AS p FROM cand WHERE sde >= 7) " + _hist_sql("f", "p", 0.0, 30.0, 60),
)
def _(spark, sf):
    full = views.cand(spark, sf).filter(rules.sde_tier(F.col("sde")) == "FULL_PIPELINE")
    return rounded(cat.histogram(full, "period", 0.0, 30.0, 60, clip=True))


_FEATURES = ("sde", "period", "depth", "duration")


@query(
    "ag27_describe_features",
    with_views("cand") + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, {sql_r6(f'avg({c})')} AS mean, {sql_r6(f'stddev_samp({c})')} AS std, "
        f"{sql_r6(f'min({c})')} AS min, {sql_r6(f'max({c})')} AS max, {sql_r6(f'quantile_cont({c}, 0.25)')} AS p25, "
        f"{sql_r6(f'quantile_cont({c}, 0.5)')} AS p50, {sql_r6(f'quantile_cont({c}, 0.75)')} AS p75 FROM cand" for c in _FEATURES
    ),
)
def _(spark, sf):
    return rounded(cat.describe_features(views.cand(spark, sf), _FEATURES))


@query("ag29_tally", with_views("cand") + "SELECT count(*) FILTER (WHERE status = 'F') AS n, count(*) AS total FROM cand")
def _(spark, sf):
    return cat.tally(views.cand(spark, sf), "status", "F")


@query("ag30_sector_counts", with_views("cand") + "SELECT CAST(sector AS BIGINT) AS sector, count(*) AS n FROM cand GROUP BY sector")
def _(spark, sf):
    return rounded(cat.sector_counts(views.cand(spark, sf)))


@query(
    "pr25_search_candidates",
    with_views("cand") + f"SELECT {CK}, {_TIER_SQL} AS confidence_tier FROM cand WHERE contains(CAST(tic_id AS VARCHAR), '12') AND {_TIER_SQL} = 'GOLD'",
)
def _(spark, sf):
    found = cat.search_candidates(_tiered(spark, sf), "12", "GOLD")
    return rounded(found.select("tic_id", "sector", "planet_num", "confidence_tier"))


@query(
    "pr25_search_counts",
    with_views("cand") + f"SELECT count(*) FILTER (WHERE contains(CAST(tic_id AS VARCHAR), '12') AND {_TIER_SQL} = 'GOLD') AS filtered, count(*) AS total FROM cand",
)
def _(spark, sf):
    return cat.search_counts(_tiered(spark, sf), "12", "GOLD")


@query("pr26_candidate_by_id", with_views("cand") + f"SELECT {CK} FROM cand WHERE tic_id = 77")
def _(spark, sf):
    return rounded(cat.candidate_by_id(views.cand(spark, sf), " 7 7 ").select("tic_id", "sector", "planet_num"))


@query(
    "pr11_resolve_columns",
    "SELECT o_custkey AS tic_id, CAST(1 AS BIGINT) AS sector, "
    f"{sql_r6('o_totalprice')} AS period, 't0,sde,snr,depth,duration' AS missing FROM orders",
)
def _(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("TIC ID"), F.lit(1).alias("SECTOR"), F.col("o_totalprice").alias("tls_period")
    )
    renamed, missing = cat.resolve_columns(raw)
    return rounded(renamed.withColumn("missing", F.lit(",".join(missing))))


@query("pr24_detail_eligible", with_views("cand") + f"SELECT {CK} FROM cand WHERE {_TIER_SQL} = 'GOLD' AND sde >= 7")
def _(spark, sf):
    rows = _tiered(spark, sf)
    return rounded(rows.filter(rules.detail_eligible(F.col("confidence_tier"), F.col("sde"))).select("tic_id", "sector", "planet_num"))
