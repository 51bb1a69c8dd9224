"""Known planets, published parameters, injected signals, template fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from photospark.functions import rules
from photospark.operators import recovery
from verification import views
from verification.model_queries import draw_sql, uniform_sql
from verification.registry import query, rounded, sql_r6, table
from verification.search_queries import DURATIONS, PERIOD_SQL, PERIODS, SEARCH_SQL, bins_sql
from verification.views import DIP_DURATION_US, with_views


def _known(spark, sf):
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("system"), (n * 7).cast("bigint").alias("tic_id"), (F.lit(3.0) + n).alias("known_period")
    )


_KNOWN = (
    "known AS (SELECT n_name AS system, (n_nationkey * 7)::BIGINT AS tic_id, 3.0::DOUBLE + n_nationkey AS known_period FROM nation), "
    "hits AS (SELECT k.system, count(c.tic_id) AS n FROM known k LEFT JOIN cand c ON c.tic_id = k.tic_id AND abs(c.period - known_period) / known_period < 0.1::DOUBLE "
    "AND c.sde >= 5 GROUP BY k.system)"
)


def _gated(spark, sf):
    return views.cand(spark, sf).withColumn("disposition", rules.sde_tier(F.col("sde")))


@query("jn7_match_known", with_views("cand") + f", {_KNOWN} SELECT system, tic_id, known_period, n AS n_matches, n > 0 AS recovered FROM known JOIN hits USING (system)")
def _(spark, sf):
    return rounded(recovery.match_known(_gated(spark, sf), _known(spark, sf), 0.1))


@query("dm22_recovery_report", with_views("cand") + f", {_KNOWN} SELECT count(*) FILTER (WHERE n > 0) AS n_recovered, count(*) AS n, bool_and(n > 0) AS passed FROM hits")
def _(spark, sf):
    return recovery.recovery_passed(recovery.recovery_report(_gated(spark, sf), _known(spark, sf), 0.1))


_PUB = "pub AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r[0]}', {r[3]!r}::DOUBLE, {r[5]!r}::DOUBLE, {r[6]!r}::DOUBLE, '{r[9]}')" for r in recovery.PUBLISHED
) + ") v(target, p_period, p_depth, p_dur, source))"
_TARGETS = "[" + ", ".join(f"'{r[0]}'" for r in recovery.PUBLISHED) + "]"
_FITS = f"""fits AS (SELECT s_suppkey, {_TARGETS}[1 + s_suppkey % 7] AS target, s_acctbal AS x FROM supplier),
cmp0 AS (SELECT *, p_period * (1.0::DOUBLE + x / 5000000.0::DOUBLE) AS period, p_depth * (1.0::DOUBLE + x / 100000.0::DOUBLE) AS depth_ppm,
  p_dur * (1.0::DOUBLE + x / 77777.0::DOUBLE) AS duration_days FROM fits JOIN pub USING (target)),
cmp AS (SELECT *, abs(period - p_period) / p_period AS e1, abs(depth_ppm - p_depth) / p_depth AS e2, abs(duration_days - p_dur) / p_dur AS e3 FROM cmp0)"""


def _fits(spark, sf, published):
    names = F.array(*[F.lit(r[0]) for r in recovery.PUBLISHED])
    x = F.col("s_acctbal")
    fits = table(spark, sf, "supplier").select("s_suppkey", F.get(names, (F.col("s_suppkey") % 7).cast("int")).alias("target"), "s_acctbal")
    truth = published.select("target", "period", "depth_ppm", "duration_days")
    return fits.join(truth, "target").select(
        "s_suppkey", "target", (F.col("period") * (F.lit(1.0) + x / 5000000.0)).alias("period"),
        (F.col("depth_ppm") * (F.lit(1.0) + x / 100000.0)).alias("depth_ppm"),
        (F.col("duration_days") * (F.lit(1.0) + x / 77777.0)).alias("duration_days"),
    )


@query(
    "jn8_compare_published",
    f"WITH {_PUB}, {_FITS} SELECT s_suppkey, target, round(e1 * 100, 4) + 0.0 AS period_error_pct, round(e2 * 100, 4) + 0.0 AS depth_ppm_error_pct, "
    "round(e3 * 100, 4) + 0.0 AS duration_days_error_pct, e1 < 0.001::DOUBLE AS period_pass, e2 < 0.05::DOUBLE AS depth_ppm_pass, e3 < 0.1::DOUBLE AS duration_days_pass, "
    "e1 < 0.001::DOUBLE AND e2 < 0.05::DOUBLE AND e3 < 0.1::DOUBLE AS overall_pass FROM cmp",
)
def _(spark, sf):
    published = recovery.published_parameters(spark)
    compared = recovery.compare_published(_fits(spark, sf, published), published)
    return rounded(compared.drop("period", "depth_ppm", "duration_days"))


@query(
    "dm23_validation_report",
    f"WITH {_PUB}, {_FITS} SELECT pub.target, pub.source, s_suppkey, CASE WHEN s_suppkey IS NULL THEN 'MISSING' WHEN e1 < 0.001::DOUBLE AND e2 < 0.05::DOUBLE "
    "AND e3 < 0.1::DOUBLE THEN 'PASS' ELSE 'FAIL' END AS status FROM pub LEFT JOIN cmp ON cmp.target = pub.target",
)
def _(spark, sf):
    published = recovery.published_parameters(spark)
    report = recovery.validation_report(_fits(spark, sf, published), published)
    return report.select("target", "source", "s_suppkey", "status")


@query(
    "ag23_completeness_fraction",
    with_views("cand") + f"SELECT floor(depth * 1000) AS depth_ppm, {sql_r6('t0')} AS period, count(*) FILTER (WHERE sde >= 7 AND abs(fp - t0) / nullif(t0, 0) < 0.01::DOUBLE) AS recovered, "
    f"count(*) AS trials, {sql_r6('avg(CASE WHEN sde >= 7 AND abs(fp - t0) / nullif(t0, 0) < 0.01::DOUBLE THEN 1.0 ELSE 0.0 END)')} AS fraction "
    "FROM (SELECT *, t0 * (1.0::DOUBLE + prob_pc / 50.0::DOUBLE) AS fp FROM cand) GROUP BY ALL",
)
def _(spark, sf):
    trials = views.cand(spark, sf).select(
        F.floor(F.col("depth") * 1000).cast("double").alias("depth_ppm"), F.col("t0").alias("period"),
        (F.col("t0") * (F.lit(1.0) + F.col("prob_pc") / 50.0)).alias("found_period"), "sde",
    )
    return rounded(recovery.completeness_fraction(trials))


_DEPTHS, _PERIODS, _TRIALS = (20000.0, 300000.0), (2.5, 7.3), 3
_DUR = (
    "period / pi() * asin(greatest(least(1.0::DOUBLE / 15.0 * sqrt(greatest((rp + 1.0) * (rp + 1.0) - (15.0::DOUBLE * cos(radians(89.5::DOUBLE))) * (15.0::DOUBLE * cos(radians(89.5::DOUBLE))), 0.0)) "
    "/ sin(radians(89.5::DOUBLE)), 1.0), -1.0))"
)


@query(
    "dm19_completeness_map",
    with_views("lc") + f""", ser AS (SELECT * FROM lc WHERE NOT isnan(flux)),
sts AS (SELECT tic_id, sector, min(time) AS first FROM ser GROUP BY ALL),
so AS (SELECT *, row_number() OVER (ORDER BY {draw_sql('star', 'tic_id', 'sector')}, tic_id) AS no FROM sts),
tg AS (SELECT d, p, (i * {len(_PERIODS)} + j) * {_TRIALS} + k AS trial FROM (VALUES {', '.join(f'({i}, {d!r}::DOUBLE)' for i, d in enumerate(_DEPTHS))}) a(i, d),
  (VALUES {', '.join(f'({j}, {p!r}::DOUBLE)' for j, p in enumerate(_PERIODS))}) b(j, p), range({_TRIALS}) c(k)),
tt AS (SELECT trial, d AS depth_ppm, p AS period, so.tic_id AS star, first + {uniform_sql('epoch', 'trial')} * p AS t0, sqrt(d * 1e-6::DOUBLE) AS rp
  FROM tg JOIN so ON so.no = {draw_sql('trial', 'trial')} % (SELECT count(*) FROM so) + 1),
td AS (SELECT *, {_DUR} AS dur FROM tt),
pts AS (SELECT trial AS tic_id, time_us, flux * CASE WHEN ((time - t0 + dur / 2.0) % period + period) % period < dur THEN 1.0::DOUBLE - depth_ppm * 1e-6::DOUBLE ELSE 1.0 END AS flux,
  1.0::DOUBLE / (flux_err * flux_err) AS w FROM td JOIN ser ON ser.tic_id = td.star),
grid AS ({PERIOD_SQL}), trials AS (SELECT pts.*, p FROM pts, grid),""" + bins_sql("trials", "tic_id", str(DIP_DURATION_US)) + SEARCH_SQL
    + f"SELECT depth_ppm, tt.period, count(*) FILTER (WHERE sde >= 7 AND abs(sig.period - tt.period) / tt.period < 0.01::DOUBLE) AS recovered, count(*) AS trials, "
    f"{sql_r6('avg(CASE WHEN sde >= 7 AND abs(sig.period - tt.period) / tt.period < 0.01::DOUBLE THEN 1.0 ELSE 0.0 END)')} AS fraction FROM tt LEFT JOIN sig ON sig.tic_id = tt.trial GROUP BY ALL",
)
def _(spark, sf):
    series = views.lc(spark, sf).filter(~F.isnan("flux"))
    return rounded(recovery.completeness_map(series, PERIODS, DURATIONS, list(_DEPTHS), list(_PERIODS), _TRIALS))


_GRID_D, _GRID_S, _GRID_I = (0.5, 1.0, 1.5), (-0.5, 0.0, 0.5), (0.1, 0.5, 1.0)


@query(
    "dm20_template_fit",
    with_views("view64") + f""", vw AS (SELECT vec_id, list_transform(v, lambda x: 1.0::DOUBLE + x) AS v, 2.0::DOUBLE + vec_id % 3 AS period, 0.3::DOUBLE + (vec_id % 4) / 10.0::DOUBLE AS dur FROM view64),
b AS (SELECT vec_id, i, v[i + 1] AS f, 1.0::DOUBLE - v[i + 1] AS dr, -0.5::DOUBLE + (i + 0.5::DOUBLE) / 64 AS ph, period, dur FROM vw, range(64) r(i)),
er AS (SELECT vec_id, CASE WHEN stddev_pop(f) * 0.5 < 1e-6 THEN 1e-4::DOUBLE ELSE stddev_pop(f) * 0.5::DOUBLE END AS err, sum(dr * dr) AS dd FROM b GROUP BY vec_id),
t AS (SELECT b.*, d, s, g, least(d * (dur / period) / 2.0, 0.5) AS half FROM b, (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in _GRID_D)}) a(d),
  (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in _GRID_S)}) bb(s), (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in _GRID_I)}) c(g)),
sh AS (SELECT vec_id, d, s, g, dr, dur, period, least(greatest((half - abs(ph - s * (dur / period))) / greatest(half * g, 1e-12), 0.0), 1.0) AS q FROM t),
ag AS (SELECT vec_id, d, s, g, any_value(dur) AS dur, any_value(period) AS period, sum(q * q) AS qq, sum(q * dr) AS qd FROM sh GROUP BY vec_id, d, s, g),
fi AS (SELECT *, CASE WHEN qq > 0 THEN greatest(least(qd / qq, 0.25), 0.0) ELSE 0.0 END AS depth FROM ag),
ch AS (SELECT fi.*, (dd - 2.0 * depth * qd + depth * depth * qq) / (err * err) AS chi2 FROM fi JOIN er USING (vec_id)),
be AS (SELECT vec_id, arg_min({{'d': d, 's': s, 'g': g, 'depth': depth, 'dur': dur, 'period': period, 'chi2': chi2}}, {{'c': round(chi2, 9), 'd': d, 's': s, 'g': g}}) AS x FROM ch GROUP BY vec_id)
SELECT vec_id, {sql_r6('x.period')} AS period, {sql_r6('sqrt(x.depth)')} AS rp_rs, {sql_r6('x.depth')} AS depth, {sql_r6('x.d * x.dur')} AS duration, {sql_r6('x.s * x.dur')} AS t0_shift,
{sql_r6('x.g')} AS ingress, {sql_r6('x.chi2', 4)} AS chi2, {sql_r6('x.chi2 / 60', 4)} AS chi2_red FROM be""",
)
def _(spark, sf):
    df = views.view64(spark, sf).select(
        "vec_id", F.transform("v", lambda x: F.lit(1.0) + x).alias("global_view"), (F.lit(2.0) + F.col("vec_id") % 3).alias("period"),
        (F.lit(0.3) + (F.col("vec_id") % 4) / 10.0).alias("duration"),
    )
    fitted = recovery.template_fit(df, df, _GRID_D, _GRID_S, _GRID_I, keys=("vec_id",))
    return rounded(fitted.withColumns({"chi2": F.round("chi2", 4), "chi2_red": F.round("chi2_red", 4)}))
