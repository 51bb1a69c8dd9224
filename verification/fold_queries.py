"""Folding, views, features, pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from photospark.operators import clean, features, fold
from verification import views
from verification.catalogue_queries import CK
from verification.registry import query, rounded, sql_r6, table
from verification.views import with_views

KEY = ("tic_id", "sector", "planet_num")


def phase_sql(t="time", p="period", t0="t0"):
    m = f"({t} - {t0})"
    return f"((CASE WHEN {m} % {p} < 0 THEN ({m} % {p} + {p}) % {p} ELSE {m} % {p} END) / {p})"


def bins_sql(series: str, cands: str, n_global: int = 2001, n_local: int = 201, keys: str = CK, on: str = "tic_id, sector",
             width: str = "least(2.0::DOUBLE * (duration / period), 0.25::DOUBLE)") -> str:
    """CTEs ``ph``, ``binned`` (keys, view, bin, value): medians per phase bin."""
    return f"""
ph0 AS (SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, s.flux, {phase_sql('s.time', 'c.period', 'c.t0')} AS p01,
  {width} AS hw FROM {cands} c JOIN {series} s USING ({on})),
ph AS (SELECT *, CASE WHEN p01 > 0.5 THEN p01 - 1.0::DOUBLE ELSE p01 END AS p FROM ph0),
binned AS (
  SELECT {keys}, 'global' AS view, CAST(floor((p + 0.5::DOUBLE) * {n_global}) AS BIGINT) AS bin, median(flux) AS value
  FROM ph WHERE p < 0.5 GROUP BY ALL
  UNION ALL
  SELECT {keys}, 'local' AS view, CAST(least(floor((p + hw) / (hw * 2.0::DOUBLE) * {n_local}), {n_local - 1}) AS BIGINT) AS bin, median(flux)
  FROM ph WHERE p >= -hw AND p < hw GROUP BY ALL)"""


def normal_sql(keys: str = CK, n_global: int = 2001, n_local: int = 201, flip: bool = False) -> str:
    """CTE ``norm`` (keys, view, bin, x): full views, empty bins 0, median 0 and minimum -1."""
    scale = "CASE WHEN mn < -1e-10 THEN abs(mn) " + ("WHEN mn > 1e-10 THEN -abs(mn) " if flip else "") + "ELSE 1.0 END"
    return f"""
spine AS (SELECT DISTINCT {keys}, v.view, unnest(range(v.n)) AS bin FROM binned, (VALUES ('global', {n_global}), ('local', {n_local})) v(view, n)),
filled AS (SELECT {keys}, view, bin, coalesce(value, 0.0) AS value FROM spine LEFT JOIN binned USING ({keys}, view, bin)),
mids AS (SELECT {keys}, view, median(value) AS med, min(value) AS low FROM filled GROUP BY ALL),
norm AS (SELECT {keys}, view, bin, (value - med) / {scale} AS x FROM (SELECT *, low - med AS mn FROM filled JOIN mids USING ({keys}, view)))"""


def _long(folded, keys=KEY):
    return rounded(fold.explode_views(folded, keys, "x"))


CAND5 = "c5 AS (SELECT * FROM cand WHERE sde >= 5)"


@query(
    "ag4_phase_bin",
    with_views("lc_dip", "cand") + "," + bins_sql("lc_dip", "cand", 101, 21) + f" SELECT {CK}, view, bin, {sql_r6('value', 9)} AS value FROM binned",
)
def _(spark, sf):
    return rounded(fold.phase_bin(views.lc_dip(spark, sf), views.cand(spark, sf), 101, 21), 9)


@query(
    "dm7_phase_fold",
    with_views("lc_dip", "cand") + f", {CAND5}," + bins_sql("lc_dip", "c5") + "," + normal_sql() + f" SELECT {CK}, view, bin, {sql_r6('x')} AS x FROM norm",
)
def _(spark, sf):
    return _long(fold.phase_fold(views.lc_dip(spark, sf), views.cand(spark, sf)))


_TOI_SQL = f""", m AS (SELECT tic_id, sector, median(flux) AS m FROM lc_dip GROUP BY ALL),
sc AS (SELECT l.* REPLACE (flux / m AS flux) FROM lc_dip l JOIN m USING (tic_id, sector) WHERE m > 0),
sd AS (SELECT tic_id, sector, stddev_pop(flux) AS s FROM sc GROUP BY ALL),
k AS (SELECT sc.* FROM sc JOIN sd USING (tic_id, sector) WHERE abs(flux - 1.0::DOUBLE) < 5 * s),
kk AS (SELECT * FROM k WHERE tic_id IN (SELECT tic_id FROM k GROUP BY tic_id HAVING count(*) >= 50)),
""" + bins_sql("kk", "cand", 401, 101, width="CASE WHEN least(2.0::DOUBLE * (duration / period), 0.25::DOUBLE) < 0.005::DOUBLE THEN 0.05::DOUBLE ELSE least(2.0::DOUBLE * (duration / period), 0.25::DOUBLE) END")


@query(
    "dm8_phase_fold_toi",
    with_views("lc_dip", "cand") + _TOI_SQL + "," + normal_sql(CK, 401, 101, True) + f" SELECT {CK}, view, bin, {sql_r6('x')} AS x FROM norm",
)
def _(spark, sf):
    return _long(fold.phase_fold_toi(views.lc_dip(spark, sf), views.cand(spark, sf), 401, 101))


_EVENT_LABEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'PC' WHEN '2-HIGH' THEN 'AFP' WHEN '3-MEDIUM' THEN 'NTP' WHEN '5-LOW' THEN 'BLEND' ELSE '' END"


@query(
    "dm9_build_training_views",
    with_views("lc_user") + f""", ev AS (SELECT o_custkey AS tic_id, o_orderkey AS event_id, 0.5::DOUBLE + (o_orderkey % 2950) / 100.0::DOUBLE AS period,
  (o_orderkey % 100) / 50.0::DOUBLE AS t0, 0.05::DOUBLE + (o_orderkey % 20) / 100.0::DOUBLE AS duration, {_EVENT_LABEL} AS lt FROM orders),
lb AS (SELECT *, CASE lt WHEN 'PC' THEN 0 WHEN 'AFP' THEN 1 WHEN 'NTP' THEN 3 ELSE 2 END AS label FROM ev WHERE lt <> ''),
fin AS (SELECT * FROM lc_user WHERE NOT isnan(flux) AND tic_id IN (SELECT tic_id FROM lb)),
m AS (SELECT tic_id, median(flux) AS m FROM fin GROUP BY tic_id HAVING count(*) >= 60 AND median(flux) > 0),
ser AS (SELECT fin.* REPLACE (flux / m AS flux) FROM fin JOIN m USING (tic_id)),
""" + bins_sql("ser", "lb", 101, 21, "tic_id, event_id", "tic_id") + "," + normal_sql("tic_id, event_id", 101, 21, True)
    + f" SELECT tic_id, event_id, CAST(label AS BIGINT) AS label, view, bin, {sql_r6('x')} AS x FROM norm JOIN lb USING (tic_id, event_id)",
)
def _(spark, sf):
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    text = F.when(priority == "1-URGENT", "PC").when(priority == "2-HIGH", "AFP").when(priority == "3-MEDIUM", "NTP")
    events = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("tic_id"), key.alias("event_id"),
        (F.lit(0.5) + (key % 2950) / 100.0).alias("period"), ((key % 100) / 50.0).alias("t0"),
        (F.lit(0.05) + (key % 20) / 100.0).alias("duration"),
        text.when(priority == "5-LOW", "BLEND").otherwise("").alias("label_text"),
    )
    folded = fold.build_training_views(events, views.lc_user(spark, sf), "kepler", 101, 21, min_points=60)
    return _long(folded, ("tic_id", "event_id", "label"))


# ---- single views ---------------------------------------------------------------


def _bins(df, column, *keys):
    return rounded(fold.explode_view(df, column, keys, "x"))


@query(
    "ag5_normalise_view",
    with_views("view64") + """, c AS (SELECT vec_id, list_transform(v, lambda x: x - list_median(v)) AS c FROM view64)
SELECT vec_id, unnest(range(len(c))) AS bin, round(unnest(list_transform(c, lambda x: CASE WHEN list_min(c) < -1e-10 THEN x / abs(list_min(c)) ELSE x END)), 6) + 0.0 AS x FROM c""",
)
def _(spark, sf):
    df = views.view64(spark, sf).withColumn("n", fold.normalise_view(F.col("v")))
    return _bins(df, "n", "vec_id")


@query(
    "wn6_shift_view",
    with_views("view64") + """, k AS (SELECT vec_id, v, vec_id % 11 - 5 AS k FROM view64)
SELECT vec_id, i AS bin, round(v[least(greatest(i - k, 0), len(v) - 1) + 1], 6) + 0.0 AS x FROM k, range(64) r(i)""",
)
def _(spark, sf):
    df = views.view64(spark, sf).withColumn("s", fold.shift_view(F.col("v"), (F.col("vec_id") % 11 - 5).cast("int")))
    return _bins(df, "s", "vec_id")


_SEC_SQL = "greatest(list_median(v[17:28]) - list_median(list_concat(v[1:3], v[62:64])), 0.0)"
_VSHAPE_SQL = """
b AS (SELECT vec_id, v, list_min(v) AS low, 1.0::DOUBLE - list_min(v) AS depth,
  list_filter(range(1, 65), lambda i: v[i] < 1.0::DOUBLE - (1.0::DOUBLE - list_min(v)) / 2.0) AS idx FROM u)"""
_UNIT = "u AS (SELECT vec_id, list_transform(v, lambda x: 1.0::DOUBLE + x * 2) AS v FROM view64)"


@query(
    "ag8_secondary_depth",
    with_views("view64") + f" SELECT vec_id, {sql_r6(_SEC_SQL)} AS depth FROM view64",
)
def _(spark, sf):
    return rounded(views.view64(spark, sf).select("vec_id", features.secondary_depth(F.col("v")).alias("depth")))


@query(
    "ag9_v_shape",
    with_views("view64") + f", {_UNIT}, {_VSHAPE_SQL} SELECT vec_id, "
    + sql_r6("CASE WHEN depth < 1e-5 THEN 0.0 WHEN len(idx) = 0 THEN 1.0 ELSE 1.0::DOUBLE - len(list_filter(v, lambda x: x < low + depth * 0.1::DOUBLE)) / (list_max(idx) - list_min(idx) + 1)::DOUBLE END")
    + " AS v_shape FROM b",
)
def _(spark, sf):
    unit = F.transform("v", lambda x: F.lit(1.0) + x * 2)
    return rounded(views.view64(spark, sf).select("vec_id", unit.alias("v")).select("vec_id", features.v_shape(F.col("v")).alias("v_shape")))


@query(
    "ag10_view_features",
    with_views("view64") + f""", {_UNIT}, f AS (SELECT vec_id, v, list_min(v) AS low, 1.0::DOUBLE - list_min(v) AS depth,
  list_avg(v) AS mean, 1.0::DOUBLE + vec_id % 9 AS period, 0.1::DOUBLE AS duration FROM u),
g AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / 64) AS sd,
  greatest(len(list_filter(v, lambda x: x < 1.0::DOUBLE - depth / 2.0)), 1) AS total, len(list_filter(v, lambda x: x < low + depth * 0.1::DOUBLE)) AS flat FROM f)
SELECT vec_id, {sql_r6('abs(list_median(v[33:37]) - list_median(v[28:32])) / greatest(sd / sqrt(5.0), 1e-10)')} AS odd_even_depth_diff,
{sql_r6(_SEC_SQL)} AS secondary_eclipse_depth,
{sql_r6('CASE WHEN depth > 1e-5 THEN greatest(least(1.0::DOUBLE - flat / total::DOUBLE, 1.0), 0.0) ELSE 0.0 END')} AS v_shape_metric,
{sql_r6('duration / period')} AS duration_period_ratio, {sql_r6('vec_id * 1e-6::DOUBLE / 0.001::DOUBLE')} AS depth_snr, {sql_r6('depth')} AS transit_depth FROM g""",
)
def _(spark, sf):
    unit = F.transform("v", lambda x: F.lit(1.0) + x * 2)
    df = views.view64(spark, sf).select(
        "vec_id", unit.alias("global_view"), unit.alias("local_view"), (F.lit(1.0) + F.col("vec_id") % 9).alias("period"),
        F.lit(0.1).alias("duration"), F.col("vec_id").cast("double").alias("depth_ppm"), F.lit(0.001).alias("median_flux_err"),
    )
    found = features.view_features(df)
    return rounded(found.drop("period", "duration", "depth_ppm", "median_flux_err"))


# ---- series features ------------------------------------------------------------

_ODD_EVEN = f"""
hit AS (SELECT c.tic_id, c.sector, c.planet_num, s.flux, CAST(((CAST(round_even((s.time - c.t0) / c.period, 0) AS BIGINT) % 2) + 2) % 2 AS INT) AS par
  FROM {{cands}} c JOIN {{series}} s USING (tic_id, sector)
  WHERE {phase_sql('s.time', 'c.period', 'c.t0')} < c.duration / c.period / 2.0 OR {phase_sql('s.time', 'c.period', 'c.t0')} > 1.0::DOUBLE - c.duration / c.period / 2.0),
oe AS (SELECT {CK}, count(*) FILTER (WHERE par = 1) AS no, count(*) FILTER (WHERE par = 0) AS ne, median(flux) FILTER (WHERE par = 1) AS mo,
  median(flux) FILTER (WHERE par = 0) AS me, stddev_pop(flux) FILTER (WHERE par = 1) AS so, stddev_pop(flux) FILTER (WHERE par = 0) AS se FROM hit GROUP BY ALL),
oes AS (SELECT {CK}, CASE WHEN no < 3 OR ne < 3 OR so * so / no + se * se / ne = 0 THEN 0.0
  ELSE abs(me - mo) / sqrt(so * so / no + se * se / ne) END AS sig FROM oe)"""


@query(
    "ag7_odd_even_sigma",
    with_views("lc_dip", "cand") + "," + _ODD_EVEN.format(cands="cand", series="lc_dip")
    + f" SELECT {CK}, {sql_r6('coalesce(sig, 0.0)')} AS odd_even_depth_diff FROM cand LEFT JOIN oes USING ({CK})",
)
def _(spark, sf):
    return rounded(features.odd_even_sigma(views.lc_dip(spark, sf), views.cand(spark, sf)))


_ZONE = f"abs(CASE WHEN {phase_sql('s.time', 'c.period', 'c.t0')} > 0.5 THEN {phase_sql('s.time', 'c.period', 'c.t0')} - 1.0::DOUBLE ELSE {phase_sql('s.time', 'c.period', 'c.t0')} END)"


@query(
    "ag6_transit_preserved",
    with_views("lc_dip", "cand") + f""", z AS (SELECT c.tic_id, c.sector, c.planet_num, s.flux, {_ZONE} AS d, c.duration / c.period / 2.0 AS h
  FROM cand c JOIN lc_dip s USING (tic_id, sector)),
m AS (SELECT {CK}, count(*) FILTER (WHERE d <= h) AS n_in, count(*) FILTER (WHERE d > h AND d <= h * 3.0) AS n_out,
  median(flux) FILTER (WHERE d > h AND d <= h * 3.0) - median(flux) FILTER (WHERE d <= h) AS measured FROM z GROUP BY ALL)
SELECT {CK}, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, {sql_r6('measured', 9)} AS measured_depth,
coalesce(n_in >= 3 AND n_out >= 3 AND measured >= depth * 0.7::DOUBLE, FALSE) AS preserved FROM cand LEFT JOIN m USING ({CK})""",
)
def _(spark, sf):
    return rounded(clean.transit_preserved(views.lc_dip(spark, sf), views.cand(spark, sf)), 9)


@query(
    "wn4_transit_epochs",
    with_views("lc_user", "cand") + f""", sp AS (SELECT tic_id, sector, min(time) AS a, max(time) AS b FROM lc_user GROUP BY ALL),
e AS (SELECT {CK}, period, t0, unnest(range(CAST(ceil((a - t0) / period) AS BIGINT), CAST(floor((b - t0) / period) AS BIGINT) + 1)) AS epoch FROM cand JOIN sp USING (tic_id, sector))
SELECT {CK}, epoch, {sql_r6('t0 + epoch * period')} AS epoch_time FROM e""",
)
def _(spark, sf):
    return rounded(features.transit_epochs(views.lc_user(spark, sf), views.cand(spark, sf)))


_FEATURES_SQL = with_views("lc_dip", "cand") + f", {CAND5}," + bins_sql("lc_dip", "c5") + "," + normal_sql() + "," + _ODD_EVEN.format(
    cands="c5", series="lc_dip"
) + f""",
sec AS (SELECT {CK}, greatest(median(x) FILTER (WHERE bin >= 500 AND bin < 900) - median(x) FILTER (WHERE bin < 100 OR bin >= 1901), 0.0) AS sd
  FROM norm WHERE view = 'global' GROUP BY ALL),
lo AS (SELECT {CK}, min(x) AS low, 1.0::DOUBLE - min(x) AS depth FROM norm WHERE view = 'local' GROUP BY ALL),
vs AS (SELECT {CK}, any_value(depth) AS depth, count(*) FILTER (WHERE x < low + depth * 0.1::DOUBLE) AS flat,
  max(bin) FILTER (WHERE x < 1.0::DOUBLE - depth / 2.0) - min(bin) FILTER (WHERE x < 1.0::DOUBLE - depth / 2.0) + 1 AS ext
  FROM norm JOIN lo USING ({CK}) WHERE view = 'local' GROUP BY ALL)
SELECT {CK}, {sql_r6('coalesce(sig, 0.0)')} AS odd_even_depth_diff, {sql_r6('coalesce(sd, 0.0)')} AS secondary_eclipse_depth, 0.0::DOUBLE AS centroid_shift_sigma,
{sql_r6('coalesce(CASE WHEN vs.depth < 1e-5 THEN 0.0 WHEN ext IS NULL THEN 1.0 ELSE 1.0::DOUBLE - flat / ext::DOUBLE END, 0.0)')} AS v_shape_metric,
1.0::DOUBLE AS crowdsap, {sql_r6('duration / period')} AS duration_period_ratio, {sql_r6('sde')} AS sde, {sql_r6('snr')} AS snr
FROM c5 LEFT JOIN oes USING ({CK}) LEFT JOIN sec USING ({CK}) LEFT JOIN (SELECT {CK}, depth, flat, ext FROM vs) vs USING ({CK})"""
_FEATURES_SQL = _FEATURES_SQL.replace("coalesce(CASE WHEN vs.depth", "coalesce(CASE WHEN flat IS NULL THEN 0.0 WHEN vs.depth")


@query("dm10_extract_features", _FEATURES_SQL)
def _(spark, sf):
    series, cands = views.lc_dip(spark, sf), views.cand(spark, sf)
    return rounded(features.extract_features(cands, series, fold.phase_fold(series, cands)))


# ---- pixels ---------------------------------------------------------------------

_CENTROID = f"""
fr AS (SELECT tic_id, sector, cadence, min(time) AS time, sum(flux * col) / sum(flux) AS cx, sum(flux * row) / sum(flux) AS cy FROM pixels GROUP BY ALL),
fi AS (SELECT c.tic_id, c.sector, c.planet_num, cx, cy,
  {phase_sql('f.time', 'c.period', 'c.t0')} < c.duration / c.period / 2.0 OR {phase_sql('f.time', 'c.period', 'c.t0')} > 1.0::DOUBLE - c.duration / c.period / 2.0 AS inside
  FROM {{cands}} c JOIN fr f USING (tic_id, sector)),
md AS (SELECT {CK}, count(*) FILTER (WHERE inside) AS n_in, count(*) FILTER (WHERE NOT inside) AS n_out,
  median(cx) FILTER (WHERE inside) AS xi, median(cy) FILTER (WHERE inside) AS yi, median(cx) FILTER (WHERE NOT inside) AS xo, median(cy) FILTER (WHERE NOT inside) AS yo FROM fi GROUP BY ALL),
sg AS (SELECT {CK}, stddev_pop(sqrt((cx - xo) * (cx - xo) + (cy - yo) * (cy - yo))) AS s FROM fi JOIN md USING ({CK}) WHERE NOT inside GROUP BY ALL),
cs AS (SELECT {CK}, n_in, n_out, CASE WHEN n_in >= 3 AND n_out >= 10 THEN sqrt((xi - xo) * (xi - xo) + (yi - yo) * (yi - yo)) ELSE 0.0 END AS shift,
  CASE WHEN n_in >= 3 AND n_out >= 10 AND s > 0 THEN sqrt((xi - xo) * (xi - xo) + (yi - yo) * (yi - yo)) / s ELSE 0.0 END AS sigma
  FROM md LEFT JOIN sg USING ({CK}))"""


@query(
    "ag24_centroid_stats",
    with_views("pixels", "star_cand") + "," + _CENTROID.format(cands="star_cand")
    + f" SELECT {CK}, n_in, n_out, {sql_r6('shift')} AS shift_pixels, {sql_r6('sigma')} AS centroid_shift_sigma FROM cs",
)
def _(spark, sf):
    return rounded(features.centroid_stats(views.pixels(spark, sf), views.star_cand(spark, sf)))


@query(
    "dm11_centroid_shift",
    with_views("pixels", "star_cand") + f", top AS (SELECT * FROM star_cand WHERE sde >= 7 ORDER BY sde DESC, {CK} LIMIT 200), todo AS (SELECT * FROM top WHERE NOT computed),"
    + _CENTROID.format(cands="todo") + f" SELECT {CK}, {sql_r6('coalesce(sigma, 0.0)')} AS centroid_shift_sigma, coalesce(sigma, 0.0) > 3 AS blend, TRUE AS centroid_computed FROM todo LEFT JOIN cs USING ({CK})",
)
def _(spark, sf):
    cands = views.star_cand(spark, sf).withColumnRenamed("computed", "centroid_computed")
    return rounded(features.centroid_shift(views.pixels(spark, sf), cands))
