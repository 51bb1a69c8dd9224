"""Period search: periodogram, best signal, consistency check, iterated search."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from photospark.operators import search
from photospark.schema import DAY_US
from verification import views
from verification.registry import query, rounded, sql_r6, table
from verification.views import DIP_DURATION_US, with_views

PERIODS = search.linear_period_grid(43_200_000_000, 2_583_200_000_000, 1001)
DURATIONS = [DIP_DURATION_US]

PERIOD_SQL = "SELECT 43200000000 + i * 2540000000 AS p FROM range(1001) r(i)"


def bins_sql(trials: str, keys: str, duration: str) -> str:
    """CTE text that folds ``pts`` over ``trials`` and scores all boxes; ends in ``scored`` and ``bestbox``."""
    return f"""
folded AS (SELECT {keys}, p, (p * 4 + {duration} - 1) // {duration} AS nb,
  (time_us % p) * ((p * 4 + {duration} - 1) // {duration}) // p AS b, count(*) AS n, sum(w) AS w, sum(w * flux) AS wf
  FROM {trials} GROUP BY ALL),
tot AS (SELECT {keys}, p, sum(w) AS w_all, sum(wf) AS wf_all FROM folded GROUP BY ALL),
boxes AS (SELECT {keys}, p, nb, (b - j + nb) % nb AS start_bin, sum(w) AS w_in, sum(wf) AS wf_in
  FROM folded, range(4) k(j) GROUP BY ALL),
depths AS (SELECT *, w_all - w_in AS w_out,
  CASE WHEN w_all - w_in > w_all * 1e-9 THEN (wf_all - wf_in) / (w_all - w_in) - wf_in / w_in ELSE 0.0 END AS depth
  FROM boxes JOIN tot USING ({keys}, p)),
scored AS (SELECT *, CASE WHEN depth > 0 THEN depth * depth * w_in * w_out / w_all ELSE 0.0 END AS power FROM depths),
bestbox AS (SELECT {keys}, p, nb, w_all, arg_max({{{{'start_bin': start_bin, 'depth': depth, 'w_in': w_in}}}},
  {{{{'a': round(power, 7), 'b': -start_bin}}}}) AS x, max(power) AS power FROM scored GROUP BY ALL)
""".replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}")


PTS = f""", pts AS (SELECT tic_id, time_us, flux, 1.0::DOUBLE / (flux_err * flux_err) AS w FROM lc_dip),
grid AS ({PERIOD_SQL}), trials AS (SELECT pts.*, p FROM pts, grid),""" + bins_sql(
    "trials", "tic_id", str(DIP_DURATION_US)
)


@query(
    "dm2_box_periodogram",
    with_views("lc_dip") + PTS + f"SELECT tic_id, p AS period_us, {sql_r6('power', 3)} AS power FROM bestbox",
)
def _(spark, sf):
    found = search.box_periodogram(views.lc_dip(spark, sf), PERIODS, DURATIONS)
    return rounded(found.select("tic_id", "period_us", "power"), 3)


# The folding tree in closed form: cycle r of M = 2^L turns by a share of drift j that its bits give.
TREE_SQL = f""", pts AS (SELECT tic_id, time_us, flux, 1.0::DOUBLE / (flux_err * flux_err) AS w FROM lc_dip),
tb AS (SELECT tic_id, CAST(floor(time_us / {DIP_DURATION_US // 4}) AS BIGINT) AS bin, sum(w) AS w, sum(w * flux) AS wf FROM pts GROUP BY ALL),
sp AS (SELECT tic_id, min(bin) AS b0, max(bin) - min(bin) + 1 AS n, sum(w) AS w_all, sum(wf) AS wf_all FROM tb GROUP BY ALL),
base AS (SELECT tic_id, b0, n, w_all, wf_all, CAST(p AS BIGINT) AS p, CAST(ceil(log2((n + p - 1) // p)) AS BIGINT) AS lev
  FROM sp, range({-(-DAY_US // 2 // (DIP_DURATION_US // 4))}, {30 * DAY_US // (DIP_DURATION_US // 4)} + 1) r(p) WHERE p <= n // 2),
levels AS (SELECT DISTINCT lev FROM base),
turns AS (SELECT lev, r, j, CAST(list_sum(list_transform(range(1, lev + 1), lambda l: ((r >> CAST(l - 1 AS INT)) & 1)
    * (((j >> CAST(lev - l AS INT)) + 1) >> 1))) AS BIGINT) AS s
  FROM levels, range(0, 1024) a(r), range(0, 1023) b(j) WHERE r < (1 << CAST(lev AS INT)) AND j < (1 << CAST(lev AS INT)) - 1),
placed AS (SELECT tb.tic_id, p, lev, (bin - b0) // p AS r, (bin - b0) % p AS c, w, wf FROM tb JOIN base USING (tic_id)),
folded AS (SELECT tic_id, p, lev, j, (c - s % p + p) % p AS b, sum(w) AS w, sum(wf) AS wf FROM placed JOIN turns USING (lev, r) GROUP BY ALL),
boxes AS (SELECT tic_id, p, lev, j, (b - k + p) % p AS start_bin, sum(w) AS w_in, sum(wf) AS wf_in FROM folded, range(4) q(k) GROUP BY ALL),
depths AS (SELECT *, w_all - w_in AS w_out,
  CASE WHEN w_all - w_in > w_all * 1e-9 THEN (wf_all - wf_in) / (w_all - w_in) - wf_in / w_in ELSE 0.0 END AS depth
  FROM boxes JOIN base USING (tic_id, p, lev)),
best AS (SELECT tic_id, p, lev, j, max(CASE WHEN depth > 0 THEN depth * depth * w_in * w_out / w_all ELSE 0.0 END) AS power FROM depths GROUP BY ALL),
tree AS (SELECT tic_id, CAST(round_even({DIP_DURATION_US // 4} * (p + j / ((1 << CAST(lev AS INT)) - 1)), 0) AS BIGINT) AS period_us, power FROM best)
"""


@query(
    "dm2_fast_periodogram",
    with_views("lc_dip") + TREE_SQL + f"SELECT tic_id, period_us, {sql_r6('power', 3)} AS power FROM tree",
)
def _(spark, sf):
    found = search.fast_periodogram(views.lc_dip(spark, sf), DURATIONS)
    return rounded(found.select("tic_id", "period_us", "power"), 3)


@query(
    "dm3_period_search_default_grid",
    with_views("lc_dip") + TREE_SQL + f"""SELECT tic_id, arg_max(period_us, {{'a': round(power, 7), 'b': -period_us}}) / {DAY_US}.0::DOUBLE AS period,
  {sql_r6('(max(power) - avg(power)) / stddev_pop(power)', 4)} AS sde FROM tree GROUP BY tic_id""",
)
def _(spark, sf):
    found = search.period_search(views.lc_dip(spark, sf), durations_us=DURATIONS)
    return found.select("tic_id", "period", F.round("sde", 4).alias("sde"))


SEARCH_SQL = f""",
spec AS (SELECT tic_id, arg_max({{'p': p, 'nb': nb, 'w': w_all, 'x': x, 'power': power}},
  {{'a': round(power, 7), 'b': -p}}) AS m, max(power) AS top, avg(power) AS mean, stddev_pop(power) AS sd
  FROM bestbox GROUP BY tic_id),
st AS (SELECT tic_id, count(*) AS n, min(time_us) AS t_first, sum(w * flux * flux) AS wff, sum(w * flux) AS wf
  FROM pts GROUP BY tic_id),
res AS (SELECT tic_id, m.p AS p, (m.x.start_bin + 2.0::DOUBLE) * m.p / m.nb AS centre, m.x.depth AS depth,
  (top - mean) / sd AS sde, m.x.w_in AS w_in, m.w AS w_all, t_first, n, wff - wf * wf / m.w - m.power AS chi2
  FROM spec JOIN st USING (tic_id) WHERE n >= 100),
sig AS (SELECT tic_id, p / {DAY_US}::DOUBLE AS period, (centre + ceil((t_first - centre) / p) * p) / {DAY_US}::DOUBLE AS t0,
  depth, sde, depth / sqrt(1.0::DOUBLE / w_in + 1.0::DOUBLE / (w_all - w_in)) AS snr, chi2, chi2 / (n - 4) AS chi2_red
  FROM res WHERE sde >= 1)
"""


@query(
    "dm3_period_search",
    with_views("lc_dip") + PTS + SEARCH_SQL
    + f"SELECT tic_id, {', '.join(sql_r6(c, 4) + ' AS ' + c for c in ('period', 't0', 'depth', 'sde', 'snr', 'chi2', 'chi2_red'))}, "
    "CASE WHEN sde < 5 THEN 'DISCARD' WHEN sde < 7 THEN 'SUB_THRESHOLD' ELSE 'FULL_PIPELINE' END AS disposition FROM sig",
)
def _(spark, sf):
    found = search.sde_gate(search.period_search(views.lc_dip(spark, sf), PERIODS, DURATIONS))
    return rounded(
        found.select("tic_id", "period", "t0", "depth", "sde", "snr", "chi2", "chi2_red", "disposition"), 4
    )


def round_sql(points: str, n: int) -> str:
    """CTE text of search round ``n`` over ``points``; ends in ``sig{n}`` with the candidate columns."""
    text = f"trials AS (SELECT s.*, p FROM {points} s, grid)," + bins_sql("trials", "tic_id", str(DIP_DURATION_US)) + SEARCH_SQL.replace(
        "FROM pts GROUP BY", f"FROM {points} GROUP BY"
    )
    for name in ("trials", "folded", "tot", "boxes", "depths", "scored", "bestbox", "spec", "st", "res", "sig"):
        text = re.sub(rf"\b{name}\b", f"{name}{n}", text)
    return text


def masked_sql(points: str, n: int) -> str:
    """CTE ``pts{n+1}``: series that go on after round ``n``, with its transits set to 1."""
    half = DIP_DURATION_US / 2
    distance = (
        f"abs(((s.time_us - g.t0 * {DAY_US} + g.period * {DAY_US} / 2.0) % (g.period * {DAY_US}) + g.period * {DAY_US}) "
        f"% (g.period * {DAY_US}) - g.period * {DAY_US} / 2.0)"
    )
    return (
        f"pts{n + 1} AS (SELECT s.tic_id, s.time_us, CASE WHEN {distance} <= {half} THEN 1.0 ELSE s.flux END AS flux, s.w "
        f"FROM {points} s JOIN sig{n} g USING (tic_id) WHERE g.sde >= 5)"
    )


_PTS1 = f", pts1 AS (SELECT tic_id, time_us, flux, 1.0::DOUBLE / (flux_err * flux_err) AS w FROM lc_dip), grid AS ({PERIOD_SQL})"
_MULTI_COLS = ("period", "t0", "depth", "sde", "snr")

MULTI_SQL = (
    with_views("lc_dip") + _PTS1 + ", " + round_sql("pts1", 1) + ", " + masked_sql("pts1", 1) + ", " + round_sql("pts2", 2)
    + ", " + masked_sql("pts2", 2) + ", " + round_sql("pts3", 3) + " UNION ALL ".join(
        f"SELECT tic_id, {n}::BIGINT AS planet_num, {', '.join(sql_r6(c, 4) + ' AS ' + c for c in _MULTI_COLS)} FROM sig{n}" for n in (1, 2, 3)
    )
)


@query("dm4_multi_search", MULTI_SQL)
def _(spark, sf):
    found = search.multi_search(views.lc_dip(spark, sf), PERIODS, DURATIONS)
    return rounded(found.select("tic_id", "planet_num", *_MULTI_COLS), 4)


@query(
    "dm5_search_batch",
    MULTI_SQL.replace("FROM lc_dip)", "FROM lc_dip WHERE tic_id NOT IN (SELECT r_regionkey + 4 FROM region))", 1),
)
def _(spark, sf):
    done = table(spark, sf, "region").select((F.col("r_regionkey") + 4).cast("bigint").alias("tic_id"), F.lit(1).alias("sector"))
    found = search.search_batch(views.lc_dip(spark, sf), done, PERIODS, DURATIONS)
    return rounded(found.select("tic_id", "planet_num", *_MULTI_COLS), 4)


_NARROW = f"""wanted AS (SELECT 1 + n_nationkey % 6 AS tic_id, n_nationkey AS planet_num, 2.7::DOUBLE + 0.025::DOUBLE * n_nationkey AS period FROM nation),
w2 AS (SELECT *, CAST(round_even(period * {DAY_US}, 0) AS BIGINT) AS pu FROM wanted),
w3 AS (SELECT *, greatest(8640000000, CAST(floor(pu * 0.95::DOUBLE) AS BIGINT)) AS lo, CAST(floor(pu * 1.05::DOUBLE) AS BIGINT) AS hi FROM w2),
tr AS (SELECT planet_num, s.time_us, s.flux, 1.0::DOUBLE / (s.flux_err * s.flux_err) AS w, lo + i * (hi - lo) // 499 AS p FROM w3 JOIN lc_dip s USING (tic_id), range(500) r(i)),
""" + bins_sql("tr", "planet_num", str(DIP_DURATION_US)) + """,
bp AS (SELECT planet_num, arg_max(p, {'a': round(power, 7), 'b': -p}) AS bp FROM bestbox GROUP BY planet_num)"""


def _narrow(spark, sf):
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        (F.lit(1) + n % 6).cast("bigint").alias("tic_id"), F.lit(1).alias("sector"), n.cast("int").alias("planet_num"),
        (F.lit(2.7) + F.lit(0.025) * n).alias("period"), F.lit(DIP_DURATION_US / DAY_US).alias("duration"),
    )


@query(
    "dm6_bls_consistent",
    with_views("lc_dip") + f", {_NARROW} SELECT tic_id::BIGINT AS tic_id, planet_num::BIGINT AS planet_num, {sql_r6(f'bp / {DAY_US}::DOUBLE')} AS best_period, "
    "coalesce(abs(bp - pu) / pu::DOUBLE < 0.02::DOUBLE, FALSE) AS bls_consistent FROM w3 LEFT JOIN bp USING (planet_num)",
)
def _(spark, sf):
    checked = search.bls_consistent(_narrow(spark, sf), views.lc_dip(spark, sf))
    return rounded(checked.select("tic_id", "planet_num", "best_period", "bls_consistent"))


@query(
    "wn5_candidate_ordinal",
    with_views("cand") + "SELECT tic_id, CAST(sector AS BIGINT) AS sector, CAST(planet_num AS BIGINT) AS planet_num, "
    "row_number() OVER (PARTITION BY tic_id, sector ORDER BY sde DESC, planet_num) AS ordinal FROM cand",
)
def _(spark, sf):
    return rounded(search.candidate_ordinal(views.cand(spark, sf)).select("tic_id", "sector", "planet_num", "ordinal"))
