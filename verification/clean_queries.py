"""Cleaning: masks, clipping, gaps, detrending, status."""

from __future__ import annotations

from pyspark.sql import functions as F

from photospark.functions import rules
from photospark.functions.scalars import linear_grid
from photospark.operators import clean
from photospark.schema import SERIES_KEY
from verification import views
from verification.registry import query, r6, rounded, sql_r6
from verification.views import with_views

OK_SQL = "NOT isnan(time) AND NOT isnan(flux) AND NOT isnan(flux_err) AND (coalesce(quality, 0) & 175) = 0"

MASKED = f"masked AS (SELECT * FROM lc WHERE {OK_SQL})"


def clip_rounds(source: str, name: str, rounds: int = 5) -> str:
    """CTE text of the iterated clip of ``source``."""
    steps, previous = [], source
    for i in range(1, rounds + 1):
        last = name if i == rounds else f"{name}_{i}"
        steps.append(
            f"{last} AS (SELECT p.* FROM {previous} p JOIN (SELECT tic_id, sector, median(flux) AS m, "
            f"stddev_pop(flux) AS s FROM {previous} GROUP BY tic_id, sector) q USING (tic_id, sector) "
            "WHERE NOT (abs(p.flux - q.m) > 5.0::DOUBLE * q.s))"
        )
        previous = last
    return ",\n".join(steps)


NORMAL = (
    f"{MASKED},\n{clip_rounds('masked', 'clipped')},\n"
    "med AS (SELECT tic_id, sector, median(flux) AS m FROM clipped GROUP BY tic_id, sector),\n"
    "normal AS (SELECT tic_id, sector, time_us, time, flux / CASE WHEN m > 0 THEN m ELSE 1.0 END AS flux, "
    "flux_err / CASE WHEN m > 0 THEN m ELSE 1.0 END AS flux_err FROM clipped JOIN med USING (tic_id, sector))"
)

LC_GAPS = (
    "steps AS (SELECT tic_id, sector, time AS gap_start, "
    "lead(time) OVER (PARTITION BY tic_id, sector ORDER BY time_us) AS gap_end FROM {source}),\n"
    "gaps AS (SELECT * FROM steps WHERE gap_end - gap_start > {threshold}::DOUBLE)"
)


@query(
    "pr1_quality_mask",
    with_views("lc") + f"SELECT tic_id, count(*) AS n, {sql_r6('sum(flux)')} AS total FROM lc WHERE {OK_SQL} GROUP BY tic_id",
)
def _(spark, sf):
    kept = clean.quality_mask(views.lc(spark, sf))
    return kept.groupBy("tic_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("flux")).alias("total"))


@query(
    "ag1_sigma_clip",
    with_views("lc") + f", {MASKED},\n{clip_rounds('masked', 'clipped')}\n"
    f"SELECT tic_id, sector, count(*) AS n, {sql_r6('median(flux)', 9)} AS med, {sql_r6('stddev_pop(flux)', 9)} AS sd "
    "FROM clipped GROUP BY tic_id, sector",
)
def _(spark, sf):
    kept = clean.sigma_clip(clean.quality_mask(views.lc(spark, sf)))
    return rounded(kept.groupBy(*SERIES_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.median("flux").alias("med"), F.stddev_pop("flux").alias("sd")
    ), 9)


@query(
    "ag2_median_normalise",
    with_views("lc") + f", {NORMAL}\nSELECT tic_id, sector, time_us, {sql_r6('flux')} AS flux, "
    f"{sql_r6('flux_err', 9)} AS flux_err FROM normal",
)
def _(spark, sf):
    normal = clean.median_normalise(clean.sigma_clip(clean.quality_mask(views.lc(spark, sf))))
    return normal.select(
        "tic_id", F.col("sector").cast("bigint").alias("sector"), "time_us",
        r6(F.col("flux")).alias("flux"), r6(F.col("flux_err"), 9).alias("flux_err"),
    )


@query(
    "wn1_find_gaps",
    with_views("lc_user") + ", " + LC_GAPS.format(source="lc_user", threshold="2.0")
    + f"\nSELECT tic_id, {sql_r6('gap_start')} AS gap_start, {sql_r6('gap_end')} AS gap_end FROM gaps",
)
def _(spark, sf):
    return rounded(clean.find_gaps(views.lc_user(spark, sf), 2.0).drop("sector"))


@query(
    "jn6_mark_gap_edges",
    with_views("lc_user") + ", " + LC_GAPS.format(source="lc_user", threshold="2.0")
    + "\nSELECT tic_id, time_us, EXISTS (SELECT 1 FROM gaps g WHERE g.tic_id = l.tic_id AND g.sector = l.sector "
    "AND l.time >= g.gap_start - 0.5::DOUBLE AND l.time <= g.gap_end + 0.5::DOUBLE) AS gap_mask FROM lc_user l",
)
def _(spark, sf):
    series = views.lc_user(spark, sf)
    marked = clean.mark_gap_edges(series, clean.find_gaps(series, 2.0), 0.5)
    return marked.select("tic_id", "time_us", "gap_mask")


@query(
    "ag3_series_stats",
    with_views("lc_user") + ", " + LC_GAPS.format(source="lc_user", threshold="2.0")
    + ", c AS (SELECT tic_id, sector, count(*) AS n_cadences, median(flux_err) AS e FROM lc_user GROUP BY ALL)"
    ", g AS (SELECT tic_id, sector, count(*) AS n_gaps FROM gaps GROUP BY ALL)"
    f"\nSELECT tic_id, n_cadences, coalesce(n_gaps, 0) AS n_gaps, {sql_r6('e')} AS median_flux_err "
    "FROM c LEFT JOIN g USING (tic_id, sector)",
)
def _(spark, sf):
    series = views.lc_user(spark, sf)
    return rounded(clean.series_stats(series, clean.find_gaps(series, 2.0)).drop("sector"))


BIWEIGHT_ITERATIONS = 6


def biweight_sql(source: str, name: str, half_us: int) -> str:
    """CTE text of the sliding biweight of ``source``: windows as lists, the update unrolled."""
    out = [
        f"{name}_w AS (SELECT *, list(flux) OVER (PARTITION BY tic_id, sector ORDER BY time_us "
        f"RANGE BETWEEN {half_us} PRECEDING AND {half_us} FOLLOWING) AS w FROM {source})",
        f"{name}_m AS (SELECT *, list_median(w) AS loc0 FROM {name}_w)",
        f"{name}_s AS (SELECT *, 5.0::DOUBLE * list_median(list_transform(w, lambda x: abs(x - loc0))) AS sc "
        f"FROM {name}_m)",
    ]
    previous = f"{name}_s"
    for i in range(BIWEIGHT_ITERATIONS):
        step = f"{name}_{i}"
        u = f"((x - loc{i}) / sc)"
        weight = f"CASE WHEN abs({u}) < 1 THEN (1 - {u} * {u}) * (1 - {u} * {u}) ELSE 0.0::DOUBLE END"
        out.append(
            f"{step} AS (SELECT *, CASE WHEN sc > 0 THEN list_sum(list_transform(w, lambda x: ({weight}) * x)) / "
            f"list_sum(list_transform(w, lambda x: {weight})) ELSE loc{i} END AS loc{i + 1} FROM {previous})"
        )
        previous = step
    out.append(f"{name} AS (SELECT *, loc{BIWEIGHT_ITERATIONS} AS trend FROM {previous})")
    return ",\n".join(out)


@query(
    "wn2_biweight_detrend",
    with_views("lc") + f", {MASKED},\n{biweight_sql('masked', 'flat', 32_400_000_000)}\n"
    f"SELECT tic_id, time_us, {sql_r6('trend')} AS trend, {sql_r6('flux / trend')} AS flux FROM flat",
)
def _(spark, sf):
    flat = clean.biweight_detrend(clean.quality_mask(views.lc(spark, sf)), 0.75, BIWEIGHT_ITERATIONS)
    return rounded(flat.select("tic_id", "time_us", "trend", "flux"))


@query(
    "dm1_preprocess_curves",
    with_views("lc") + f""", {NORMAL},
{LC_GAPS.format(source="normal", threshold="0.1")},
good AS (SELECT * FROM normal l WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE g.tic_id = l.tic_id
  AND l.time >= g.gap_start - 0.02::DOUBLE AND l.time <= g.gap_end + 0.02::DOUBLE)),
{biweight_sql('good', 'flat', 32_400_000_000)}
SELECT tic_id, time_us, {sql_r6('flux / trend')} AS flux, {sql_r6('trend')} AS trend,
       {sql_r6('flux / med2')} AS flux_norm
FROM flat JOIN (SELECT tic_id, median(flux) AS med2, count(*) AS n FROM good GROUP BY tic_id) USING (tic_id)
JOIN (SELECT tic_id, count(*) AS nm FROM masked GROUP BY tic_id) USING (tic_id)
WHERE n >= 100 AND nm >= 100""",
)
def _(spark, sf):
    series = views.lc(spark, sf)
    stars = linear_grid(spark, 7.0, 7.0, 6, "tmag").select(
        F.col("i").cast("bigint").alias("tic_id"), F.lit(1).alias("sector"), "tmag"
    )
    curves, _status = clean.preprocess(series, stars, edge_days=0.02, min_cadences=100)
    return rounded(curves.select("tic_id", "time_us", "flux", "trend", "flux_norm"))


@query(
    "dm1_preprocess_status",
    with_views("lc_user", "meta") + f""", masked AS (SELECT * FROM lc_user WHERE {OK_SQL}),
enough AS (SELECT * FROM masked WHERE tic_id IN (SELECT tic_id FROM masked GROUP BY tic_id HAVING count(*) >= 40)),
{clip_rounds('enough', 'clipped')},
{LC_GAPS.format(source="clipped", threshold="2.0")},
good AS (SELECT * FROM clipped l WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE g.tic_id = l.tic_id
  AND l.time >= g.gap_start - 0.5::DOUBLE AND l.time <= g.gap_end + 0.5::DOUBLE)),
r AS (SELECT tic_id, count(*) AS n_raw FROM lc_user GROUP BY tic_id),
k AS (SELECT tic_id, count(*) AS n_masked FROM masked GROUP BY tic_id),
g AS (SELECT tic_id, count(*) AS n_good FROM good GROUP BY tic_id),
q AS (SELECT tic_id, count(*) AS n_gaps FROM gaps GROUP BY tic_id),
s AS (SELECT coalesce(m.tic_id, r.tic_id) AS tic_id, n_good, n_gaps,
  CASE WHEN n_raw IS NULL THEN 'MISSING_RAW'
       WHEN m.tic_id % 50 = 7 THEN 'ERROR: ' || n_raw || ' of ' || n_raw || ' cadences have two different times'
       WHEN coalesce(n_masked, 0) < 40 THEN 'TOO_FEW_CADENCES'
       WHEN tmag < 6 THEN 'SATURATED' WHEN coalesce(n_good, 0) < 40 THEN 'TOO_FEW_CADENCES'
       ELSE 'PREPROCESSED' END AS status
  FROM meta m FULL JOIN r ON m.tic_id = r.tic_id LEFT JOIN k ON k.tic_id = r.tic_id
  LEFT JOIN g ON g.tic_id = r.tic_id LEFT JOIN q ON q.tic_id = r.tic_id)
SELECT tic_id, status, CASE WHEN status = 'PREPROCESSED' THEN n_good END AS n_cadences,
       CASE WHEN status = 'PREPROCESSED' THEN coalesce(n_gaps, 0) END AS n_gaps FROM s""",
)
def _(spark, sf):
    # some stars are broken: their cadences have a day that their microseconds do not have
    broken = F.when(F.col("tic_id") % 50 == 7, 1.0).otherwise(0.0)
    series = views.lc_user(spark, sf).withColumn("time", F.col("time") + broken)
    stars = views.meta(spark, sf).withColumn("sector", F.lit(1))
    _curves, status = clean.preprocess(series, stars, gap_threshold=2.0, min_cadences=40)
    return rounded(status.select("tic_id", "status", "n_cadences", "n_gaps"))


@query(
    "pr2_exclusion_reason",
    with_views("lc_user", "meta") + ", n AS (SELECT tic_id, count(*) AS n FROM lc_user GROUP BY tic_id) "
    "SELECT m.tic_id, CASE WHEN tmag < 6 THEN 'SATURATED' WHEN coalesce(n, 0) < 60 THEN 'TOO_FEW_CADENCES' "
    "ELSE 'NONE' END AS reason, coalesce(tmag >= 6, TRUE) AND coalesce(n, 0) >= 500 AS process "
    "FROM meta m LEFT JOIN n ON m.tic_id = n.tic_id",
)
def _(spark, sf):
    counts = views.lc_user(spark, sf).groupBy("tic_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return views.meta(spark, sf).join(counts, "tic_id", "left").select(
        "tic_id", rules.exclusion_reason(F.col("tmag"), n, 60).alias("reason"),
        rules.should_process(F.col("tmag"), n).alias("process"),
    )


@query(
    "pr3_preprocess_status",
    with_views("lc_user", "meta") + f""", c AS (SELECT tic_id, count(*) AS n,
  count(*) FILTER (WHERE {OK_SQL}) AS k FROM lc_user GROUP BY tic_id)
SELECT m.tic_id, CASE WHEN n IS NULL THEN 'MISSING_RAW' WHEN k < 40 THEN 'TOO_FEW_CADENCES'
  WHEN tmag < 6 THEN 'SATURATED' WHEN k < 40 THEN 'TOO_FEW_CADENCES' ELSE 'PREPROCESSED' END AS status
FROM meta m LEFT JOIN c ON m.tic_id = c.tic_id""",
)
def _(spark, sf):
    ok = rules.quality_ok(F.col("time"), F.col("flux"), F.col("flux_err"), F.col("quality"))
    counts = views.lc_user(spark, sf).groupBy("tic_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("k")
    )
    return views.meta(spark, sf).join(counts, "tic_id", "left").select(
        "tic_id",
        rules.preprocess_status(F.col("n"), F.col("k"), F.col("k"), F.col("tmag"), min_cadences=40).alias("status"),
    )
