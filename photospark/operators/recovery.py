"""Recovery of known planets, of literature parameters and of injected signals; template fits."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photospark.functions.rules import relative_error
from photospark.functions.scalars import duration_t14, is_number
from photospark.functions.draws import cell, draw, uniform
from photospark.operators.search import period_search
from photospark.plans.groups import MAX_GROUP_ROWS, row_limit, small_side
from photospark.plans.lineage import pin
from photospark.plans.prefix import ordinal
from photospark.schema import SERIES_KEY

# Benchmark systems (identifier, periods in days).
KNOWN_SYSTEMS = {
    "WASP-121b": (22529346, [1.27492]),
    "L 98-59": (307210830, [2.25311, 3.69068, 7.45073]),
    "TOI-270": (259377017, [3.36008, 5.66017, 11.38014]),
}

# Published parameters (target, identifier, sector, period in days, radius ratio,
# depth in ppm, duration in days, inclination, scaled axis, source).
PUBLISHED = [
    ("WASP-121b", 22529346, 1, 1.2749255, 0.1218, 14840.0, 0.1203, 87.6, 3.86, "Delrez et al. 2016"),
    ("TOI-270b", 259377017, 3, 3.36016, 0.0307, 942.0, 0.0425, 88.65, 12.09, "Günther et al. 2019"),
    ("TOI-270c", 259377017, 3, 5.66057, 0.0578, 3341.0, 0.0521, 89.53, 17.25, "Van Eylen et al. 2021"),
    ("TOI-270d", 259377017, 3, 11.38014, 0.0535, 2862.0, 0.0625, 89.7, 27.0, "Van Eylen et al. 2021"),
    ("L98-59b", 307210830, 2, 2.2531140, 0.0258, 666.0, 0.0425, 87.45, 11.5, "Kostov et al. 2019"),
    ("L98-59c", 307210830, 2, 3.6906764, 0.0396, 1568.0, 0.0508, 88.43, 15.8, "Kostov et al. 2019"),
    ("L98-59d", 307210830, 2, 7.450729, 0.0460, 2116.0, 0.0375, 89.0, 25.0, "Cadieux et al. 2025"),
    ("TOI-700d", 150428135, 4, 37.42396, 0.015, 225.0, 0.166, 89.7, 55.0, "Gilbert et al. 2020"),
]
TOLERANCES = {"period": 0.001, "depth_ppm": 0.05, "duration_days": 0.10}


def known_planets(spark: SparkSession) -> DataFrame:
    """(system, tic_id, known_period) of the seven benchmark planets."""
    rows = [(name, tic, period) for name, (tic, periods) in KNOWN_SYSTEMS.items() for period in periods]
    return spark.createDataFrame(rows, "system string, tic_id bigint, known_period double")


def published_parameters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PUBLISHED,
        "target string, tic_id bigint, sector int, period double, rp_rs double, depth_ppm double, "
        "duration_days double, inclination double, a_rs double, source string",
    )


def match_known(candidates: DataFrame, known: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Is each known planet among the candidates that are not discarded?

    The candidates are cut to the matching ones before they are counted, so a
    star with many candidates does not gather.
    """
    hit = (
        (relative_error(F.col("period"), F.col("known_period")) < tolerance)
        & (F.coalesce(F.col("disposition"), F.lit("")) != "DISCARD")
    )
    matched = (
        candidates.select("tic_id", "period", "disposition").join(known, "tic_id").filter(hit)
        .groupBy("tic_id", "known_period").agg(F.count(F.lit(1)).alias("n_matches"))
    )
    return known.join(matched, ["tic_id", "known_period"], "left").select(
        *known.columns, F.coalesce("n_matches", F.lit(0)).cast("bigint").alias("n_matches"),
        F.col("n_matches").isNotNull().alias("recovered"),
    )


recovery_report = match_known


def recovery_passed(report: DataFrame) -> DataFrame:
    """One row: recovered planets, all planets, and whether every one was recovered."""
    return report.agg(
        F.count_if("recovered").alias("n_recovered"), F.count(F.lit(1)).alias("n"), F.bool_and("recovered").alias("passed")
    )


def compare_published(
    fits: DataFrame, published: DataFrame, tolerances: dict[str, float] = TOLERANCES, on: str = "target"
) -> DataFrame:
    """Relative errors of fitted parameters, a pass flag for each and for all.

    A period or duration that is not positive is not judged.
    """
    names = list(tolerances)
    truth = published.select(on, *[F.col(n).alias(f"published_{n}") for n in names])
    joined = fits.join(truth, on)
    errors, passes = {}, {}
    for name in names:
        value, reference = F.col(name), F.col(f"published_{name}")
        error = relative_error(value, reference)
        judged = F.lit(True) if name == "depth_ppm" else (value > 0) & (reference > 0)
        errors[f"{name}_error_pct"] = F.when(judged, F.round(error * 100.0, 4))
        passes[f"{name}_pass"] = F.when(judged, error < tolerances[name])
    out = joined.withColumns({**errors, **passes})
    overall = F.lit(True)
    for name in passes:
        overall = overall & F.coalesce(F.col(name), F.lit(True))
    return out.withColumn("overall_pass", overall).drop(*[f"published_{n}" for n in names])


def validation_report(fits: DataFrame, published: DataFrame, **options) -> DataFrame:
    """Comparison of every target, targets without a fit included."""
    compared = compare_published(fits, published, **options)
    return published.select("target", "source").join(compared, "target", "left").withColumn(
        "status",
        F.when(F.col("overall_pass").isNull(), "MISSING").when(F.col("overall_pass"), "PASS").otherwise("FAIL"),
    )


# ---- injection and recovery ----------------------------------------------------------


def injection_trials(
    series: DataFrame, depths_ppm: Sequence[float], periods: Sequence[float], trials: int = 10, seed: int = 42
) -> DataFrame:
    """One row per (depth, period, trial): the series it uses and the epoch, both from draws of its number.

    Series are numbered in the order of their draws; a trial takes the number its own draw points at.
    """
    spans = series.groupBy(*SERIES_KEY).agg(F.min("time").alias("_first"))
    hashed = spans.withColumn("_h", draw("star", seed, F.col("tic_id"), F.col("sector"))).withColumn("_all", F.lit(1))
    stars = pin(ordinal(hashed, ["_all"], cell(F.col("_h")), [F.col("_h"), F.col("tic_id"), F.col("sector")], "_no"))
    n_stars = stars.count()
    cells = [(i, float(d), j, float(p)) for i, d in enumerate(depths_ppm) for j, p in enumerate(periods)]
    grid = series.sparkSession.createDataFrame(cells, "depth_no int, depth_ppm double, period_no int, period double")
    number = (F.col("depth_no") * len(periods) + F.col("period_no")) * trials + F.col("trial_no")
    rows = grid.withColumn("trial_no", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("trial", number.cast("bigint"))
    rows = rows.withColumn("_no", draw("trial", seed, F.col("trial")) % max(n_stars, 1) + 1)
    return rows.join(stars, "_no").select(
        "trial", "depth_ppm", "period", *SERIES_KEY,
        (F.col("_first") + uniform("epoch", seed, F.col("trial")) * F.col("period")).alias("t0"),
    )


def inject_box(
    series: DataFrame, trials: DataFrame, a_rs: float = 15.0, inclination: float = 89.5
) -> DataFrame:
    """Series of every trial with a box dip multiplied in; the trial number becomes ``tic_id``."""
    rp = F.sqrt(F.col("depth_ppm") * 1e-6)
    duration = duration_t14(F.col("period"), F.lit(a_rs), F.lit(inclination), rp)
    joined = trials.withColumn("_d", duration).join(
        series.select(*SERIES_KEY, "time_us", "time", "flux", "flux_err"), list(SERIES_KEY)
    )
    offset = F.pmod(F.col("time") - F.col("t0") + F.col("_d") / 2.0, F.col("period"))
    dip = F.when(offset < F.col("_d"), F.lit(1.0) - F.col("depth_ppm") * 1e-6).otherwise(F.lit(1.0))
    return joined.select(
        F.col("trial").alias("tic_id"), F.lit(0).alias("sector"), "time_us", "time",
        (F.col("flux") * dip).alias("flux"), "flux_err",
    )


def completeness_fraction(trials: DataFrame, min_sde: float = 7.0, tolerance: float = 0.01) -> DataFrame:
    """Share of recovered trials per (depth, period) from (depth_ppm, period, found_period, sde)."""
    error = relative_error(F.col("found_period"), F.col("period"))
    recovered = F.coalesce((F.col("sde") >= min_sde) & (error < tolerance), F.lit(False))
    return trials.groupBy("depth_ppm", "period").agg(
        F.count_if(recovered).alias("recovered"), F.count(F.lit(1)).alias("trials"),
        F.avg(recovered.cast("double")).alias("fraction"),
    )


def completeness_map(
    series: DataFrame, periods_us: Sequence[int], durations_us: Sequence[int],
    depths_ppm: Sequence[float] | None = None, periods: Sequence[float] | None = None,
    trials: int = 10, seed: int = 42, max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Injection and recovery: 10 depths from 50 to 2000 ppm by 10 periods from 0.5 to 30 days by default.

    All trials are one table of injected series that goes through one period search.
    """
    space = lambda a, b: [float(x) for x in np.geomspace(a, b, 10)]
    depths_ppm = depths_ppm or space(50.0, 2000.0)
    periods = periods or space(0.5, 30.0)
    plan = small_side(injection_trials(series, depths_ppm, periods, trials, seed))
    found = period_search(
        inject_box(series, plan), periods_us, durations_us, max_rows=row_limit(series, SERIES_KEY, max_rows), n_series=plan.count()
    )
    scored = plan.select("trial", "depth_ppm", "period").join(
        found.select(F.col("tic_id").alias("trial"), F.col("period").alias("found_period"), "sde"), "trial", "left"
    )
    return completeness_fraction(scored)


# ---- template fit ---------------------------------------------------------------------

_FIT = (
    "period double, rp_rs double, depth double, duration double, t0_shift double, ingress double, "
    "chi2 double, chi2_red double"
)


def trapezoid(phase: np.ndarray, centre, half, ingress):
    """Trapezoid of depth 1: full between the contacts, sloped over the ``ingress`` share of the half width."""
    distance = np.abs(phase - centre)
    slope = half * ingress
    return np.clip((half - distance) / np.maximum(slope, 1e-12), 0.0, 1.0)


def template_fit(
    views: DataFrame, candidates: DataFrame, durations: Sequence[float] = tuple(0.5 + 0.1 * i for i in range(11)),
    shifts: Sequence[float] = tuple((i - 5) / 10 for i in range(11)), ingresses: Sequence[float] = (0.1, 0.3, 0.6, 1.0),
    max_depth: float = 0.25, view: str = "global_view", baseline: float = 1.0, keys: Sequence[str] = ("tic_id", "sector", "planet_num"),
) -> DataFrame:
    """Depth, duration and epoch shift of every candidate at its fixed period, from its folded view.

    Trapezoid templates over duration (in units of the search duration), shift
    (in durations) and ingress share; the depth of a template follows in closed
    form and is kept in [0, ``max_depth``]. The smallest chi-squared wins. A
    view is one row, so the fit runs on row batches without a shuffle of points.
    """
    keys = list(keys)
    joined = views.select(*keys, F.col(view).alias("_view")).join(
        candidates.select(*keys, "period", "duration"), keys
    ).withColumnRenamed("duration", "_duration")
    types = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + _FIT
    grid = np.array([(d, s, i) for d in durations for s in shifts for i in ingresses])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for view_values, period, duration in zip(batch["_view"], batch["period"], batch["_duration"]):
                flux = np.asarray(view_values, float)
                n = len(flux)
                phase = -0.5 + (np.arange(n) + 0.5) / n
                width = duration / period
                half = np.minimum(grid[:, 0] * width / 2.0, 0.5)
                shape = trapezoid(phase[None, :], (grid[:, 1] * width)[:, None], half[:, None], grid[:, 2][:, None])
                drop = baseline - flux
                square, overlap = (shape * shape).sum(axis=1), shape @ drop
                depth = np.clip(np.where(square > 0, overlap / np.where(square > 0, square, 1.0), 0.0), 0.0, max_depth)
                error = flux.std() * 0.5
                error = 1e-4 if error < 1e-6 else error
                chi2 = ((drop * drop).sum() - 2.0 * depth * overlap + depth * depth * square) / error**2
                best = int(np.argmin(np.round(chi2, 9)))
                out.append((
                    period, math.sqrt(depth[best]), depth[best], grid[best, 0] * duration, grid[best, 1] * duration,
                    grid[best, 2], chi2[best], chi2[best] / (n - 4) if n > 4 else None,
                ))
            fitted = pd.DataFrame(out, columns=[c.split()[0] for c in _FIT.split(", ")])
            yield pd.concat([batch[keys].reset_index(drop=True), fitted], axis=1)

    return joined.filter(is_number(F.col("period")) & (F.col("period") > 0)).mapInPandas(fit, schema)


def fold_model(fit_row: DataFrame, n: int, baseline: float = 1.0, keys: Sequence[str] = ("tic_id", "sector", "planet_num")) -> DataFrame:
    """Model flux per phase bin of fitted candidates, long form."""
    centre = F.lit(-0.5) + (F.col("bin") + 0.5) / n
    half = F.col("duration") / F.col("period") / 2.0
    slope = F.greatest(half * F.col("ingress"), F.lit(1e-12))
    shape = F.greatest(F.least((half - F.abs(centre - F.col("t0_shift") / F.col("period"))) / slope, F.lit(1.0)), F.lit(0.0))
    return fit_row.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        *keys, "bin", centre.alias("phase"), (F.lit(baseline) - F.col("depth") * shape).alias("model")
    )

