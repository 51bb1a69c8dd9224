"""Vetting features of candidates: from series, from views and from pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photospark.functions.scalars import (
    array_median, array_sum, clean_num, epoch_parity, in_transit_wrapped, is_number, let, positive,
)
from photospark.operators.catalogue import top_by_sde
from photospark.plans.groups import MAX_GROUP_ROWS, group_quantiles, join_to_groups
from photospark.plans.lineage import pin
from photospark.schema import CANDIDATE_KEY, SERIES_KEY

# The feature vector of the tabular classifier, in order.
FEATURE_COLUMNS = (
    "odd_even_depth_diff", "secondary_eclipse_depth", "centroid_shift_sigma", "v_shape_metric",
    "crowdsap", "duration_period_ratio", "sde", "snr",
)


def odd_even_sigma(series: DataFrame, candidates: DataFrame, max_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """Difference of the odd and even transit depths in units of its error, one row per candidate.

    0 where a side has fewer than three points or the error is 0.
    """
    keys = list(CANDIDATE_KEY)
    joined, max_rows = join_to_groups(
        candidates.select(*keys, "period", "t0", "duration"), series.select(*SERIES_KEY, "time", "flux"), SERIES_KEY, max_rows
    )
    t, p, t0 = F.col("time"), F.col("period"), F.col("t0")
    hits = joined.filter(in_transit_wrapped(t, p, t0, F.col("duration"))).select(
        *keys, "flux", epoch_parity(t, p, t0).alias("_parity")
    )
    side = {name: F.when(F.col("_parity") == value, F.col("flux")) for name, value in (("odd", 1), ("even", 0))}
    sides = group_quantiles(
        hits, keys, {f"m_{n}": (x, 0.5) for n, x in side.items()}, max_rows,
        {**{f"n_{n}": F.count(x) for n, x in side.items()}, **{f"s_{n}": F.stddev_pop(x) for n, x in side.items()}},
    )
    variance = (
        F.col("s_odd") * F.col("s_odd") / F.col("n_odd") + F.col("s_even") * F.col("s_even") / F.col("n_even")
    )
    enough = (F.col("n_odd") >= 3) & (F.col("n_even") >= 3)
    return (
        candidates.select(*keys)
        .join(sides, keys, "left")
        .select(
            *keys,
            F.when(
                enough, F.coalesce(
                    F.try_divide(F.abs(F.col("m_even") - F.col("m_odd")), F.sqrt(F.when(enough, variance))), F.lit(0.0)
                ),
            ).otherwise(F.lit(0.0)).alias("odd_even_depth_diff"),
        )
    )


def secondary_depth(view: Column) -> Column:
    """Median of the 25-45 % zone minus median of the outer 5 % on both sides, not below 0."""
    n = F.size(view)
    edge = F.greatest(F.lit(1), F.floor(n / 20).cast("int"))
    start, stop = F.floor(n * F.lit(0.25)).cast("int"), F.floor(n * F.lit(0.45)).cast("int")
    outer = F.concat(F.slice(view, F.lit(1), edge), F.slice(view, n - edge + 1, edge))
    zone = F.slice(view, start + 1, stop - start)
    return F.greatest(array_median(zone) - array_median(outer), F.lit(0.0))


def v_shape(view: Column) -> Column:
    """1 for a V-shaped dip and 0 for a flat bottom: 1 - flat bins / extent of the half-depth region."""
    def shape(low: Column) -> Column:
        depth = F.lit(1.0) - low
        below = F.filter(
            F.transform(view, lambda x, i: F.when(x < F.lit(1.0) - depth / 2.0, i)), lambda i: i.isNotNull()
        )
        flat = F.size(F.filter(view, lambda x: x < low + depth * 0.1))
        metric = let(below, lambda b: F.when(
            F.size(b) > 0, F.lit(1.0) - flat / (F.array_max(b) - F.array_min(b) + 1)
        ).otherwise(F.lit(1.0)))
        return F.when(depth < 1e-5, F.lit(0.0)).otherwise(metric)

    return let(F.array_min(view), shape)


def v_shape_by_count(view: Column) -> Column:
    """The count-based form, clipped to [0, 1]."""
    def shape(low: Column) -> Column:
        depth = F.lit(1.0) - low
        total = F.greatest(F.size(F.filter(view, lambda x: x < F.lit(1.0) - depth / 2.0)), F.lit(1))
        flat = F.size(F.filter(view, lambda x: x < low + depth * 0.1))
        clipped = F.greatest(F.least(F.lit(1.0) - flat / total, F.lit(1.0)), F.lit(0.0))
        return F.when(depth > 1e-5, clipped).otherwise(F.lit(0.0))

    return let(F.array_min(view), shape)


def _array_std(values: Column) -> Column:
    n = F.size(values)
    return let(array_sum(values) / n, lambda mean: F.sqrt(
        F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    ))


def view_features(views: DataFrame) -> DataFrame:
    """Features from views alone: replaces the views of (global_view, local_view, period, duration, depth_ppm, median_flux_err).

    ``duration`` is in days.
    """
    g, v = F.col("global_view"), F.col("local_view")
    n = F.size(g)
    middle = F.floor(n / 2).cast("int")
    width = F.greatest(F.lit(5), F.floor(n * F.lit(0.02)).cast("int"))
    left, right = F.slice(g, middle - width + 1, width), F.slice(g, middle + 1, width)
    error = F.greatest(_array_std(g) / F.sqrt(width.cast("double")), F.lit(1e-10))
    return views.withColumns({
        "odd_even_depth_diff": F.abs(array_median(right) - array_median(left)) / error,
        "secondary_eclipse_depth": secondary_depth(g),
        "v_shape_metric": v_shape_by_count(v),
        "duration_period_ratio": F.when(F.col("period") > 0, F.try_divide(F.col("duration"), F.col("period"))).otherwise(F.lit(0.0)),
        "depth_snr": F.col("depth_ppm") * 1e-6 / F.greatest(F.col("median_flux_err"), F.lit(1e-10)),
        "transit_depth": F.lit(1.0) - F.array_min(v),
    }).drop("global_view", "local_view")


def extract_features(
    candidates: DataFrame, series: DataFrame, views: DataFrame, min_sde: float = 5.0, max_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """The eight features of every candidate at or above ``min_sde``.

    A candidate without views gets the values of flat zero views. The centroid
    shift starts at 0 and is filled in by ``centroid_shift``.
    """
    keys = list(CANDIDATE_KEY)
    chosen = candidates.filter(is_number(F.col("sde")) & (F.col("sde") >= min_sde))
    crowding = F.coalesce(F.col("crowdsap"), F.lit(1.0)) if "crowdsap" in candidates.columns else F.lit(1.0)
    return (
        chosen.join(odd_even_sigma(series, chosen, max_rows), keys, "left")
        .join(views.select(*keys, "global_view", "local_view"), keys, "left")
        .select(
            *keys,
            "odd_even_depth_diff",
            F.coalesce(secondary_depth(F.col("global_view")), F.lit(0.0)).alias("secondary_eclipse_depth"),
            F.lit(0.0).alias("centroid_shift_sigma"),
            F.when(F.col("local_view").isNull(), F.lit(0.0)).otherwise(v_shape(F.col("local_view"))).alias("v_shape_metric"),
            crowding.alias("crowdsap"),
            F.when(F.col("period") > 0, F.try_divide(F.col("duration"), F.col("period"))).otherwise(F.lit(0.0)).alias("duration_period_ratio"),
            "sde", "snr",
        )
    )


def feature_matrix(features: DataFrame) -> DataFrame:
    """Feature columns with missing values as 0."""
    return features.withColumns({c: clean_num(F.col(c), 0.0) for c in FEATURE_COLUMNS})


def transit_epochs(series: DataFrame, candidates: DataFrame) -> DataFrame:
    """Transit times inside the observed span of each candidate's series; none without a usable period."""
    spans = series.groupBy(*SERIES_KEY).agg(F.min("time").alias("_a"), F.max("time").alias("_b"))
    first = F.ceil((F.col("_a") - F.col("t0")) / positive(F.col("period")))
    last = F.floor((F.col("_b") - F.col("t0")) / positive(F.col("period")))
    return (
        candidates.select(*CANDIDATE_KEY, "period", "t0").join(spans, list(SERIES_KEY))
        .withColumn("_first", first).withColumn("_last", last)
        .filter(F.col("_last") >= F.col("_first"))
        .withColumn("epoch", F.explode(F.sequence("_first", "_last")))
        .select(*CANDIDATE_KEY, "epoch", (F.col("t0") + F.col("epoch") * F.col("period")).alias("epoch_time"))
    )


def frame_centroids(pixels: DataFrame) -> DataFrame:
    """Flux-weighted column and row of every frame; null where the frame has no positive flux."""
    total = F.sum("flux")
    return pixels.groupBy(*SERIES_KEY, "cadence").agg(
        F.min("time").alias("time"),
        F.when(total > 0, F.sum(F.col("flux") * F.col("col")) / total).alias("cx"),
        F.when(total > 0, F.sum(F.col("flux") * F.col("row")) / total).alias("cy"),
    )


def centroid_stats(pixels: DataFrame, candidates: DataFrame, max_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """Centroid shift between transit and the rest, in pixels and in deviations of the rest.

    0 where there are fewer than three frames in transit, ten outside, or no scatter.
    """
    keys = list(CANDIDATE_KEY)
    wanted = candidates.select(*keys, "period", "t0", "duration")
    theirs = pixels.join(wanted.select(*SERIES_KEY).distinct(), list(SERIES_KEY), "left_semi")
    # one row per frame instead of one per pixel, read by three aggregations
    reduced = pin(frame_centroids(theirs))
    frames, max_rows = join_to_groups(wanted, reduced, SERIES_KEY, max_rows)
    inside = in_transit_wrapped(F.col("time"), F.col("period"), F.col("t0"), F.col("duration"))
    frames = frames.select(*keys, "cx", "cy", inside.alias("_in"))
    picks = {
        f"{c}_{side}": (F.when(flag, F.col(c)), 0.5)
        for c in ("cx", "cy") for side, flag in (("in", F.col("_in")), ("out", ~F.col("_in")))
    }
    medians = group_quantiles(
        frames, keys, picks, max_rows, {"n_in": F.count_if("_in"), "n_out": F.count_if(~F.col("_in"))}
    )
    dx, dy = F.col("cx") - F.col("cx_out"), F.col("cy") - F.col("cy_out")
    scatter = (
        frames.filter(~F.col("_in")).join(medians.select(*keys, "cx_out", "cy_out"), keys)
        .groupBy(*keys).agg(F.stddev_pop(F.sqrt(dx * dx + dy * dy)).alias("_sigma"))
    )
    sx, sy = F.col("cx_in") - F.col("cx_out"), F.col("cy_in") - F.col("cy_out")
    enough = (F.col("n_in") >= 3) & (F.col("n_out") >= 10)
    shift = F.sqrt(sx * sx + sy * sy)
    return medians.join(scatter, keys, "left").select(
        *keys, "n_in", "n_out",
        F.when(enough, shift).otherwise(F.lit(0.0)).alias("shift_pixels"),
        F.when(enough & (F.col("_sigma") > 0), F.try_divide(shift, F.col("_sigma"))).otherwise(F.lit(0.0)).alias("centroid_shift_sigma"),
    )


def centroid_shift(
    pixels: DataFrame, candidates: DataFrame, top_n: int = 200, min_sde: float = 7.0, blend_sigma: float = 3.0,
    max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Centroid shift of the ``top_n`` candidates; those already ``centroid_computed`` are skipped.

    A candidate without pixels counts as unshifted.
    """
    keys = list(CANDIDATE_KEY)
    done = F.coalesce(F.col("centroid_computed"), F.lit(False)) if "centroid_computed" in candidates.columns else F.lit(False)
    work = top_by_sde(candidates, top_n, min_sde).filter(~done)
    stats = centroid_stats(pixels, work, max_rows)
    sigma = F.coalesce("centroid_shift_sigma", F.lit(0.0))
    return work.select(*keys).join(stats, keys, "left").select(
        *keys, sigma.alias("centroid_shift_sigma"), (sigma > blend_sigma).alias("blend"), F.lit(True).alias("centroid_computed"),
    )

