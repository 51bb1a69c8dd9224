"""Cleaning of light curves: quality mask, outlier clip, gaps, detrending, the whole chain."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photospark.functions import rules
from photospark.functions.ranktree import biweight_location
from photospark.functions.scalars import is_number
from photospark.plans.groups import (
    MAX_GROUP_ROWS, group_quantiles, join_to_groups, large_quantiles, small_side, split_by_size, spread,
    with_group_median,
)
from photospark.plans.lineage import pin
from photospark.schema import DAY_US, SERIES_KEY

#: Cadences of a window up to which it is cheaper to sort each window than to build a rank tree.
DIRECT_WINDOW = 400
#: Cadences of a rank tree beside their neighbours, where windows are shorter than a quarter of that.
TREE_ROWS = 100_000
#: Cadences and stars that one call of the cleaning kernel holds on average.
BATCH_ROWS = 20_000
#: Cadences above which a series has a call of its own.
ALONE_ROWS = 4_000
#: Microseconds by which the two times of a cadence may differ.
TIME_SLACK_US = 500_000
#: What is told of a series that fails: times further apart than that, nothing left to detrend.
TIMES_APART = "%d of %d cadences have two different times"
NO_CADENCE = "no cadence is left"


def quality_mask(series: DataFrame, bitmask: int = rules.QUALITY_BITMASK) -> DataFrame:
    """Drop cadences with a missing measurement or a flagged quality bit."""
    quality = F.col("quality") if "quality" in series.columns else None
    return series.filter(
        rules.quality_ok(F.col("time"), F.col("flux"), F.col("flux_err"), quality, bitmask)
    )


def sigma_clip(
    series: DataFrame,
    sigma: float = 5.0,
    iters: int = 5,
    value: str = "flux",
    keys: Sequence[str] = SERIES_KEY,
    max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Drop values further than ``sigma`` population deviations from the median, ``iters`` times over.

    Each round looks at the survivors of the round before; a round that drops
    nothing leaves the later ones without effect. Normal series share one
    shuffle for all rounds; series above ``max_rows`` go round by round through
    partial aggregates.
    """
    small, large, _ = split_by_size(series, keys, max_rows)
    x = F.col(value)
    window = Window.partitionBy(*keys)
    out = small.withColumn("_keep", F.lit(True))
    for _ in range(iters):
        kept = F.when(F.col("_keep"), x)
        out = (
            out.withColumns({"_m": F.median(kept).over(window), "_s": F.stddev_pop(kept).over(window)})
            .withColumn("_keep", F.col("_keep") & ~(F.abs(x - F.col("_m")) > F.col("_s") * sigma))
        )
    out = out.filter("_keep").drop("_keep", "_m", "_s")
    if large is None:
        return out
    # the rounds need the values alone
    kept, kept_rows, before = large.select(*keys, x.alias(value)).persist(), large, None
    cached = kept
    for _ in range(iters):
        middles = small_side(large_quantiles(kept, keys, {"_m": (x, 0.5)}, {"_mean": F.avg(x), "_n": F.count(x)}))
        left = middles.agg(F.sum("_n")).first()[0]
        if left == before:
            break
        before = left
        # squares about the known mean, as in ``clip_mask``: what a merge of deviations rounds would decide at a limit that is met exactly
        squares = kept.join(middles, list(keys)).groupBy(*keys, "_m", "_n").agg(F.avg((x - F.col("_mean")) * (x - F.col("_mean"))).alias("_s"))
        limits = small_side(squares.withColumn("_s", F.sqrt("_s")))
        kept, kept_rows = (
            rows.join(limits, list(keys)).filter(~(F.abs(x - F.col("_m")) > F.col("_s") * sigma)).drop("_m", "_s", "_n")
            for rows in (kept, kept_rows)
        )
    cached.unpersist()
    return out.unionByName(kept_rows)


def median_normalise(
    series: DataFrame, keys: Sequence[str] = SERIES_KEY, max_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """Divide flux and its error by the median flux of the series where that is positive."""
    scale = F.when(is_number(F.col("_m")) & (F.col("_m") > 0), F.col("_m")).otherwise(F.lit(1.0))
    return (
        with_group_median(series, keys, {"_m": F.col("flux")}, max_rows)
        .withColumns({"flux": F.col("flux") / scale, "flux_err": F.col("flux_err") / scale})
        .drop("_m")
    )


def find_gaps(series: DataFrame, threshold: float = 0.1, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Pairs of consecutive times more than ``threshold`` days apart, as (gap_start, gap_end).

    Times are first reduced to the first and last one of cells half as wide as
    the threshold. No gap fits inside a cell, so only one row per cell is
    shuffled and ordered.
    """
    cells = series.groupBy(*keys, F.floor(F.col("time") / (threshold / 2)).alias("_cell")).agg(
        F.min("time").alias("_first"), F.max("time").alias("_last")
    )
    following = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_cell"))
    return (
        cells.withColumn("gap_end", following)
        .filter(F.col("gap_end") - F.col("_last") > threshold)
        .select(*keys, F.col("_last").alias("gap_start"), "gap_end")
    )


def _edge_intervals(gaps: DataFrame, edge_days: float, keys: Sequence[str]) -> DataFrame:
    """Disjoint intervals covering the gap edges; inside a gap there is nothing to flag."""
    edges = gaps.select(
        *keys,
        F.explode(
            F.array(
                F.struct((F.col("gap_start") - edge_days).alias("lo"), F.col("gap_start").alias("hi")),
                F.struct(F.col("gap_end").alias("lo"), (F.col("gap_end") + edge_days).alias("hi")),
            )
        ).alias("e"),
    ).select(*keys, "e.lo", "e.hi")
    ordered = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    starts = edges.withColumn("_new", F.when(F.col("lo") <= reach, 0).otherwise(1))
    islands = starts.withColumn("_island", F.sum("_new").over(ordered))
    return islands.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def mark_gap_edges(
    series: DataFrame, gaps: DataFrame, edge_days: float = 0.5, keys: Sequence[str] = SERIES_KEY
) -> DataFrame:
    """Add ``gap_mask``: true for cadences within ``edge_days`` of a gap.

    Interval join on (series, day): the intervals are merged so that a cadence
    meets at most one of them, and the day in the key spreads a long series.
    """
    intervals = _edge_intervals(gaps, edge_days, keys)
    by_day = intervals.withColumn(
        "_day", F.explode(F.sequence(F.floor("lo").cast("bigint"), F.floor("hi").cast("bigint")))
    )
    left = series.withColumn("_day", F.floor("time").cast("bigint"))
    same_day = [left[k] == by_day[k] for k in [*keys, "_day"]]
    return (
        left.join(by_day, [*same_day, left["time"].between(by_day["lo"], by_day["hi"])], "left")
        .select(*[left[c] for c in series.columns], by_day["lo"].isNotNull().alias("gap_mask"))
    )


def series_stats(
    series: DataFrame, gaps: DataFrame, keys: Sequence[str] = SERIES_KEY, max_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """Row count, number of gaps and median flux error of every series."""
    stats = group_quantiles(
        series, keys, {"median_flux_err": (F.col("flux_err"), 0.5)}, max_rows, {"n_cadences": F.count(F.lit(1))}
    )
    n_gaps = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gaps"))
    return (
        stats.join(n_gaps, list(keys), "left")
        .withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0).cast("bigint")))
        .select(*keys, "n_cadences", "n_gaps", "median_flux_err")
    )


def sliding_biweight(times: np.ndarray, values: np.ndarray, half: np.ndarray, iterations: int, cval: float) -> np.ndarray:
    """Tukey biweight of the finite values within ``half`` of each time; times are sorted integers.

    Windows of few cadences are sorted one by one, larger ones go through a
    rank tree whose cost does not depend on what a window holds. Both are exact.
    """
    first, last = np.searchsorted(times, times - half, side="left"), np.searchsorted(times, times + half, side="right")
    widest = int((last - first).max()) if len(times) else 0
    if widest <= DIRECT_WINDOW and len(times) and np.isfinite(values).all():
        return _direct_biweight(values, first, last, iterations, cval)
    # a rank tree holds about 50 bytes per cadence and level, so a long series has one per stretch of it
    step = max(TREE_ROWS, 4 * widest)
    out = np.empty(len(times))
    for start in range(0, len(times), step):
        stop = min(start + step, len(times))
        a, b = first[start:stop].min(), last[start:stop].max()
        out[start:stop] = biweight_location(times[a:b], values[a:b], half[a:b], iterations, cval)[start - a : stop - a]
    return out


def _direct_biweight(values: np.ndarray, first: np.ndarray, last: np.ndarray, iterations: int, cval: float) -> np.ndarray:
    n = len(values)
    out = np.empty(n)
    width = int((last - first).max())
    step = max(1, 131_072 // width)  # a block of windows stays in the processor cache
    for start in range(0, n, step):
        stop = min(n, start + step)
        index = first[start:stop, None] + np.arange(width)
        inside = index < last[start:stop, None]
        window = values[np.minimum(index, n - 1)]
        count = inside.sum(axis=1)
        rows = np.arange(stop - start)
        low, high = (count - 1) // 2, count // 2

        def middle(block):
            block[~inside] = np.inf
            block.sort(axis=1)
            return 0.5 * (block[rows, low] + block[rows, high])

        location = middle(window.copy())
        scale = cval * middle(np.abs(window - location[:, None]))
        moving = scale > 0
        factor = (1.0 / np.where(moving, scale, 1.0))[:, None]
        window[~inside] = 0.0
        for _ in range(iterations):
            weight = window - location[:, None]
            weight *= factor
            weight *= weight
            np.subtract(1.0, weight, out=weight)
            np.maximum(weight, 0.0, out=weight)
            weight *= weight
            weight *= inside
            total = weight.sum(axis=1)
            update = np.einsum("ij,ij->i", weight, window) / np.where(total > 0, total, 1.0)
            location = np.where(moving & (total > 0), update, location)
        out[start:stop] = location
    return out


def biweight_detrend(
    series: DataFrame,
    window: float = 0.75,
    iterations: int = 6,
    cval: float = 5.0,
    chunk_days: float = 4.0,
    keys: Sequence[str] = SERIES_KEY,
    piece_rows: int = 100_000,
    errors: bool = False,
) -> DataFrame:
    """Divide the flux by a sliding robust mean; adds ``trend`` and replaces ``flux``.

    A series shorter than the window uses half its span. Spark has no framed
    median, so a kernel works on pieces of ``chunk_days`` with half a window of
    neighbours on each side; a long series becomes many independent pieces.
    Where a series is so dense that a piece would pass ``piece_rows``, its
    pieces are shorter, down to an eighth of the window. Values that are no
    finite number take no part in the trend. With ``errors`` a piece that fails
    does not end the job; it gives one row with its keys and the reason in ``_error``.
    """
    keys = list(keys)
    spans = series.groupBy(*keys).agg(
        (F.max("time_us") - F.min("time_us")).alias("_span"), F.count(F.lit(1)).alias("_rows")
    )
    full = int(window * DAY_US)
    half = (
        F.when(F.col("_span") >= full, F.lit(full // 2))
        .when(F.col("_span") > 0, F.floor(F.col("_span") / 4))
        .otherwise(F.lit(int(0.1 * DAY_US) // 2))
        .cast("bigint")
    )
    fitting = F.floor(F.lit(float(piece_rows)) * F.col("_span") / F.col("_rows")) - F.lit(full)
    chunk = F.least(F.lit(int(chunk_days * DAY_US)), F.greatest(fitting, F.lit(full // 8))).cast("bigint")
    placed = series.join(spans.select(*keys, half.alias("_half"), chunk.alias("_chunk")), keys).withColumn(
        "_home", F.floor(F.col("time_us") / F.col("_chunk")).cast("bigint")
    )
    # a cadence serves every piece that its window reaches into
    first = F.floor((F.col("time_us") - F.col("_half")) / F.col("_chunk")).cast("bigint")
    last = F.floor((F.col("time_us") + F.col("_half")) / F.col("_chunk")).cast("bigint")
    placed = placed.withColumn("_piece", F.explode(F.sequence(first, last)))
    columns = [*series.columns, "trend", *(["_error"] if errors else [])]
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields} | {"trend": "double", "_error": "string"}

    def trend_of(rows: pa.Table, order: np.ndarray) -> np.ndarray:
        times, flux, reach = (rows.column(c).to_numpy()[order] for c in ("time_us", "flux", "_half"))
        return sliding_biweight(times, np.asarray(flux, float), reach, iterations, cval)

    def detrend(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("time_us").to_numpy(), kind="stable")
        core = rows.column("_home").to_numpy()[order] == rows.column("_piece").to_numpy()[order]
        at, trend, error = order[core], np.empty(0), None
        try:
            trend = trend_of(rows, order)[core] if len(at) else trend
        except Exception as reason:  # noqa: BLE001 - whatever is wrong with one piece, the others go on
            if not errors:
                raise
            at, error = order[:1], str(reason)

        def made(name: str) -> pa.Array:
            if name == "_error":
                return pa.array([error] * len(at), pa.string())
            kind = pa.float64() if name == "trend" else plain_kind(rows.schema.field(name).type)
            if error is not None and name not in keys:
                return pa.nulls(len(at), kind)
            if name == "trend":
                return pa.array(trend, kind, from_pandas=True)
            if name == "flux":
                with np.errstate(divide="ignore", invalid="ignore"):
                    flat = np.where(trend == 0, np.nan, np.asarray(rows.column(name).to_numpy()[at], float) / trend)
                return pa.array(flat, kind, from_pandas=True)
            return plain_rows(rows, name, at)

        return pa.table({name: made(name) for name in columns})

    placed = spread(placed, [*keys, "_piece"]).groupBy(*keys, "_piece")
    return placed.applyInArrow(detrend, ", ".join(f"`{c}` {kinds[c]}" for c in columns))


def plain_kind(kind: pa.DataType) -> pa.DataType:
    """The type in which a kernel gives a column of type ``kind`` back to Spark."""
    if pa.types.is_timestamp(kind) and kind.tz is not None:
        return pa.timestamp("us", "UTC")
    plain = lambda field: field.with_type(plain_kind(field.type)).with_nullable(True)
    if pa.types.is_struct(kind):
        return pa.struct([plain(field) for field in kind])
    if pa.types.is_list(kind):
        return pa.list_(plain(kind.value_field))
    if pa.types.is_map(kind):
        return pa.map_(plain_kind(kind.key_type), plain(kind.item_field))
    return kind


def plain_rows(rows: pa.Table, name: str, at: np.ndarray) -> pa.Array:
    """A column at the positions ``at``; what is no number is null."""
    kind = plain_kind(rows.schema.field(name).type)
    out = rows.column(name).combine_chunks().take(pa.array(at)).cast(kind)
    return pa.array(np.asarray(out), kind, from_pandas=True) if pa.types.is_floating(kind) else out


def transit_preserved(
    series: DataFrame, candidates: DataFrame, fraction: float = 0.7, max_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """Does each candidate keep at least ``fraction`` of its expected depth?

    In transit is a centred phase up to half the duration, out of transit the
    next half duration to three halves; both need three points.
    """
    from photospark.functions.scalars import phase, positive

    ckey = ["tic_id", "sector", "planet_num"]
    joined, max_rows = join_to_groups(
        candidates.select(*ckey, "period", "t0", "duration", "depth"), series.select("tic_id", "sector", "time", "flux"),
        SERIES_KEY, max_rows,
    )
    distance = F.abs(phase(F.col("time"), F.col("period"), F.col("t0")))
    half = F.col("duration") / positive(F.col("period")) / 2.0
    zoned = joined.withColumn(
        "_zone", F.when(distance <= half, "in").when(distance <= half * 3.0, "out")
    ).filter("_zone is not null")
    inside, outside = F.when(F.col("_zone") == "in", F.col("flux")), F.when(F.col("_zone") == "out", F.col("flux"))
    zones = group_quantiles(
        zoned, ckey, {"_in": (inside, 0.5), "_out": (outside, 0.5)}, max_rows,
        {"n_in": F.count(inside), "n_out": F.count(outside)},
    )
    measured = F.col("_out") - F.col("_in")
    zero = F.lit(0).cast("bigint")
    return (
        candidates.select(*ckey, "depth")
        .join(zones, ckey, "left")
        .select(
            *ckey,
            F.coalesce("n_in", zero).alias("n_in"),
            F.coalesce("n_out", zero).alias("n_out"),
            measured.alias("measured_depth"),
            F.coalesce(
                (F.col("n_in") >= 3) & (F.col("n_out") >= 3) & (measured >= F.col("depth") * fraction),
                F.lit(False),
            ).alias("preserved"),
        )
    )


def _preprocess_large(
    series: DataFrame,
    meta: DataFrame,
    window: float,
    gap_threshold: float,
    edge_days: float,
    min_cadences: int,
    iterations: int,
    max_rows: int | None,
) -> tuple[DataFrame, DataFrame]:
    """The chain for series too long for one task, step by step over partial aggregates: (clean curves, status).

    The rows are those of ``_clean_series``, errors included: a series has them
    whatever its length. ``_series`` numbers the series, whose key may be null;
    ``meta`` has every number once or more, with a null magnitude where no star is listed.
    """
    key = ["_series"]
    measured = {c: series.schema[c].dataType for c in ("time", "flux", "flux_err")}
    series = series.withColumns({c: F.col(c).cast("double") for c in measured})
    quality = F.col("quality") if "quality" in series.columns else None
    usable = rules.quality_ok(F.col("time"), F.col("flux"), F.col("flux_err"), quality) & F.col("time_us").isNotNull()
    apart = is_number(F.col("time")) & (F.abs(F.col("time") * F.lit(float(DAY_US)) - F.col("time_us")) > TIME_SLACK_US)
    counts = pin(
        series.groupBy(*key).agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(usable).alias("n_masked"), F.count_if(apart).alias("n_apart"))
    )
    sound = series.join(small_side(counts.filter("n_apart = 0").select(*key)), key, "left_semi")
    masked = quality_mask(sound).filter("time_us is not null")
    normal = pin(median_normalise(sigma_clip(masked, keys=key, max_rows=0), keys=key, max_rows=max_rows))
    gaps = pin(find_gaps(normal, gap_threshold, key))
    good = pin(mark_gap_edges(normal, gaps, edge_days, key).filter(~F.col("gap_mask")).drop("gap_mask"))
    # a median has no value where one of its values is none, as infinite ones leave behind
    numbers = good.groupBy(*key).agg(*[F.min(is_number(F.col(c))).alias(f"_{c}") for c in ("flux", "flux_err")])
    stats = series_stats(good, gaps, key, max_rows).join(numbers, key).withColumn(
        "median_flux_err", F.when(F.col("_flux_err") & is_number(F.col("median_flux_err")), F.col("median_flux_err"))
    )
    error = F.when(F.col("n_apart") > 0, F.format_string(TIMES_APART, "n_apart", "n_raw"))
    told = rules.preprocess_status(
        F.col("n_raw"), F.col("n_masked"), F.col("n_cadences"), F.col("tmag"), error, min_cadences=min_cadences
    )
    told = F.when((told == "PREPROCESSED") & F.col("n_cadences").isNull(), f"ERROR: {NO_CADENCE}").otherwise(told)
    status = pin(meta.join(counts, key).join(stats, key, "left").withColumn("status", told))
    kept = good.join(small_side(status.filter("status = 'PREPROCESSED'").select(*key, "_flux").distinct()), key)
    kept = with_group_median(kept, key, {"_m": F.col("flux")}, max_rows)
    positive = F.col("_flux") & is_number(F.col("_m")) & (F.col("_m") > 0)
    kept = kept.withColumn("flux_norm", F.when(positive, F.col("flux") / F.col("_m")).otherwise(F.col("flux"))).drop("_m", "_flux")
    flat = pin(biweight_detrend(kept, window, iterations, keys=key, errors=True))
    failed = small_side(flat.filter("_error is not null").groupBy(*key).agg(F.min("_error").alias("_error")))
    curves = flat.filter("_error is null").drop("_error").join(failed, key, "left_anti")
    status = status.join(failed, key, "left").withColumn("status", F.coalesce(F.concat(F.lit("ERROR: "), F.col("_error")), F.col("status")))
    done = F.col("status") == "PREPROCESSED"
    return (
        curves.withColumns({c: F.col(c).cast(kind) for c, kind in measured.items()}).drop("_series"),
        status.select(*SERIES_KEY, "status", *[F.when(done, F.col(c)).alias(c) for c in STATUS if c != "status"]),
    )


#: Columns of a status row beside the series key.
STATUS = ("status", "n_cadences", "n_gaps", "median_flux_err")


def clip_mask(flux: np.ndarray, sigma: float = 5.0, iters: int = 5) -> np.ndarray:
    """Which values ``sigma_clip`` keeps, for one series in memory."""
    keep = np.ones(len(flux), bool)
    for _ in range(iters):
        kept = flux[keep]
        if not len(kept):
            break
        wide = keep & (np.abs(flux - np.median(kept)) > sigma * kept.std())
        if not wide.any():
            break
        keep &= ~wide
    return keep


def gap_edges(time: np.ndarray, threshold: float, edge_days: float) -> tuple[int, np.ndarray]:
    """(number of gaps, which cadences lie within ``edge_days`` of one), as ``find_gaps`` and ``mark_gap_edges`` have them."""
    order = np.argsort(time, kind="stable")
    time = time[order]
    at = np.flatnonzero(np.diff(time) > threshold)
    near = np.zeros(len(time) + 1, np.int64)
    for low, high in ((time[at] - edge_days, time[at]), (time[at + 1], time[at + 1] + edge_days)):
        np.add.at(near, np.searchsorted(time, low, side="left"), 1)
        np.add.at(near, np.searchsorted(time, high, side="right"), -1)
    marked = np.empty(len(time), bool)
    marked[order] = np.cumsum(near)[:-1] > 0
    return len(at), marked


def _scaled(values: np.ndarray) -> float:
    """What the median divides by: 1 where it is not positive."""
    middle = float(np.median(values)) if len(values) else 1.0
    return middle if middle > 0 else 1.0


def _clean_series(series: dict[str, np.ndarray], tmags: list, window, gap_threshold, edge_days, min_cadences, iterations) -> tuple[list, tuple | None]:
    """(status rows, clean curve or ``None``) of one series in the order of its times, one status row per entry of ``tmags``.

    A curve is the positions of its cadences and their new columns.
    """
    time, flux, flux_err = (np.asarray(series[c], float) for c in ("time", "flux", "flux_err"))
    apart = np.abs(time * DAY_US - np.asarray(series["time_us"], float)) > TIME_SLACK_US
    if apart.any():
        raise ValueError(TIMES_APART % (apart.sum(), len(time)))
    good = ~(np.isnan(time) | np.isnan(series["time_us"]) | np.isnan(flux) | np.isnan(flux_err))
    if "quality" in series:
        quality = np.where(np.isnan(series["quality"]), 0, series["quality"]).astype(np.int64)
        good &= (quality & rules.QUALITY_BITMASK) == 0
    at = np.flatnonzero(good)
    n_masked = len(at)
    at = at[clip_mask(flux[at])]
    scale = _scaled(flux[at])
    n_gaps, near = gap_edges(time[at], gap_threshold, edge_days)
    at = at[~near]
    flux, flux_err = flux[at] / scale, flux_err[at] / scale

    def status(tmag) -> str:
        if n_masked < min_cadences:
            return "TOO_FEW_CADENCES"
        if tmag is not None and tmag < rules.BRIGHT_TMAG:
            return "SATURATED"
        if len(at) < min_cadences:
            return "TOO_FEW_CADENCES"
        return "PREPROCESSED" if len(at) else f"ERROR: {NO_CADENCE}"

    done = ("PREPROCESSED", len(at), n_gaps, float(np.median(flux_err))) if len(at) else None
    rows = [done if (s := status(t)) == "PREPROCESSED" else (s, None, None, None) for t in tmags]
    if done not in rows:
        return rows, None
    times = np.asarray(series["time_us"][at]).astype(np.int64)
    full = int(window * DAY_US)
    span = int(times[-1] - times[0])
    half = full // 2 if span >= full else span // 4 if span > 0 else int(0.1 * DAY_US) // 2
    trend = sliding_biweight(times, flux, np.full(len(times), half), iterations, 5.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return rows, (at, {
            "flux": np.where(trend == 0, np.nan, flux / trend), "flux_err": flux_err, "flux_norm": flux / _scaled(flux), "trend": trend})


def _clean_batch(rows: pa.Table, stars: pa.Table, columns: Sequence[str], options: tuple) -> pa.Table:
    """Clean cadences and status rows of many series: ``rows`` holds their cadences, ``stars`` their magnitudes, both in any order."""
    n = rows.num_rows
    held = {k: pa.chunked_array([*rows.column(k).chunks, *stars.column(k).chunks], rows.schema.field(k).type).combine_chunks() for k in SERIES_KEY}
    number = _numbered(list(held.values()))
    data = {c: rows.column(c).to_numpy() for c in ("time_us", "time", "flux", "flux_err", "quality") if c in rows.column_names}
    order = np.lexsort((data["time_us"], number[:n]))
    data = {c: values[order] for c, values in data.items()}
    starts = np.flatnonzero(np.diff(number[order], prepend=-1))
    # the magnitudes of a series, and the stars that have no cadence
    by_star = np.argsort(number[n:], kind="stable")
    theirs, tmag = number[n:][by_star], stars.column("tmag").to_numpy()[by_star]
    found = number[order[starts]]
    lows, highs = np.searchsorted(theirs, found, side="left"), np.searchsorted(theirs, found, side="right")
    missing = n + by_star[~np.isin(theirs, found)]
    told, told_of, kept, new = [], [], [], []
    for first, last, low, high in zip(starts, [*starts[1:], n], lows, highs):
        tmags = [None if np.isnan(t) else float(t) for t in tmag[low:high]] or [None]
        try:
            status, curve = _clean_series({c: values[first:last] for c, values in data.items()}, tmags, *options)
        except Exception as error:  # noqa: BLE001 - whatever is wrong with one series, the others go on
            status, curve = [(f"ERROR: {error}", None, None, None)] * len(tmags), None
        told += status
        told_of += [order[first]] * len(status)
        if curve is not None:
            kept.append(order[first:last][curve[0]])
            new.append(curve[1])
    told += [("MISSING_RAW", None, None, None)] * len(missing)
    status_of = np.concatenate([np.array(told_of, np.int64), missing])
    kept = np.concatenate([np.empty(0, np.int64), *kept])

    def joined(name: str) -> pa.ChunkedArray:
        """A column of the cadences, then of the status rows; what is no number is null."""
        kind = {"status": pa.string(), "n_cadences": pa.int64(), "n_gaps": pa.int64()}.get(name, pa.float64())
        curve = None
        if name in rows.column_names:
            kind = plain_kind(rows.schema.field(name).type)
            curve = plain_rows(rows, name, kept)
        if name in ("flux", "flux_err", "flux_norm", "trend"):
            curve = pa.array(np.concatenate([np.empty(0), *(columns[name] for columns in new)]), kind, from_pandas=True)
        elif curve is None:
            curve = pa.nulls(len(kept), kind)
        if name in held:
            status = held[name].take(pa.array(status_of))
        elif name in STATUS:
            status = pa.array([row[STATUS.index(name)] for row in told], kind, from_pandas=True)
        else:
            status = pa.nulls(len(told), kind)
        return pa.chunked_array([curve, status], kind)

    return pa.table({name: joined(name) for name in columns})


def _numbered(columns: list[pa.Array]) -> np.ndarray:
    """A whole number from 0 per row, the same for rows that agree in all columns; nulls are equal."""
    out = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode")
        out = out * len(codes.dictionary) + codes.indices.to_numpy()
    return np.unique(out, return_inverse=True)[1]


def preprocess_rows(
    series: DataFrame,
    meta: DataFrame,
    window: float = 0.75,
    gap_threshold: float = 0.1,
    edge_days: float = 0.5,
    min_cadences: int = 500,
    iterations: int = 6,
    max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """The cleaning chain in one frame: clean cadences (``status`` null) and one status row per series.

    Mask, clip and normalise, drop gap edges, apply the exclusion rules,
    detrend, in one kernel: the series are shuffled once and nothing is written
    in between. A call of the kernel takes a batch of short series and of stars,
    or one series above ``ALONE_ROWS``. A series that fails does not end the
    job; it gives ``ERROR: `` and the reason, and no cadences. Only series that
    reach ``PREPROCESSED`` have cadences. ``meta`` may list series without data;
    they get ``MISSING_RAW``. Series above ``max_rows`` take the steps one by
    one, with the same rows; their steps, detrending included, run in this call.
    """
    keys = list(SERIES_KEY)
    options = (window, gap_threshold, edge_days, min_cadences, iterations)
    columns = [*series.columns, "flux_norm", "trend", *STATUS]
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields} | {
        "flux_norm": "double", "trend": "double", "status": "string", "n_cadences": "bigint", "n_gaps": "bigint", "median_flux_err": "double"}
    counts = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    short = F.col("_n") <= ALONE_ROWS
    n_series, largest, n_alone, n_rows = counts.agg(
        F.count(F.lit(1)), F.max("_n"), F.count_if(~short), F.sum(F.when(short, F.col("_n")))
    ).first()
    stars = meta.select(*[F.col(k).cast(series.schema[k].dataType).alias(k) for k in keys], F.col("tmag").cast("double").alias("tmag"))
    n_stars = stars.count()
    small, large, alone = series, None, None
    named, same = [F.col(k).alias(f"_{k}") for k in keys], [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    if max_rows is not None and (largest or 0) > max_rows:
        long = small_side(counts.filter(F.col("_n") > max_rows).select(*named, F.monotonically_increasing_id().alias("_series")))
        large = series.join(long, same).drop(*[f"_{k}" for k in keys])
        theirs = long.join(stars, same, "left").select("_series", *[F.col(f"_{k}").alias(k) for k in keys], "tmag")
        small, stars = series.join(long, same, "left_anti"), stars.join(long, same, "left_anti")
    if n_alone:
        alone = small_side(counts.filter(~short).select(*named, F.lit(True).alias("_alone")))
    # as many batches as their rows ask for, and enough of them for all tasks
    n_batches = max(1, -(-((n_rows or 0) + n_stars) // BATCH_ROWS), min(n_series + n_stars, 8 * series.sparkSession.sparkContext.defaultParallelism))

    def placed(df: DataFrame):
        own = F.xxhash64(*keys)
        batch = F.pmod(own, F.lit(n_batches))
        if alone is not None:
            df, batch = df.join(alone, same, "left"), F.when(F.col("_alone"), own).otherwise(batch)
        df = df.withColumn("_batch", batch).drop("_alone", *[f"_{k}" for k in keys])
        return spread(df, ["_batch"], n_batches + n_alone).groupBy("_batch")

    def kernel(rows: pa.Table, star: pa.Table) -> pa.Table:
        return _clean_batch(rows, star, columns, options)

    out = placed(small).cogroup(placed(stars)).applyInArrow(kernel, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
    if large is None:
        return out
    curves, status = _preprocess_large(large, theirs, *options, max_rows)
    return out.unionByName(curves, allowMissingColumns=True).unionByName(status, allowMissingColumns=True)


def preprocess(series: DataFrame, meta: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``preprocess_rows`` as (clean curves, one status row per series).

    Both sides are views of one plan: to keep both, write ``preprocess_rows``
    once and split it by ``status``.
    """
    rows = preprocess_rows(series, meta, **options)
    done = F.col("status").isNotNull()
    return rows.filter(~done).drop(*STATUS), rows.filter(done).select(*SERIES_KEY, *STATUS)


def mask_transits(series: DataFrame, candidates: DataFrame, value: float = 1.0) -> DataFrame:
    """Set the flux inside the transits of each series' candidates to ``value``."""
    from photospark.functions.scalars import in_transit

    signals = candidates.groupBy(*SERIES_KEY).agg(
        F.collect_list(F.struct("period", "t0", "duration")).alias("_signals")
    )
    hit: Column = F.exists(
        "_signals", lambda s: in_transit(F.col("time"), s["period"], s["t0"], s["duration"])
    )
    return (
        series.join(signals, list(SERIES_KEY), "left")
        .withColumn("flux", F.when(F.coalesce(hit, F.lit(False)), F.lit(value)).otherwise(F.col("flux")))
        .drop("_signals")
    )
