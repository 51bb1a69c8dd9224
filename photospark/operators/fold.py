"""Phase folding into fixed-length views and work on those views.

A view is an array column in bin order. Medians per bin are grouped
aggregates; everything on a finished view is an array expression, so a
candidate's views never leave their row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photospark.functions.labels import LABEL_MAPS
from photospark.functions.scalars import array_median, clean_num, is_number, let, phase
from photospark.plans.groups import MAX_GROUP_ROWS, group_quantiles, join_to_groups, row_limit, with_group_median
from photospark.schema import CANDIDATE_KEY, SERIES_KEY

GLOBAL_BINS = 2001
LOCAL_BINS = 201


def half_width(period: Column, duration: Column, small: tuple[float, float] | None = None) -> Column:
    """Half width of the local view in phase: two durations, at most a quarter.

    ``small`` = (limit, value) replaces widths below the limit.
    """
    width = F.least(F.lit(2.0) * (duration / period), F.lit(0.25))
    if small is None:
        return width
    return F.when(width < small[0], F.lit(small[1])).otherwise(width)


def _binned(joined, n_global, n_local, keys, small):
    """One row per (candidate, view, bin, cadence); phase 0.5 is in no bin."""
    width = half_width(F.col("period"), F.col("duration"), small)
    p = F.col("_phase")
    return (
        joined.withColumn("_phase", phase(F.col("time"), F.col("period"), F.col("t0")))
        .withColumn("_hw", width)
        .select(
            *keys, "flux",
            F.explode(F.array_compact(F.array(
                F.when(p < 0.5, F.struct(
                    F.lit("global").alias("view"), F.floor((p + 0.5) * n_global).cast("int").alias("bin")
                )),
                F.when((p >= -F.col("_hw")) & (p < F.col("_hw")), F.struct(
                    F.lit("local").alias("view"),
                    F.least(
                        F.floor((p + F.col("_hw")) / (F.col("_hw") * 2.0) * n_local), F.lit(n_local - 1)
                    ).cast("int").alias("bin"),
                )),
            ))).alias("b"),
        )
        .select(*keys, "b.view", "b.bin", "flux")
    )


def phase_bin(
    series: DataFrame,
    candidates: DataFrame,
    n_global: int = GLOBAL_BINS,
    n_local: int = LOCAL_BINS,
    keys: Sequence[str] = CANDIDATE_KEY,
    series_keys: Sequence[str] = SERIES_KEY,
    small: tuple[float, float] | None = None,
    max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Median flux per (candidate, view, bin) in half-open phase bins; empty bins have no row."""
    keys = list(keys)
    joined, limit = join_to_groups(
        candidates.select(*keys, "period", "t0", "duration"), series.select(*series_keys, "time", "flux"), series_keys, max_rows
    )
    rows = _binned(joined, n_global, n_local, keys, small)
    return group_quantiles(rows, [*keys, "view", "bin"], {"value": (F.col("flux"), 0.5)}, limit)


def _view(entries: Column, n: int, empty: str) -> Column:
    """Array of ``n`` values from sorted (bin, value) entries; ``empty`` fills the bins between them."""
    if empty == "null":
        fill = F.lit(None).cast("double")
    elif empty == "median":
        fill = array_median(F.transform(entries, lambda e: e["value"]))
    else:
        fill = F.lit(0.0)

    def filled(gap: Column) -> Column:
        lead = F.array_repeat(gap, F.coalesce(F.get(entries, F.lit(0))["bin"], F.lit(n)))
        rest = F.transform(
            entries,
            lambda e, i: F.concat(
                F.array(e["value"]),
                F.array_repeat(gap, F.coalesce(F.get(entries, i + 1)["bin"], F.lit(n)) - e["bin"] - 1),
            ),
        )
        return F.concat(lead, F.flatten(rest))

    return let(fill, filled)


def normalise_view(view: Column, flip: bool = False) -> Column:
    """Median 0 and minimum -1; a view without a dip is only shifted.

    ``flip`` also scales a view whose minimum stays positive, with its sign turned.
    """
    def scaled(shifted: Column) -> Column:
        low = F.array_min(shifted)
        scale = F.when(low < -1e-10, F.abs(low))
        if flip:
            scale = scale.when(low > 1e-10, -F.abs(low))
        return let(scale.otherwise(F.lit(1.0)), lambda s: F.transform(shifted, lambda x: x / s))

    clean = F.transform(view, lambda x: clean_num(x, 0.0))
    shifted = let(clean, lambda c: let(array_median(c), lambda m: F.transform(c, lambda x: x - m)))
    return let(shifted, scaled)


def _assembled(bins, keys, n_global, n_local, empty, flip):
    packed = bins.groupBy(*keys).agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("view") == name, F.struct("bin", "value")))).alias(f"_{name}")
            for name in ("global", "local")
        ]
    )
    views = packed.select(
        *keys,
        _view(F.col("_global"), n_global, empty).alias("_g"), _view(F.col("_local"), n_local, empty).alias("_l"),
    )
    return views.select(
        *keys,
        normalise_view(F.col("_g"), flip).alias("global_view"), normalise_view(F.col("_l"), flip).alias("local_view"),
    )


def phase_fold(
    series: DataFrame,
    candidates: DataFrame,
    n_global: int = GLOBAL_BINS,
    n_local: int = LOCAL_BINS,
    min_sde: float | None = 5.0,
    empty_bin: str = "zero",
    flip: bool = False,
    keys: Sequence[str] = CANDIDATE_KEY,
    series_keys: Sequence[str] = SERIES_KEY,
    small: tuple[float, float] | None = None,
    max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Normalised global and local view of every candidate at or above ``min_sde``."""
    if min_sde is not None:
        candidates = candidates.filter(is_number(F.col("sde")) & (F.col("sde") >= min_sde))
    valid = candidates.filter(
        (F.col("period") > 0) & (F.col("duration") > 0) & is_number(F.col("period"))
        & is_number(F.col("duration")) & is_number(F.col("t0"))
    )
    bins = phase_bin(series, valid, n_global, n_local, keys, series_keys, small, max_rows)
    return _assembled(bins, list(keys), n_global, n_local, empty_bin, flip)


def _finite(series: DataFrame) -> DataFrame:
    return series.filter(
        is_number(F.col("time")) & is_number(F.col("flux"))
        & (F.abs("time") != float("inf")) & (F.abs("flux") != float("inf"))
    )


def _long_enough(series, min_points, keys):
    counts = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_points)
    return series.join(counts.select(*keys), list(keys), "left_semi")


def phase_fold_toi(
    series: DataFrame, candidates: DataFrame, n_global: int = GLOBAL_BINS, n_local: int = LOCAL_BINS,
    keys: Sequence[str] = CANDIDATE_KEY, series_keys: Sequence[str] = SERIES_KEY, max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Fold of raw series: median normalisation, one clip at five deviations around 1, 50 points.

    Half widths below 0.005 become 0.05; a missing or non-positive duration counts as two hours.
    """
    sk = list(series_keys)
    max_rows = row_limit(series, sk, max_rows)
    positive = with_group_median(_finite(series), sk, {"_m": F.col("flux")}, max_rows).filter(F.col("_m") > 0)
    scaled = positive.withColumn("flux", F.col("flux") / F.col("_m")).drop("_m")
    spread = scaled.groupBy(*sk).agg(F.stddev_pop("flux").alias("_s"))
    clipped = scaled.join(spread, sk).filter(F.abs(F.col("flux") - 1.0) < F.col("_s") * 5).drop("_s")
    kept = _long_enough(clipped, 50, sk)
    duration = F.when(is_number(F.col("duration")) & (F.col("duration") > 0), F.col("duration")).otherwise(2.0 / 24.0)
    return phase_fold(
        kept, candidates.withColumn("duration", duration), n_global, n_local, None, "zero", True,
        keys, series_keys, (0.005, 0.05), max_rows,
    )


def build_training_views(
    events: DataFrame, series: DataFrame, mapping: str = "kepler", n_global: int = GLOBAL_BINS,
    n_local: int = LOCAL_BINS, min_points: int = 100, max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Labelled views of events (tic_id, event_id, period, t0, duration, label_text) with a usable series.

    Series are cut to finite cadences, need ``min_points`` and a positive
    median, and are normalised by it; events with an unusable label are dropped.
    """
    keys, star = ["tic_id", "event_id"], ["tic_id"]
    max_rows = row_limit(series, star, max_rows)
    labelled = events.withColumn("label", LABEL_MAPS[mapping](F.col("label_text"))).filter(F.col("label") >= 0)
    usable = _long_enough(_finite(series.join(labelled.select("tic_id"), star, "left_semi")), min_points, star)
    positive = with_group_median(usable, star, {"_m": F.col("flux")}, max_rows).filter(F.col("_m") > 0)
    scaled = positive.withColumn("flux", F.col("flux") / F.col("_m")).drop("_m")
    views = phase_fold(
        scaled, labelled, n_global, n_local, None, "zero", True, keys, star, None, max_rows
    )
    return labelled.select(*keys, "label", "period").join(views, keys)


# ---- work on views -------------------------------------------------------------


def shift_view(view: Column, k: Column) -> Column:
    """Shift right by ``k`` bins (left if negative); the edge value fills the freed bins."""
    n = F.size(view)
    return F.transform(view, lambda _, i: F.get(view, F.least(F.greatest(i - k, F.lit(0)), n - 1)))


def explode_view(df: DataFrame, column: str, keys: Sequence[str], name: str = "value") -> DataFrame:
    """Long form of a view: one row per bin.

    The outer form keeps Spark from inferring a filter that would compute the view again.
    """
    return df.select(*keys, F.posexplode_outer(column).alias("bin", name)).filter("bin is not null")


def explode_views(df: DataFrame, keys: Sequence[str], name: str = "value") -> DataFrame:
    """Long form of both views, with a ``view`` column."""
    both = F.array(*[F.struct(F.lit(v).alias("view"), F.col(f"{v}_view").alias("values")) for v in ("global", "local")])
    each = df.select(*keys, F.explode_outer(both).alias("_v"))
    return explode_view(each.select(*keys, "_v.view", F.col("_v.values").alias("_values")), "_values", [*keys, "view"], name)


def bin_centres(n: int, low: float = -0.5, high: float = 0.5) -> Column:
    """Array of the bin centres of a view."""
    width = (high - low) / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(low) + (i + 0.5) * width)
