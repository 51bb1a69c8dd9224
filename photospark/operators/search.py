"""Search for periodic box-shaped dips.

Times and periods are whole microseconds, so a cadence falls into the same
phase bin in every engine. A period P is folded into ceil(k * P / duration)
bins, with k bins per duration, and a box of k bins slides cyclically over
them. The score of a box is its improvement of chi-squared over a constant,
counted for dips only. The significance (SDE) of a period search is
(highest - mean) / population deviation of the scores over all trial periods.

Series up to ``max_rows`` are searched by a NumPy kernel, one call per series
and block of periods. Larger series never meet in one task: every task folds
the rows it holds into partial bins, Spark adds the bins up, and windows over
the bins of one period do the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photospark.functions import rules
from photospark.functions.scalars import positive
from photospark.plans.groups import MAX_GROUP_ROWS, row_limit, small_side, split_by_size, spread
from photospark.schema import CANDIDATE_KEY, CANDIDATE_SCHEMA, DAY_US, SERIES_KEY

BINS_PER_DURATION = 4
#: Durations of the search without a grid: 1.2, 2.4 and 4.8 hours.
DEFAULT_DURATIONS_US = (DAY_US // 20, DAY_US // 10, DAY_US // 5)
#: Digits to which scores are rounded before they are compared.
RANK_DIGITS = 7

_PERIODOGRAM = (
    "tic_id bigint, sector int, period_us bigint, duration_us bigint, power double, start_bin int, n_bins int, "
    "depth double, w double, w_in double, n bigint, first_us bigint, chi2_flat double"
)
#: Bins of one series that are kept between the rounds of a search (two doubles each). Beyond, they are folded
#: anew each round: the same sums in another order, which the rounded comparison of scores levels out.
_BINS_KEPT = 8_000_000


def linear_period_grid(low_us: int, high_us: int, n: int) -> np.ndarray:
    """``n`` whole-microsecond periods from ``low_us`` to ``high_us``, equally spaced."""
    return low_us + np.arange(n, dtype=np.int64) * (high_us - low_us) // (n - 1)


def period_grid(
    span_days: float, duration_days: float, low_days: float = 0.5, high_days: float = 30.0, oversampling: float = 2.0
) -> np.ndarray:
    """Trial periods for series of ``span_days``.

    Over the span, neighbouring periods drift apart by at most
    duration / oversampling, which makes the grid geometric.
    """
    step = math.log1p(duration_days / (oversampling * span_days))
    n = int(math.ceil(math.log(high_days / low_days) / step)) + 1
    return np.unique(np.round(DAY_US * np.geomspace(low_days, high_days, n)).astype(np.int64))


def frequency_grid(
    span_days: float, duration_days: float, low_days: float = 0.5, high_days: float = 30.0, oversampling: float = 2.0
) -> np.ndarray:
    """Trial periods even in frequency for series of ``span_days``, longest first period last.

    The step is such that over the span even the longest period drifts from its
    neighbour by at most duration / oversampling.
    """
    step = duration_days / (oversampling * span_days * high_days)
    n = int(math.ceil((1 / low_days - 1 / high_days) / step)) + 1
    return np.unique(np.round(DAY_US / np.linspace(1 / high_days, 1 / low_days, n)).astype(np.int64))


def bin_count(period_us, duration_us, per_duration: int = BINS_PER_DURATION):
    """Number of phase bins, so that ``per_duration`` of them cover a duration."""
    return -(-(period_us * per_duration) // duration_us)


def ranked(power):
    """Scores as they are compared: rounded, so that the order of a sum does not decide; ties go to what comes first."""
    return np.round(power, RANK_DIGITS) if isinstance(power, np.ndarray) else F.round(power, RANK_DIGITS)


def _scored(boxes: DataFrame) -> DataFrame:
    """Add ``depth`` and ``power`` to boxes (w_in, wf_in) of a cycle (w_all, wf_all); as the kernel, a side without weight scores 0."""
    w_out, floor = F.col("w_all") - F.col("w_in"), F.col("w_all") * 1e-9
    valid = (F.col("w_in") > floor) & (w_out > floor)
    depth = F.when(valid, F.try_divide(F.col("wf_all") - F.col("wf_in"), w_out) - F.try_divide(F.col("wf_in"), F.col("w_in"))).otherwise(F.lit(0.0))
    power = F.col("depth") * F.col("depth") * F.col("w_in") * w_out / F.col("w_all")
    return boxes.withColumn("depth", depth).withColumn("power", F.when(F.col("depth") > 0, power).otherwise(F.lit(0.0)))


class _Folder:
    """Folds one series over all trials and finds the best box of each.

    The bins are kept, so that after a change of some fluxes only the changed
    cadences are folded again.
    """

    def __init__(self, times, flux, weight, periods, durations, k=BINS_PER_DURATION):
        self.times, self.flux, self.weight, self.k = times, flux.copy(), weight, k
        self.trials = [(int(p), int(d), int(bin_count(int(p), int(d), k))) for p in periods for d in durations]
        self.uniform = bool((weight == weight[0]).all())
        self.w_all = weight.sum()
        self.keep = sum(n for _, _, n in self.trials) <= _BINS_KEPT
        self.bins = None

    @staticmethod
    def _index(times, period, n_bins):
        return (times - times // period * period) * n_bins // period

    def set_flux(self, where, value):
        """Set the flux of some cadences and bring the kept bins up to date."""
        at = np.flatnonzero(where)
        change = self.weight[at] * (value - self.flux[at])
        self.flux[at] = value
        if self.bins is not None:
            times = self.times[at]
            for (period, _, n_bins), (_, wf) in zip(self.trials, self.bins):
                wf += np.bincount(self._index(times, period, n_bins), weights=change, minlength=n_bins)

    def _fold(self):
        if self.bins is not None:
            yield from self.bins
            return
        weighted = self.weight * self.flux
        kept = []
        for period, _, n_bins in self.trials:
            index = self._index(self.times, period, n_bins)
            if self.uniform:
                w = np.bincount(index, minlength=n_bins) * self.weight[0]
            else:
                w = np.bincount(index, weights=self.weight, minlength=n_bins)
            pair = (w, np.bincount(index, weights=weighted, minlength=n_bins))
            if self.keep:
                kept.append(pair)
            yield pair
        self.bins = kept if self.keep else None

    def periodogram(self) -> dict[str, np.ndarray]:
        w_all, wf_all = self.w_all, (self.weight * self.flux).sum()
        floor = 1e-9 * w_all
        power_of, start_of, depth_of, w_in_of = [], [], [], []
        for (_, _, n_bins), (w, wf) in zip(self.trials, self._fold()):
            box = min(self.k, n_bins - 1)
            w_in, wf_in = w.copy(), wf.copy()
            for j in range(1, box):
                w_in[: n_bins - j] += w[j:]
                w_in[n_bins - j :] += w[:j]
                wf_in[: n_bins - j] += wf[j:]
                wf_in[n_bins - j :] += wf[:j]
            w_out = w_all - w_in
            valid = (w_in > floor) & (w_out > floor)
            if not valid.all():
                w_in, w_out = np.where(valid, w_in, 1.0), np.where(valid, w_out, 1.0)
            depth = (wf_all - wf_in) / w_out - wf_in / w_in
            power = np.where(valid & (depth > 0), depth * depth * w_in * w_out / w_all, 0.0)
            best = int(np.argmax(ranked(power)))
            power_of.append(power[best])
            start_of.append(best)
            depth_of.append(depth[best] if valid[best] else 0.0)
            w_in_of.append(w_in[best])
        count = len(self.trials)
        return {
            "period_us": np.array([p for p, _, _ in self.trials]), "duration_us": np.array([d for _, d, _ in self.trials]),
            "power": np.array(power_of), "start_bin": np.array(start_of), "n_bins": np.array([n for _, _, n in self.trials]),
            "depth": np.array(depth_of), "w": np.full(count, w_all), "w_in": np.array(w_in_of),
            "n": np.full(count, len(self.times)), "first_us": np.full(count, self.times.min()),
            "chi2_flat": np.full(count, self.chi2_flat()),
        }

    def chi2_flat(self) -> float:
        weighted = self.weight * self.flux
        return float((weighted * self.flux).sum() - weighted.sum() ** 2 / self.w_all)


def _prepared(series: DataFrame) -> DataFrame:
    """Search input: gap edges dropped, inverse-variance weights."""
    if "gap_mask" in series.columns:
        series = series.filter(~F.coalesce("gap_mask", F.lit(False)))
    ok = rules.quality_ok(F.col("time"), F.col("flux"), F.col("flux_err"), None) & (F.col("flux_err") > 0)
    return series.filter(ok).select(
        *SERIES_KEY, "time_us", "flux", (F.lit(1.0) / (F.col("flux_err") * F.col("flux_err"))).alias("w")
    )


def box_periodogram(
    series: DataFrame,
    periods_us: Sequence[int],
    durations_us: Sequence[int],
    blocks: int | None = None,
    max_rows: int | None = MAX_GROUP_ROWS,
    min_points: int = 1,
    n_series: int | None = None,
) -> DataFrame:
    """Score of the best box for every series of ``min_points`` cadences, trial period and duration.

    A caller that knows the number of series, and with ``max_rows=None`` that
    none of them is large, saves the count of the series.
    """
    rows = _prepared(series)
    if n_series is None or max_rows is not None:
        n_series, max_rows = _profile(rows, max_rows)
    if blocks is None:
        blocks = _period_blocks(series.sparkSession, len(periods_us), n_series)
    small, large, _ = split_by_size(rows, SERIES_KEY, max_rows)
    out = _periodogram_by_series(small, periods_us, durations_us, blocks, min_points, n_series)
    if large is None:
        return out
    return out.unionByName(_periodogram_by_bins(large, periods_us, durations_us).filter(F.col("n") >= min_points))


def _profile(rows: DataFrame, max_rows: int | None) -> tuple[int, int | None]:
    """Number of series, and ``max_rows`` if one of them is larger: one count for both."""
    counts = rows.groupBy(*SERIES_KEY).agg(F.count(F.lit(1)).alias("_n"))
    n_series, largest = counts.agg(F.count(F.lit(1)), F.max("_n")).first()
    return n_series, max_rows if max_rows is not None and (largest or 0) > max_rows else None


def _period_blocks(spark: SparkSession, n_periods: int, n_series: int) -> int:
    """Blocks of periods that keep all cores busy when there are few series."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(64, n_periods, math.ceil(2 * cores / max(1, n_series))))


def _periodogram_by_series(rows, periods_us, durations_us, blocks, min_points, n_series):
    periods = np.asarray(periods_us, dtype=np.int64)
    durations = np.asarray(durations_us, dtype=np.int64)
    keyed = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    names = [part.split()[0] for part in _PERIODOGRAM.split(", ")]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < min_points:
            return pd.DataFrame(columns=names)
        mine = periods[int(pdf["block"].iat[0]) :: blocks]
        found = _Folder(
            pdf["time_us"].to_numpy(np.int64), pdf["flux"].to_numpy(float), pdf["w"].to_numpy(float), mine, durations
        ).periodogram()
        return pd.DataFrame({"tic_id": pdf["tic_id"].iat[0], "sector": pdf["sector"].iat[0], **found})

    placed = spread(keyed, [*SERIES_KEY, "block"], n_series * blocks)
    return placed.groupBy(*SERIES_KEY, "block").applyInPandas(search, _PERIODOGRAM)


def phase_bins(
    rows: DataFrame, periods_us: Sequence[int], durations_us: Sequence[int], bins_in_memory: int = 16_000_000
) -> DataFrame:
    """Weight and weighted flux per (series, period, duration, bin), added up without gathering a series.

    Each task adds its rows to the bins of the series it meets, at most
    ``bins_in_memory`` at a time, and emits those partial bins.
    """
    periods = np.asarray(periods_us, dtype=np.int64)
    durations = np.asarray(durations_us, dtype=np.int64)

    trials = [(int(p), int(d), int(bin_count(int(p), int(d)))) for p in periods for d in durations]
    offsets = np.concatenate(([0], np.cumsum([n for _, _, n in trials])))
    series_in_memory = max(1, bins_in_memory // int(offsets[-1]))

    n_of, first_of = np.array([n for _, _, n in trials]), offsets[:-1]
    period_of, duration_of = (np.array([t[i] for t in trials]) for i in (0, 1))

    def emit(held):
        for (tic, sector), (w, wf) in held.items():
            used = np.flatnonzero(w)
            trial = np.repeat(np.arange(len(trials)), n_of)[used]
            yield pd.DataFrame({
                "tic_id": tic, "sector": sector, "period_us": period_of[trial], "duration_us": duration_of[trial],
                "bin": used - first_of[trial], "w": w[used], "wf": wf[used],
            })

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, part in batch.groupby(["tic_id", "sector"], sort=False):
                if key not in held:
                    if len(held) >= series_in_memory:
                        yield from emit(held)
                        held = {}
                    held[key] = (np.zeros(offsets[-1]), np.zeros(offsets[-1]))
                total, weighted = held[key]
                times = part["time_us"].to_numpy(np.int64)
                w = part["w"].to_numpy(float)
                wf = w * part["flux"].to_numpy(float)
                for (period, _, n_bins), start in zip(trials, offsets):
                    index = times % period * n_bins // period
                    total[start : start + n_bins] += np.bincount(index, weights=w, minlength=n_bins)
                    weighted[start : start + n_bins] += np.bincount(index, weights=wf, minlength=n_bins)
        yield from emit(held)

    partial = rows.mapInPandas(
        fold, "tic_id bigint, sector int, period_us bigint, duration_us bigint, bin int, w double, wf double"
    )
    return partial.groupBy(*SERIES_KEY, "period_us", "duration_us", "bin").agg(
        F.sum("w").alias("w"), F.sum("wf").alias("wf")
    )


def _periodogram_by_bins(rows, periods_us, durations_us):
    bins = phase_bins(rows, periods_us, durations_us)
    trial = [*SERIES_KEY, "period_us", "duration_us"]
    n_bins = F.ceil(F.col("period_us") * BINS_PER_DURATION / F.col("duration_us")).cast("int")
    box = F.least(F.lit(BINS_PER_DURATION), F.col("n_bins") - 1)
    totals = Window.partitionBy(*trial)
    bins = bins.withColumn("n_bins", n_bins).withColumns(
        {"w_all": F.sum("w").over(totals), "wf_all": F.sum("wf").over(totals)}
    )
    # A bin belongs to the boxes that start up to box-1 bins before it, around the cycle.
    boxes = bins.withColumn("_back", F.explode(F.sequence(F.lit(0), box - 1))).groupBy(
        *trial, "n_bins", "w_all", "wf_all",
        F.pmod(F.col("bin") - F.col("_back"), F.col("n_bins")).alias("start_bin"),
    ).agg(F.sum("w").alias("w_in"), F.sum("wf").alias("wf_in"))
    best = F.max_by(
        F.struct("power", "start_bin", "depth", "w_in"), F.struct(ranked(F.col("power")).alias("rank"), (-F.col("start_bin")).alias("early"))
    )
    return _scored(boxes).groupBy(*trial, "n_bins").agg(best.alias("b"), F.first("w_all").alias("w")).join(_totals(rows), list(SERIES_KEY)).select(
        *trial, "b.power", "b.start_bin", "n_bins", "b.depth", "w", "b.w_in", "n", "first_us", "chi2_flat"
    )


def _totals(rows: DataFrame) -> DataFrame:
    w, f = F.col("w"), F.col("flux")
    wf = F.sum(w * f)
    return rows.groupBy(*SERIES_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("time_us").alias("first_us"), (F.sum(w * f * f) - wf * wf / F.sum(w)).alias("chi2_flat")
    )


def fold_tree(rows: np.ndarray) -> np.ndarray:
    """Fold ``rows`` (..., a power of two of cycles, bins of a cycle) at all drifts of 0 to cycles - 1 bins over the rows.

    Folds of neighbouring drifts share the folds of their halves: each level
    adds up pairs of blocks, the second turned by half of the drift.
    """
    cycles, bins = rows.shape[-2:]
    out, size = rows[..., None, :], 1
    while size < cycles:
        size *= 2
        drift = np.arange(size)
        turned = (np.arange(bins) + ((drift + 1) // 2)[:, None]) % bins
        out = out[..., ::2, drift // 2, :] + out[..., 1::2, :, :][..., (drift // 2)[:, None], turned]
    return out[..., 0, :, :]


def tree_trials(n: int, low: int, high: int) -> list[tuple[int, int]]:
    """(bins of the base period, cycles as a power of two) for a series of ``n`` bins; periods leave room for two cycles."""
    return [(p, 1 << (-(-n // p) - 1).bit_length()) for p in range(max(low, BINS_PER_DURATION + 1), min(high, n // 2) + 1)]


_TREE = _PERIODOGRAM.split(", n bigint")[0] + ", centre_us double"
_TREE_NAMES = [part.split()[0] for part in _TREE.split(", ")]


def _tree_kernel(duration: int, width: int, low: int, high: int, blocks: int, max_bins: int):
    """The search of one series (and block of base periods) from its time bins."""
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["bin"].to_numpy(np.int64)
        first = int(at.min())
        n = int(at.max()) - first + 1
        if n > max_bins:
            raise ValueError(f"series of {n} bins of {width} us")
        flat = np.zeros((2, n))
        flat[:, at - first] = pdf["w"].to_numpy(float), pdf["wf"].to_numpy(float)
        w_all, wf_all = flat.sum(axis=1)
        found = []
        for p, cycles in tree_trials(n, low, high)[int(pdf["block"].iat[0]) :: blocks]:
            padded = np.zeros((2, cycles * p))
            padded[:, :n] = flat
            folded = fold_tree(padded.reshape(2, cycles, p))[:, :-1]
            w_in, wf_in = sum(np.roll(folded, -k, axis=-1) for k in range(BINS_PER_DURATION))
            w_out = w_all - w_in
            valid = (w_in > 1e-9 * w_all) & (w_out > 1e-9 * w_all)
            w_in, w_out = np.where(valid, w_in, 1.0), np.where(valid, w_out, 1.0)
            depth = (wf_all - wf_in) / w_out - wf_in / w_in
            power = np.where(valid & (depth > 0), depth * depth * w_in * w_out / w_all, 0.0)
            best = np.argmax(ranked(power), axis=1)
            j = np.arange(cycles - 1)
            found.append(pd.DataFrame({
                "period_us": np.rint(width * (p + j / (cycles - 1))).astype(np.int64), "power": power[j, best], "start_bin": best, "n_bins": p,
                "depth": np.where(valid[j, best], depth[j, best], 0.0), "w": w_all, "w_in": w_in[j, best],
                "centre_us": (first + best + BINS_PER_DURATION / 2.0) * width}))
        if not found:
            return pd.DataFrame(columns=_TREE_NAMES)
        return pd.concat(found).assign(tic_id=pdf["tic_id"].iat[0], sector=pdf["sector"].iat[0], duration_us=duration)[_TREE_NAMES]

    return search


def fast_periodogram(
    series: DataFrame,
    durations_us: Sequence[int] = DEFAULT_DURATIONS_US,
    low_days: float = 0.5,
    high_days: float = 30.0,
    min_points: int = 1,
    max_bins: int = 4_000_000,
) -> DataFrame:
    """Score of the best box for every series over its own grid of trial periods, by a folding tree.

    Cadences are added up in time bins of a quarter of the duration, before
    anything is shuffled, so no series is ever gathered. A base period of p
    bins and its cycles (a power of two M) give the M - 1 periods p + j / (M - 1)
    bins: the grid is as fine as the span needs, and neighbouring periods share
    partial folds. Columns as ``box_periodogram``, and ``centre_us``, the time of the
    centre of the box. Series of more than ``max_bins`` bins are an error.
    """
    rows = _prepared(series)
    totals = _totals(rows).filter(F.col("n") >= min_points)
    n_series = totals.count()
    blocks = _period_blocks(series.sparkSession, 64, n_series * len(durations_us))
    out = None
    for duration in map(int, durations_us):
        width = -(-duration // BINS_PER_DURATION)
        low, high = -(-int(low_days * DAY_US) // width), int(high_days * DAY_US) // width
        bins = rows.groupBy(*SERIES_KEY, F.floor(F.col("time_us") / F.lit(width)).alias("bin")).agg(
            F.sum("w").alias("w"), F.sum(F.col("w") * F.col("flux")).alias("wf"))
        keyed = bins.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        kernel = _tree_kernel(duration, width, low, high, blocks, max_bins)
        part = spread(keyed, [*SERIES_KEY, "block"], n_series * blocks).groupBy(*SERIES_KEY, "block").applyInPandas(kernel, _TREE)
        out = part if out is None else out.unionByName(part)
    return out.join(totals, list(SERIES_KEY))


def best_signal(periodogram: DataFrame, min_sde: float = 1.0) -> DataFrame:
    """One candidate per series from its periodogram; series below ``min_sde`` give none."""
    timed = "centre_us" in periodogram.columns
    rest = ("duration_us", "start_bin", "n_bins", "depth", "w", "w_in", "n", "first_us", "chi2_flat", *(["centre_us"] if timed else []))
    per_period = periodogram.groupBy(*SERIES_KEY, "period_us").agg(
        F.max_by(F.struct("power", *rest), F.struct(ranked(F.col("power")).alias("rank"), (-F.col("duration_us")).alias("short"))).alias("b")
    )
    peak = F.max_by(
        F.struct("period_us", "b.*"), F.struct(ranked(F.col("b.power")).alias("rank"), (-F.col("period_us")).alias("short"))
    )
    spectrum = per_period.groupBy(*SERIES_KEY).agg(
        peak.alias("b"),
        F.max("b.power").alias("top"), F.avg("b.power").alias("mean"), F.stddev_pop("b.power").alias("sd"),
    )
    b = F.col("b")
    # centre of the box, moved to the first transit at or after the start of the series
    centre_us = b["centre_us"] if timed else (b["start_bin"] + BINS_PER_DURATION / 2.0) * b["period_us"] / b["n_bins"]
    first_us = centre_us + F.ceil((b["first_us"] - centre_us) / b["period_us"]) * b["period_us"]
    chi2 = b["chi2_flat"] - b["power"]
    error = F.sqrt(F.lit(1.0) / b["w_in"] + F.lit(1.0) / (b["w"] - b["w_in"]))
    return (
        spectrum.filter("sd > 0")
        .withColumn("sde", (F.col("top") - F.col("mean")) / F.col("sd"))
        .filter(F.col("sde") >= min_sde)
        .select(
            *SERIES_KEY,
            F.lit(1).alias("planet_num"), F.lit(1).alias("candidate_num"),
            (b["period_us"] / DAY_US).alias("period"), (first_us / DAY_US).alias("t0"),
            (b["duration_us"] / DAY_US).alias("duration"), b["depth"].alias("depth"),
            "sde", (b["depth"] / error).alias("snr"), F.lit(0.0).alias("cdpp"),
            chi2.alias("chi2"),
            F.when(b["n"] > 4, chi2 / (b["n"] - 4)).alias("chi2_red"),
        )
    )


def period_search(
    series: DataFrame,
    periods_us: Sequence[int] | None = None,
    durations_us: Sequence[int] | None = None,
    min_points: int = 100,
    min_sde: float = 1.0,
    blocks: int | None = None,
    max_rows: int | None = MAX_GROUP_ROWS,
    n_series: int | None = None,
) -> DataFrame:
    """Strongest dip of every series: period, epoch, duration, depth, SNR, chi-squared and SDE.

    Without ``periods_us`` every series has a grid of its own, from half a day
    to 30 days as far as its span holds two cycles (``fast_periodogram``).
    """
    if periods_us is None:
        power = fast_periodogram(series, durations_us or DEFAULT_DURATIONS_US, min_points=min_points)
    else:
        power = box_periodogram(series, periods_us, durations_us or DEFAULT_DURATIONS_US, blocks, max_rows, min_points, n_series)
    return best_signal(power, min_sde)


def _kernel_rounds(pdf, periods, durations, rounds, min_sde, stop_sde):
    """All rounds of one series in memory; the arithmetic of ``period_search`` per round."""
    times = pdf["time_us"].to_numpy(np.int64)
    folder = _Folder(times, pdf["flux"].to_numpy(float), pdf["w"].to_numpy(float), periods, durations)
    found = []
    for number in range(1, rounds + 1):
        table = pd.DataFrame(folder.periodogram())
        table = table.assign(rank=ranked(table["power"].to_numpy())).sort_values(
            ["period_us", "rank", "duration_us"], ascending=[True, False, True], kind="stable"
        ).drop_duplicates("period_us")
        power = table["power"].to_numpy()
        deviation = power.std()
        if not deviation > 0:
            break
        best = table.iloc[int(np.argmax(table["rank"].to_numpy()))]
        sde = float((power.max() - power.mean()) / deviation)
        if not sde >= min_sde:
            break
        period_us, duration_us = int(best["period_us"]), int(best["duration_us"])
        centre = (best["start_bin"] + BINS_PER_DURATION / 2.0) * period_us / best["n_bins"]
        t0_us = centre + math.ceil((best["first_us"] - centre) / period_us) * period_us
        chi2 = float(best["chi2_flat"] - best["power"])
        error = math.sqrt(1.0 / best["w_in"] + 1.0 / (best["w"] - best["w_in"]))
        found.append((
            pdf["tic_id"].iat[0], pdf["sector"].iat[0], number, number,
            period_us / DAY_US, t0_us / DAY_US, duration_us / DAY_US, best["depth"],
            sde, best["depth"] / error, 0.0, chi2, chi2 / (len(times) - 4) if len(times) > 4 else None,
        ))
        if sde < stop_sde or number == rounds:
            break
        distance = np.abs((times - t0_us + period_us / 2.0) % period_us - period_us / 2.0)
        folder.set_flux(distance <= duration_us / 2.0, 1.0)
    return pd.DataFrame(found, columns=CANDIDATE_SCHEMA.names)


def multi_search(
    series: DataFrame,
    periods_us: Sequence[int],
    durations_us: Sequence[int],
    rounds: int = 3,
    min_points: int = 100,
    min_sde: float = 1.0,
    stop_sde: float = 5.0,
    max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Up to ``rounds`` signals per series; after each one its transits are set to 1.

    A series stops when a signal is below ``min_sde`` (not reported) or below
    ``stop_sde`` (reported). Normal series run all rounds in one kernel call;
    series above ``max_rows`` go through one distributed search per round.
    """
    from photospark.operators.clean import mask_transits

    periods = np.asarray(periods_us, dtype=np.int64)
    durations = np.asarray(durations_us, dtype=np.int64)
    rows = _prepared(series)
    n_series, max_rows = _profile(rows, max_rows)
    small, large, _ = split_by_size(rows, SERIES_KEY, max_rows)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < min_points:
            return pd.DataFrame(columns=CANDIDATE_SCHEMA.names)
        return _kernel_rounds(pdf, periods, durations, rounds, min_sde, stop_sde)

    out = spread(small, SERIES_KEY, n_series).groupBy(*SERIES_KEY).applyInPandas(search, CANDIDATE_SCHEMA)
    if large is None:
        return out
    current = large
    for number in range(1, rounds + 1):
        power = _periodogram_by_bins(current, periods_us, durations_us).filter(F.col("n") >= min_points)
        found = best_signal(power, min_sde).withColumns(
            {"planet_num": F.lit(number), "candidate_num": F.lit(number)}
        )
        found = small_side(found)
        out = out.unionByName(found)
        if number < rounds:
            going = found.filter(F.col("sde") >= stop_sde)
            current = mask_transits(
                current.join(going.select(*SERIES_KEY), list(SERIES_KEY), "left_semi")
                .withColumn("time", F.col("time_us") / DAY_US), going
            )
    return out


def sde_gate(candidates: DataFrame, low: float = rules.SDE_DISCARD, high: float = rules.SDE_FULL) -> DataFrame:
    """Add the significance tier and a false consistency flag where there is none."""
    if "bls_consistent" in candidates.columns:
        flag = F.coalesce(F.col("bls_consistent").cast("boolean"), F.lit(False))
    else:
        flag = F.lit(False)
    return candidates.withColumns(
        {"bls_consistent": flag, "disposition": rules.sde_tier(F.col("sde"), low, high)}
    )


def search_batch(
    series: DataFrame, done: DataFrame, periods_us: Sequence[int], durations_us: Sequence[int], rounds: int = 3,
    **options,
) -> DataFrame:
    """Search only the series that are not in ``done`` (a table with the series key)."""
    pending = series.join(done.select(*SERIES_KEY).distinct(), list(SERIES_KEY), "left_anti")
    return multi_search(pending, periods_us, durations_us, rounds, **options)


def bls_consistent(
    candidates: DataFrame,
    series: DataFrame,
    n_periods: int = 500,
    width: float = 0.05,
    tolerance: float = 0.02,
    min_points: int = 100,
    floor_days: float = 0.1,
    max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``best_period`` and ``bls_consistent``: does a narrow search find the period again?

    ``n_periods`` periods within ``width`` of the candidate, same duration.
    Candidates without a series, or with too few points, get false.
    """
    ckey = list(CANDIDATE_KEY)
    period_us = F.rint(positive(F.col("period")) * DAY_US).try_cast("bigint")
    low = F.greatest(F.rint(F.lit(floor_days * DAY_US)).cast("bigint"), F.floor(period_us * (1.0 - width)))
    wanted = candidates.select(
        *ckey, period_us.alias("_p"), F.rint(positive(F.col("duration")) * DAY_US).try_cast("bigint").alias("_d"),
        low.cast("bigint").alias("_low"), F.floor(period_us * (1.0 + width)).cast("bigint").alias("_high"),
    )
    wanted = wanted.filter((F.col("_p") > 0) & (F.col("_d") > 0) & (F.col("_low") <= F.col("_high")))
    small, large, large_keys = split_by_size(_prepared(series), SERIES_KEY, max_rows)

    def check(rows: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < min_points:
            return pd.DataFrame(columns=[*ckey, "_best"])
        times, flux, weight = rows["time_us"].to_numpy(np.int64), rows["flux"].to_numpy(float), rows["w"].to_numpy(float)
        best = []
        for row in mine.itertuples(index=False):
            grid = linear_period_grid(int(row[4]), int(row[5]), n_periods)
            found = _Folder(times, flux, weight, grid, [row[3]]).periodogram()
            best.append((*row[:3], int(found["period_us"][int(np.argmax(ranked(found["power"])))])))
        return pd.DataFrame(best, columns=[*ckey, "_best"])

    named = wanted.select(*ckey, F.col("_d").alias("d"), F.col("_low").alias("low"), F.col("_high").alias("high"))
    schema = "tic_id bigint, sector int, planet_num int, _best bigint"
    theirs = small.join(wanted.select(*SERIES_KEY).distinct(), list(SERIES_KEY), "left_semi")
    best = theirs.groupBy(*SERIES_KEY).cogroup(named.groupBy(*SERIES_KEY)).applyInPandas(check, schema)
    if large is not None:
        few = small_side(named.join(large_keys, list(SERIES_KEY), "left_semi"))
        best = best.unionByName(_narrow_search_by_bins(few, large, n_periods, min_points))
    difference = F.abs(F.col("_best") - F.col("_p")) / F.col("_p")
    return (
        candidates.join(wanted.select(*ckey, "_p").join(best, ckey), ckey, "left")
        .withColumn("best_period", F.col("_best") / DAY_US)
        .withColumn("bls_consistent", F.coalesce(difference < tolerance, F.lit(False)))
        .drop("_p", "_best")
    )


def _narrow_search_by_bins(wanted, large, n_periods, min_points):
    """The narrow search for series too long for one task: each task folds the rows it holds into partial bins per candidate."""
    ckey = list(CANDIDATE_KEY)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, part in batch.groupby([*ckey, "d", "low", "high"], sort=False):
                periods = linear_period_grid(int(key[4]), int(key[5]), n_periods)
                n_bins = bin_count(periods, int(key[3]))
                if key not in held:
                    held[key] = (np.zeros(int(n_bins.sum())), np.zeros(int(n_bins.sum())))
                total, weighted = held[key]
                times, w = part["time_us"].to_numpy(np.int64), part["w"].to_numpy(float)
                wf = w * part["flux"].to_numpy(float)
                for start, period, n in zip((np.cumsum(n_bins) - n_bins).tolist(), periods.tolist(), n_bins.tolist()):
                    index = times % period * n // period
                    total[start : start + n] += np.bincount(index, weights=w, minlength=n)
                    weighted[start : start + n] += np.bincount(index, weights=wf, minlength=n)
        for key, (total, weighted) in held.items():
            periods = linear_period_grid(int(key[4]), int(key[5]), n_periods)
            n_bins = bin_count(periods, int(key[3]))
            used = np.flatnonzero(total)
            trial = np.repeat(np.arange(n_periods), n_bins)[used]
            yield pd.DataFrame({
                **dict(zip(ckey, key)), "period_us": periods[trial], "n_bins": n_bins[trial],
                "bin": used - (np.cumsum(n_bins) - n_bins)[trial], "w": total[used], "wf": weighted[used],
            })

    counts = large.groupBy(*SERIES_KEY).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_points)
    rows = wanted.join(counts.select(*SERIES_KEY), list(SERIES_KEY)).join(large, list(SERIES_KEY))
    partial = rows.select(*ckey, "d", "low", "high", "time_us", "w", "flux").mapInPandas(
        fold, "tic_id bigint, sector int, planet_num int, period_us bigint, n_bins bigint, bin bigint, w double, wf double")
    trial = [*ckey, "period_us", "n_bins"]
    bins = partial.groupBy(*trial, "bin").agg(F.sum("w").alias("w"), F.sum("wf").alias("wf"))
    everything = Window.partitionBy(*trial)
    box = F.least(F.lit(BINS_PER_DURATION), F.col("n_bins").cast("int") - 1)
    boxes = (
        bins.withColumns({"w_all": F.sum("w").over(everything), "wf_all": F.sum("wf").over(everything)})
        .withColumn("_back", F.explode(F.sequence(F.lit(0), box - 1)))
        .groupBy(*trial, "w_all", "wf_all", F.pmod(F.col("bin") - F.col("_back"), F.col("n_bins")).alias("start"))
        .agg(F.sum("w").alias("w_in"), F.sum("wf").alias("wf_in"))
    )
    return _scored(boxes).groupBy(*ckey).agg(
        F.max_by("period_us", F.struct(ranked(F.col("power")).alias("rank"), (-F.col("period_us")).alias("short"))).alias("_best")
    )


def candidate_ordinal(candidates: DataFrame, keys: Sequence[str] = SERIES_KEY, max_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """Add ``ordinal``: the position of a candidate in its series by falling significance.

    Counts the groups first; only if one has more than ``max_rows`` candidates
    is the order cut into cells.
    """
    order = [F.col("sde").desc(), F.col("planet_num").asc()]
    if row_limit(candidates, keys, max_rows) is None:
        return candidates.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    from photospark.plans.prefix import ordinal, range_cells

    celled = range_cells(candidates, [*[F.col(k) for k in keys], *order], "_range")
    return ordinal(celled, keys, F.col("_range"), order, "ordinal").drop("_range")
