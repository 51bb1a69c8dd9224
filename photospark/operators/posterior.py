"""Summaries of posterior samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.functions.scalars import depth_ppm, duration_t14, is_number
from photospark.plans.groups import MAX_GROUP_ROWS, group_quantiles, row_limit, spread

PARAMETERS = ("rp", "inc", "a", "t0", "per")
#: Lags of the window per autocorrelation time.
WINDOW = 5.0
#: Burn-in and thinning of chains that have no autocorrelation time (no walker moves).
FIXED_BURN, FIXED_THIN = 1000, 10
# Texts of the gate.
NOT_CONVERGED = "MCMC non-convergent — using Nelder-Mead fit"
POORLY_MIXED = "MCMC poorly mixed — using Nelder-Mead fit"


def with_derived(samples: DataFrame) -> DataFrame:
    """Add depth in ppm and transit duration of every sample."""
    t14 = duration_t14(F.col("per"), F.col("a"), F.col("inc"), F.col("rp"))
    return samples.withColumns({"depth_ppm": depth_ppm(F.col("rp")), "duration": F.when(is_number(t14), t14)})


def posterior_quantiles(samples: DataFrame, max_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """Median and distances to the 16th and 84th percentile of five parameters, depth and duration."""
    names = {
        "rp": "mcmc_rp_rs", "inc": "mcmc_inclination", "a": "mcmc_a_rs", "t0": "mcmc_t0", "per": "mcmc_period",
        "depth_ppm": "mcmc_depth_ppm", "duration": "mcmc_duration",
    }
    columns = {c: F.col(c) for c in names}
    wanted = {f"_{c}_{int(q * 100)}": (columns[c], q) for c in names for q in (0.16, 0.5, 0.84)}
    # a group is held once per value column
    max_rows = row_limit(samples, ["tic_id"], None if max_rows is None else max(1, max_rows // len(names)))
    found = group_quantiles(with_derived(samples), ["tic_id"], wanted, max_rows)
    out = [F.col("tic_id")]
    for c, name in names.items():
        low, mid, high = (F.col(f"_{c}_{q}") for q in (16, 50, 84))
        stem = "mcmc_depth" if c == "depth_ppm" else name
        out += [mid.alias(name), (mid - low).alias(f"{stem}_err_low"), (high - mid).alias(f"{stem}_err_high")]
    return found.select(*out)


def thin_chain(samples: DataFrame, burn: int, thin: int) -> DataFrame:
    """Samples after the burn-in, every ``thin``-th step."""
    return samples.filter((F.col("step") >= burn) & (F.pmod(F.col("step") - burn, F.lit(thin)) == 0))


def burn_in(tau_max: float, tau_min: float, n_steps: int) -> tuple[int, int]:
    """Burn-in and thinning from the autocorrelation times; the burn-in stays inside the chain."""
    burn, thin = int(2 * tau_max), max(1, int(0.5 * tau_min))
    return (n_steps // 2 if burn >= n_steps else burn), thin


def autocorrelation(walkers: list[np.ndarray]) -> np.ndarray:
    """Autocorrelation by lag of chains of one parameter, averaged over the walkers that are long enough; still walkers do not count."""
    total, seen = np.zeros(max(map(len, walkers), default=0)), np.zeros(max(map(len, walkers), default=0))
    for chain in walkers:
        n = len(chain)
        apart = chain - chain.mean()
        size = 1 << (2 * n - 1).bit_length()
        own = np.fft.irfft(np.abs(np.fft.rfft(apart, size)) ** 2, size)[:n]
        if own[0] > 1e-20 * n * max(1.0, float(np.abs(chain).max()) ** 2):
            total[:n] += own / own[0]
            seen[:n] += 1
    return total[seen > 0] / seen[seen > 0]


def integrated_time(correlation: np.ndarray, window: float = WINDOW) -> float | None:
    """Integrated autocorrelation time up to the first lag of at least ``window`` times itself (the last lag if there is none)."""
    if not len(correlation):
        return None
    times = 2.0 * np.cumsum(correlation) - 1.0
    enough = np.flatnonzero(np.arange(len(times)) >= window * times)
    return float(times[enough[0] if len(enough) else -1])


def autocorrelation_times(samples: DataFrame, window: float = WINDOW, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """tic_id, parameter, n_steps, tau: the integrated autocorrelation time of every parameter of a star's chains.

    Steps are ordered within their walker, repeated ones by their values;
    ``tau`` is null where no walker moves. The chains of a star meet in one task (steps times walkers, as the
    sampler was set); a star of more than ``max_rows`` samples is an error.
    """
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_rows:
            raise ValueError(f"star {pdf['tic_id'].iat[0]} has {len(pdf)} samples")
        pdf = pdf.sort_values(["walker", "step", *PARAMETERS], kind="stable")
        bounds = np.flatnonzero(np.diff(pdf["walker"].to_numpy())) + 1
        rows = []
        for name in PARAMETERS:
            walkers = np.split(pdf[name].to_numpy(float), bounds)
            rows.append((pdf["tic_id"].iat[0], name, max(map(len, walkers)), integrated_time(autocorrelation(walkers), window)))
        return pd.DataFrame(rows, columns=["tic_id", "parameter", "n_steps", "tau"])

    chains = samples.select("tic_id", "walker", "step", *PARAMETERS)
    return spread(chains, ["tic_id"]).groupBy("tic_id").applyInPandas(kernel, "tic_id bigint, parameter string, n_steps bigint, tau double")


def chain_plan(samples: DataFrame, window: float = WINDOW) -> DataFrame:
    """tic_id, burn, thin of every star, from the autocorrelation times of its chains: twice the longest, half of the shortest."""
    times = autocorrelation_times(samples, window).groupBy("tic_id").agg(
        F.max("tau").alias("longest"), F.min("tau").alias("shortest"), F.max("n_steps").alias("n_steps"))
    known = F.col("longest").isNotNull()
    burn = F.when(known, F.greatest((F.col("longest") * 2).cast("bigint"), F.lit(0))).otherwise(FIXED_BURN)
    thin = F.when(known, F.greatest((F.col("shortest") * 0.5).cast("bigint"), F.lit(1))).otherwise(FIXED_THIN)
    inside = F.when(burn >= F.col("n_steps"), F.floor(F.col("n_steps") / 2)).otherwise(burn)
    return times.select("tic_id", inside.cast("bigint").alias("burn"), thin.cast("bigint").alias("thin"))


def _thinned(samples: DataFrame, burn: int | None, thin: int | None) -> DataFrame:
    if burn is not None and thin is not None:
        return thin_chain(samples, burn, thin)
    plan = chain_plan(samples)
    kept = samples.join(plan, "tic_id").filter((F.col("step") >= F.col("burn")) & (F.pmod(F.col("step") - F.col("burn"), F.col("thin")) == 0))
    return kept.drop("burn", "thin")


def chain_gate(
    samples: DataFrame, acceptance: DataFrame, burn: int | None = None, thin: int | None = None, low: float = 0.2, high: float = 0.5,
    min_samples: int = 100,
) -> DataFrame:
    """Per star: did every walker accept often enough, and are enough samples left?

    Without ``burn`` and ``thin`` they follow from the chains of each star.
    ``acceptance`` holds (tic_id, walker, acceptance).
    """
    rates = acceptance.groupBy("tic_id").agg(
        F.bool_and((F.col("acceptance") > low) & (F.col("acceptance") < high)).alias("_mixed"),
        F.min("acceptance").alias("acceptance_min"), F.max("acceptance").alias("acceptance_max"),
        F.avg("acceptance").alias("acceptance_mean"),
    )
    left = _thinned(samples, burn, thin).groupBy("tic_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    return rates.join(left, "tic_id", "left").select(
        "tic_id", "acceptance_min", "acceptance_max", "acceptance_mean", n.alias("n_effective_samples"),
        (F.col("_mixed") & (n >= min_samples)).alias("mcmc_converged"),
        F.when(F.col("_mixed") & (n >= min_samples), "mcmc").otherwise("nelder_mead").alias("method"),
        F.when(~F.col("_mixed"), NOT_CONVERGED)
        .when(n < min_samples, POORLY_MIXED).alias("flag"),
    )


def summarise_posterior(
    samples: DataFrame, acceptance: DataFrame, burn: int | None = None, thin: int | None = None, max_rows: int | None = MAX_GROUP_ROWS, **limits
) -> DataFrame:
    """Gate of every star, with the quantiles of those that converged and nulls for the others."""
    gate = chain_gate(samples, acceptance, burn, thin, **limits)
    kept = _thinned(samples, burn, thin).join(gate.filter("mcmc_converged").select("tic_id"), "tic_id", "left_semi")
    return gate.join(posterior_quantiles(kept, max_rows), "tic_id", "left")
