"""Canonical column names, types and units.

Internal units are days for times and durations and a fraction for depths.
Other units appear only at sources and sinks, with the unit in the column
name (``duration_h``, ``depth_ppm``, ``depth_ppt``).
"""

from __future__ import annotations

from pyspark.sql import types as T

DAY_US = 86_400_000_000

SERIES_KEY = ("tic_id", "sector")
CANDIDATE_KEY = ("tic_id", "sector", "planet_num")

SERIES_SCHEMA = T.StructType([
    T.StructField("tic_id", T.LongType()),
    T.StructField("sector", T.IntegerType()),
    T.StructField("time_us", T.LongType()),
    T.StructField("time", T.DoubleType()),
    T.StructField("flux", T.DoubleType()),
    T.StructField("flux_err", T.DoubleType()),
    T.StructField("quality", T.IntegerType()),
])

CANDIDATE_SCHEMA = T.StructType([
    T.StructField("tic_id", T.LongType()),
    T.StructField("sector", T.IntegerType()),
    T.StructField("planet_num", T.IntegerType()),
    T.StructField("candidate_num", T.IntegerType()),
    T.StructField("period", T.DoubleType()),
    T.StructField("t0", T.DoubleType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("depth", T.DoubleType()),
    T.StructField("sde", T.DoubleType()),
    T.StructField("snr", T.DoubleType()),
    T.StructField("cdpp", T.DoubleType()),
    T.StructField("chi2", T.DoubleType()),
    T.StructField("chi2_red", T.DoubleType()),
])

GATED_SCHEMA = T.StructType(
    [f for f in CANDIDATE_SCHEMA.fields if f.name != "candidate_num"]
    + [T.StructField("bls_consistent", T.BooleanType()), T.StructField("disposition", T.StringType())]
)

META_SCHEMA = T.StructType([
    T.StructField("tic_id", T.LongType()),
    T.StructField("sector", T.IntegerType()),
    T.StructField("ra", T.DoubleType()),
    T.StructField("dec", T.DoubleType()),
    T.StructField("tmag", T.DoubleType()),
    T.StructField("teff", T.DoubleType()),
    T.StructField("logg", T.DoubleType()),
    T.StructField("feh", T.DoubleType()),
    T.StructField("crowdsap", T.DoubleType()),
    T.StructField("download_status", T.StringType()),
    T.StructField("exclusion_reason", T.StringType()),
])

TRICERATOPS_SCHEMA = T.StructType([
    T.StructField("tic_id", T.LongType()),
    T.StructField("fpp", T.DoubleType()),
    T.StructField("nfpp", T.DoubleType()),
    T.StructField("classification", T.StringType()),
    T.StructField("status", T.StringType()),
])

POSTERIOR_SCHEMA = T.StructType([
    T.StructField("tic_id", T.LongType()),
    T.StructField("mcmc_converged", T.BooleanType()),
    T.StructField("method", T.StringType()),
    T.StructField("mcmc_rp_rs", T.DoubleType()),
    T.StructField("mcmc_inclination", T.DoubleType()),
    T.StructField("mcmc_a_rs", T.DoubleType()),
    T.StructField("mcmc_t0", T.DoubleType()),
    T.StructField("mcmc_period", T.DoubleType()),
    T.StructField("n_effective_samples", T.LongType()),
])

SIMPLEX_SCHEMA = T.StructType([
    T.StructField("tic_id", T.LongType()),
    T.StructField("nm_rp_rs", T.DoubleType()),
    T.StructField("nm_inclination", T.DoubleType()),
    T.StructField("nm_a_rs", T.DoubleType()),
    T.StructField("nm_t0", T.DoubleType()),
    T.StructField("nm_period", T.DoubleType()),
    T.StructField("nm_chi2", T.DoubleType()),
    T.StructField("nm_converged", T.BooleanType()),
])
