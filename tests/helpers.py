"""Synthetic light curves shared by the tests."""

import numpy as np
import pandas as pd

from photospark.schema import DAY_US


def series_frame(time, flux, err=5e-4, tic=1, sector=1, quality=0):
    time = np.asarray(time, float)
    us = np.round(time * DAY_US).astype("int64")
    return pd.DataFrame({
        "tic_id": np.int64(tic), "sector": np.int32(sector), "time_us": us, "time": time, "flux": np.asarray(flux, float),
        "flux_err": np.broadcast_to(np.asarray(err, float), time.shape).copy(), "quality": np.int32(quality),
    })


def transit_curve(n=3000, span=30.0, period=3.0, duration=0.15, depth=0.01, t0=1.5, noise=5e-4, seed=42, **kw):
    rng = np.random.default_rng(seed)
    time = np.linspace(0, span, n)
    flux = 1 + rng.normal(0, noise, n)
    phase = (time - t0 + period / 2) % period - period / 2
    flux[np.abs(phase) < duration / 2] -= depth
    return series_frame(time, flux, noise, **kw)


SERIES_DDL = "tic_id bigint, sector int, time_us bigint, time double, flux double, flux_err double, quality int"


def series_df(spark, *frames):
    return spark.createDataFrame(pd.concat(frames, ignore_index=True), SERIES_DDL)


CAND_DDL = (
    "tic_id bigint, sector int, planet_num int, period double, t0 double, duration double, depth double, sde double, snr double"
)


def cand_df(spark, rows):
    return spark.createDataFrame(rows, CAND_DDL)
