"""Ensemble of two classifiers and its temperature calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photospark.functions import rules
from photospark.functions.scalars import arg_max, array_sum, clean_num, let, softmax_t
from photospark.operators.catalogue import cross_grid
from photospark.operators.evaluate import expected_calibration_error

WEIGHTS = (0.6, 0.4)


def ensemble_logits(first: Column, second: Column, weights: tuple[float, float] = WEIGHTS, blend: str = "log") -> Column:
    """Blend two probability arrays in log space, or take the log of their clipped mean (``linear``)."""
    a, b = weights
    if abs(a + b - 1.0) > 1e-6:
        raise ValueError("ensemble weights must add up to 1")
    if blend == "log":
        return F.zip_with(first, second, lambda x, y: F.log(x + 1e-10) * a + F.log(y + 1e-10) * b)
    if blend == "linear":
        return F.zip_with(
            first, second, lambda x, y: F.log(F.least(F.greatest(x * a + y * b, F.lit(1e-10)), F.lit(1.0)))
        )
    raise ValueError(f"unknown blend {blend!r}")


def ensemble(
    df: DataFrame, first: str = "cnn", second: str = "xgb", temperature: float = 1.0, blend: str = "log",
    weights: tuple[float, float] = WEIGHTS, inclusive: bool = False,
) -> DataFrame:
    """Calibrated class probabilities, class and tier of every row with both inputs.

    ``crowdsap`` below one half takes the planet class out where it leads.
    """
    logits = ensemble_logits(F.col(first), F.col(second), weights, blend)
    crowding = clean_num(F.col("crowdsap"), 1.0) if "crowdsap" in df.columns else F.lit(1.0)
    gated = (
        df.withColumn("_p", softmax_t(logits, F.lit(float(temperature))))
        .withColumn("probs", rules.crowdsap_gate(F.col("_p"), crowding))
        .drop("_p")
    )
    names = ("prob_pc", "prob_eb", "prob_blend", "prob_sv")
    return gated.withColumns({
        **{n: F.get("probs", F.lit(i)) for i, n in enumerate(names)},
        "predicted_class": arg_max(F.col("probs")),
    }).withColumn("confidence_tier", rules.confidence_tier(F.col("prob_pc"), inclusive))


def first_temperatures(low: float, high: float, n: int = 41) -> list[float]:
    """Trial temperatures equally spaced in the logarithm."""
    step = math.log(high / low) / (n - 1)
    return [low] + [low * math.exp(i * step) for i in range(1, n - 1)] + [high]


def nll(logits: Column, label: Column, temperature: Column) -> Column:
    """Negative log-likelihood of the labelled class at a temperature."""
    scaled = F.transform(logits, lambda x: x / temperature)
    return let(scaled, lambda s: let(
        F.array_max(s),
        lambda top: F.log(array_sum(F.transform(s, lambda x: F.exp(x - top)))) - (F.get(s, label) - top),
    ))


def temperature_losses(df: DataFrame, temperatures: list[float], objective: str, logits: str = "logits", label: str = "label") -> DataFrame:
    """Loss at every trial temperature: partial sums per task, one row per temperature."""
    tried = cross_grid(df.select(logits, label), temperature=temperatures)
    if objective == "nll":
        return tried.groupBy("temperature").agg(F.avg(nll(F.col(logits), F.col(label), F.col("temperature"))).alias("loss"))
    if objective == "ece":
        soft = tried.withColumn("probs", softmax_t(F.col(logits), F.col("temperature")))
        return expected_calibration_error(soft, label, "probs", 10, ["temperature"]).withColumnRenamed("ece", "loss")
    raise ValueError(f"unknown objective {objective!r}")


def fit_temperature(
    df: DataFrame, objective: str = "nll", logits: str = "logits", label: str = "label", refinements: int = 2, n: int = 41
) -> DataFrame:
    """One row (temperature, loss): the temperature with the lowest loss.

    A grid over [0.01, 10] ([0.1, 10] for calibration error) and
    ``refinements`` finer grids between the neighbours of the best point; the
    smaller temperature wins ties. Only ``n`` losses per grid reach the driver.
    """
    low = 0.01 if objective == "nll" else 0.1
    trials = first_temperatures(low, 10.0, n)
    best = None
    for _ in range(refinements + 1):
        losses = temperature_losses(df, trials, objective, logits, label).collect()
        if not losses:
            break
        best = min(losses, key=lambda row: (row["loss"], row["temperature"]))
        at = trials.index(best["temperature"])
        below, above = trials[max(at - 1, 0)], trials[min(at + 1, n - 1)]
        trials = [below + i * ((above - below) / (n - 1)) for i in range(n)]
    rows = [(best["temperature"], best["loss"])] if best else []
    return df.sparkSession.createDataFrame(rows, "temperature double, loss double")
