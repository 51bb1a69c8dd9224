"""Scalar expressions: phases, epochs, orbit geometry, units, softmax, text and JSON."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed physical constants, SI units.
GRAVITY = 6.674e-11
SUN_MASS_KG = 1.989e30
SUN_RADIUS_M = 6.957e8
DAY_SECONDS = 86400.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once.

    Spark evaluates an expression inside a lambda again for every element; a
    lambda variable is bound instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positive(x: Column) -> Column:
    """``x`` where it is a finite number above 0, else null: what may be divided by."""
    return F.when((x > 0) & (x < float("inf")), x)


def phase01(t: Column, period: Column, t0: Column) -> Column:
    """Phase in [0, 1); null where the period is not a positive number."""
    p = positive(period)
    return F.pmod(t - t0, p) / p


def phase(t: Column, period: Column, t0: Column) -> Column:
    """Phase in (-0.5, 0.5], with the transit at 0."""
    p = phase01(t, period, t0)
    return F.when(p > 0.5, p - 1.0).otherwise(p)


def in_transit(t: Column, period: Column, t0: Column, duration: Column) -> Column:
    """Centred form: the phase is at most half the duration away from 0; false without a usable period."""
    return F.coalesce(F.abs(phase(t, period, t0)) <= duration / positive(period) / 2.0, F.lit(False))


def in_transit_wrapped(t: Column, period: Column, t0: Column, duration: Column) -> Column:
    """Wrap-around form: the phase is strictly inside half a duration of 0 or 1; false without a usable period."""
    p = phase01(t, period, t0)
    half = duration / positive(period) / 2.0
    return F.coalesce((p < half) | (p > F.lit(1.0) - half), F.lit(False))


def epoch_number(t: Column, period: Column, t0: Column) -> Column:
    """Nearest transit number, half to even; null without a usable period."""
    return F.rint((t - t0) / positive(period)).try_cast("bigint")


def epoch_parity(t: Column, period: Column, t0: Column) -> Column:
    """1 for odd transit numbers and 0 for even ones, also before ``t0``."""
    return F.pmod(epoch_number(t, period, t0), F.lit(2)).cast("int")


def a_over_rs(period: Column, mass: Column, radius: Column) -> Column:
    """Semi-major axis in stellar radii by Kepler's third law (days, solar masses, solar radii)."""
    seconds = period * DAY_SECONDS
    cube = F.lit(GRAVITY) * (mass * SUN_MASS_KG) * (seconds * seconds) / (4.0 * math.pi * math.pi)
    return F.cbrt(cube) / (positive(radius) * SUN_RADIUS_M)


def duration_t14(period: Column, a: Column, inclination: Column, rp: Column) -> Column:
    """Transit duration from first to last contact; the arcsine argument is clipped to [-1, 1]."""
    angle = F.radians(inclination)
    impact = a * F.cos(angle)
    chord = F.sqrt(F.greatest((rp + 1.0) * (rp + 1.0) - impact * impact, F.lit(0.0)))
    arg = F.try_divide(F.try_divide(F.lit(1.0), a) * chord, F.sin(angle))
    return period / math.pi * F.asin(F.greatest(F.least(arg, F.lit(1.0)), F.lit(-1.0)))


def rp_from_depth(depth: Column) -> Column:
    return F.sqrt(depth)


def depth_ppm(rp: Column) -> Column:
    return rp * rp * 1e6


def hours_to_days(hours: Column) -> Column:
    return hours / 24.0


def days_to_hours(days: Column) -> Column:
    return days * 24.0


def shift_epoch(t0: Column, period: Column, reference: Column) -> Column:
    """Move an epoch by whole periods to the one nearest ``reference``; null without a usable period."""
    return t0 + F.rint((reference - t0) / positive(period)) * period


def softmax_t(logits: Column, temperature: Column) -> Column:
    """Softmax of an array divided by ``temperature``, shifted by its maximum."""
    scaled = F.transform(logits, lambda x: x / temperature)
    powers = let(scaled, lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top))))
    return let(powers, lambda e: let(array_sum(e), lambda total: F.transform(e, lambda x: x / total)))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_median(values: Column) -> Column:
    """Median of an array without nulls; null for an empty array."""
    n = F.size(values)
    low = F.floor((n - 1) / 2).cast("int")
    high = F.floor(n / 2).cast("int")
    middle = let(F.array_sort(values), lambda s: (F.get(s, low) + F.get(s, high)) / 2.0)
    return F.when(n > 0, middle)


def arg_max(values: Column) -> Column:
    """0-based position of the first largest entry of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def log_grid(spark: SparkSession, low: float, high: float, n: int, name: str) -> DataFrame:
    """``n`` points from ``low`` to ``high``, equally spaced in the logarithm, with an index column."""
    step = math.log10(high / low) / (n - 1)
    return spark.range(n).select(
        F.col("id").cast("int").alias("i"),
        (F.lit(low) * F.pow(F.lit(10.0), F.col("id") * F.lit(step))).alias(name),
    )


def linear_grid(spark: SparkSession, low: float, high: float, n: int, name: str) -> DataFrame:
    """``n`` equally spaced points from ``low`` to ``high`` inclusive, with an index column."""
    return spark.range(n).select(
        F.col("id").cast("int").alias("i"),
        (F.lit(float(low)) + F.col("id") * F.lit((high - low) / (n - 1))).alias(name),
    )


def clean_num(value: Column, default: float = 0.0) -> Column:
    """Null, NaN and infinities become ``default``."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(value)


def is_number(value: Column) -> Column:
    """True for a value that is neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def norm_code(text: Column) -> Column:
    """Trimmed upper-case code."""
    return F.upper(F.trim(text))


def pad_id(value: Column, width: int = 16) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def strip_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def is_iso8601(text: Column) -> Column:
    """True for text that starts like ``2026-01-31T12:00:00``."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}")


def hour_offset(base: Column, hours: Column) -> Column:
    """Timestamp ``hours`` after ``base``."""
    return F.timestamp_add("HOUR", hours, base)


def fmt_value(value: Column, error: Column | None = None, decimals: int = 4) -> Column:
    """``1.2345`` or ``1.2345 ± 0.0012``; an em dash where the value is null."""
    plain = F.format_string(f"%.{decimals}f", value)
    if error is None:
        text = plain
    else:
        text = F.when(error.isNull(), plain).otherwise(
            F.concat(plain, F.lit(" ± "), F.format_string(f"%.{decimals}f", error))
        )
    return F.when(value.isNull(), F.lit("—")).otherwise(text)


def encode_meta(columns: Sequence[str]) -> Column:
    """Metadata columns as one JSON document."""
    return F.to_json(F.struct(*columns))


def decode_meta(text: Column, schema: T.StructType) -> Column:
    return F.from_json(text, schema)


def recovery_log_period(text: Column) -> Column:
    """Period reported by a recovery log.

    The first line that holds both "best" and "period" and a plain number from
    0.5 to 30 wins; the number is the first such token of the line. A token
    counts as plain if only digits are left after its dots and hyphens are
    dropped. A token that does not parse ends the search of its line.
    """
    lines = F.filter(
        F.split(text, "\n"),
        lambda line: F.lower(line).contains("best") & F.lower(line).contains("period"),
    )

    def first_number(line: Column) -> Column:
        tokens = F.filter(
            F.split(F.trim(line), r"\s+"), lambda token: token.rlike(r"^[-.]*\d[-.\d]*$")
        )
        numbers = F.transform(tokens, lambda token: token.try_cast("double"))
        hits = F.transform(numbers, lambda x, i: F.when(x.isNull() | x.between(0.5, 30.0), i))
        stop = F.array_min(hits)
        return F.get(numbers, stop)

    return F.get(F.filter(F.transform(lines, first_number), lambda x: x.isNotNull()), F.lit(0))
