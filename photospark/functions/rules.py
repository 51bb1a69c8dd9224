"""Predicates and classification rules as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from photospark.functions.scalars import array_sum, is_number, let

# Class order, names, report wording and thresholds.
CLASS_NAMES = ("PC", "EB", "Blend", "StellarVar")
REPORT_DISPOSITIONS = (
    "PLANET CANDIDATE", "ECLIPSING BINARY", "BACKGROUND BLEND", "STELLAR VARIABILITY",
)
BELOW_THRESHOLD = "SUB-THRESHOLD"
QUALITY_BITMASK = 175
#: Stars brighter than this saturate the detector.
BRIGHT_TMAG = 6.0
SDE_DISCARD = 5.0
SDE_FULL = 7.0
GOLD_CONFIDENCE = 0.90
SILVER_CONFIDENCE = 0.70


def quality_ok(time: Column, flux: Column, err: Column, quality: Column | None, bitmask: int = QUALITY_BITMASK) -> Column:
    """No missing measurement and no flagged bit; a null flag keeps the row."""
    ok = is_number(time) & is_number(flux) & is_number(err)
    if quality is None:
        return ok
    return ok & (F.coalesce(quality, F.lit(0)).bitwiseAND(F.lit(bitmask)) == 0)


def exclusion_reason(tmag: Column, n_cadences: Column, min_cadences: int = 500, bright: float = BRIGHT_TMAG) -> Column:
    """``SATURATED`` before ``TOO_FEW_CADENCES`` before ``NONE``; a missing magnitude never excludes."""
    return (
        F.when(is_number(tmag) & (tmag < bright), "SATURATED")
        .when(n_cadences < min_cadences, "TOO_FEW_CADENCES")
        .otherwise("NONE")
    )


def should_process(tmag: Column, n_cadences: Column) -> Column:
    return exclusion_reason(tmag, n_cadences) == "NONE"


def preprocess_status(
    n_raw: Column, n_masked: Column, n_good: Column, tmag: Column, error: Column | None = None,
    min_cadences: int = 500,
) -> Column:
    """Status of one series from its row counts before and after the cleaning steps."""
    status = (
        F.when(n_raw.isNull() | (n_raw == 0), "MISSING_RAW")
        .when(F.coalesce(n_masked, F.lit(0)) < min_cadences, "TOO_FEW_CADENCES")
        .otherwise(
            F.when(
                exclusion_reason(tmag, F.coalesce(n_good, F.lit(0)), min_cadences) != "NONE",
                exclusion_reason(tmag, F.coalesce(n_good, F.lit(0)), min_cadences),
            ).otherwise("PREPROCESSED")
        )
    )
    if error is None:
        return status
    return F.when(error.isNotNull(), F.concat(F.lit("ERROR: "), error)).otherwise(status)


def sde_tier(sde: Column, low: float = SDE_DISCARD, high: float = SDE_FULL) -> Column:
    """Three significance tiers; NaN falls through to the last one."""
    return (
        F.when(~F.isnan(sde) & (sde < low), "DISCARD")
        .when(~F.isnan(sde) & (sde < high), "SUB_THRESHOLD")
        .otherwise("FULL_PIPELINE")
    )


def gate1(sde: Column, prob_pc: Column) -> Column:
    return is_number(sde) & is_number(prob_pc) & (sde >= 7.0) & (prob_pc > 0.70)


def gate2(sde: Column, prob_pc: Column) -> Column:
    return is_number(sde) & is_number(prob_pc) & (sde >= 7.0) & (prob_pc > 0.85)


def processable(download_status: Column, exclusion: Column) -> Column:
    return (download_status == "SUCCESS") & (exclusion.isNull() | (exclusion == "NONE"))


def class_label(label: Column) -> Column:
    """Class number to name; anything outside 0..3 is ``UNKNOWN``."""
    names = F.create_map(*[x for i, name in enumerate(CLASS_NAMES) for x in (F.lit(i), F.lit(name))])
    return F.coalesce(F.try_element_at(names, label.cast("int")), F.lit("UNKNOWN"))


def report_disposition(label: Column, sde: Column) -> Column:
    """Report wording of a class number; low significance wins over the class."""
    out = F.when(~F.isnan(sde) & (sde < SDE_DISCARD), BELOW_THRESHOLD)
    for i, text in enumerate(REPORT_DISPOSITIONS):
        out = out.when(label == i, text)
    return out.otherwise(BELOW_THRESHOLD)


def confidence_tier(p: Column, inclusive: bool = True) -> Column:
    """Gold, silver or bronze; the thresholds belong to the upper tier if ``inclusive``."""
    def above(threshold):
        return (p >= threshold) if inclusive else (p > threshold)

    known = is_number(p)
    return (
        F.when(known & above(GOLD_CONFIDENCE), "GOLD")
        .when(known & above(SILVER_CONFIDENCE), "SILVER")
        .otherwise("BRONZE")
    )


def crowdsap(contratio: Column) -> Column:
    """Share of the flux that is the target's; a missing ratio gives 1."""
    inside = F.greatest(F.least(F.lit(1.0) - contratio, F.lit(1.0)), F.lit(0.0))
    return F.when(is_number(contratio), inside).otherwise(F.lit(1.0))


def crowdsap_gate(probs: Column, crowding: Column, threshold: float = 0.5) -> Column:
    """Remove the planet class of a crowded aperture where it leads, and rescale the rest.

    ``probs`` is an array in class order; a missing crowding counts as 1.
    """
    blocked = (
        (F.coalesce(crowding, F.lit(1.0)) < threshold)
        & (F.array_position(probs, F.array_max(probs)) == 1)
    )
    rest = F.transform(probs, lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x))
    scaled = let(array_sum(rest) + F.lit(1e-10), lambda total: F.transform(rest, lambda x: x / total))
    return F.when(blocked, scaled).otherwise(probs)


def classify_fpp(fpp: Column, nfpp: Column) -> Column:
    """False-positive class from the total and the nearby probability."""
    return (
        F.when(fpp.isNull() | nfpp.isNull(), "FAILED")
        .when((fpp < 0.015) & (nfpp < 0.001), "VALIDATED")
        .when((fpp < 0.5) & (nfpp < 0.001), "LIKELY_PLANET")
        .when(nfpp > 0.1, "LIKELY_NEARBY_FP")
        .otherwise("INCONCLUSIVE")
    )


def relative_error(value: Column, reference: Column) -> Column:
    return F.abs(value - reference) / F.nullif(reference, F.lit(0.0))


def recovery_verdict(external: Column, period: Column, tolerance: float = 0.001) -> Column:
    """Struct (recovered, period_agreement_pct, status) of an independent period."""
    error = relative_error(external, period)
    return F.struct(
        F.when(external.isNull(), F.lit(False)).otherwise(error < tolerance).alias("recovered"),
        F.round((F.lit(1.0) - error) * 100.0, 4).alias("period_agreement_pct"),
        F.when(external.isNull(), "NOT_RECOVERED")
        .when(error < tolerance, "CONSISTENT")
        .otherwise("INCONSISTENT")
        .alias("status"),
    )


def traffic_light(value: Column, red: float, amber: float) -> Column:
    return F.when(value > red, "RED").when(value > amber, "AMBER").otherwise("GREEN")


def verdict_bands(disposition: Column, fpp: Column, nfpp: Column, eb: Column, heb: Column, bgob: Column) -> Column:
    """Struct of the vetting panel: colour bands, blend probability and verdict text."""
    blend = bgob + heb
    return F.struct(
        traffic_light(fpp, 0.5, 0.01).alias("fpp_band"),
        traffic_light(nfpp, 0.1, 0.005).alias("nfpp_band"),
        blend.alias("blend"),
        (eb > 0.1).alias("eb_alert"),
        (blend > 0.1).alias("blend_alert"),
        F.when(disposition == "CONFIRMED_PLANET", "SIGNAL CLEAR. CONFIDENCE METRICS STABLE.")
        .when(disposition == "BINARY_STAR_ECLIPSE", "WARNING: HIGH FPP INDICATES LIKELY ECLIPSING BINARY.")
        .otherwise("CRITICAL: BACKGROUND STAR DETECTED IN APERTURE BLEND.")
        .alias("verdict"),
    )


def recovery_band(status: Column) -> Column:
    return F.when(status == "RECOVERED", "GREEN").when(status == "NOT_RECOVERED", "RED").otherwise("AMBER")


def detail_eligible(tier: Column, sde: Column) -> Column:
    return (tier == "GOLD") & is_number(sde) & (sde >= 7.0)


def prior_bounds(rp: Column, inclination: Column, a: Column, t0: Column, period: Column) -> Column:
    """Struct of uniform prior limits around a fit."""
    return F.struct(
        F.greatest(F.lit(0.001), rp * 0.3).alias("rp_min"),
        F.least(F.lit(0.5), rp * 3.0).alias("rp_max"),
        F.greatest(F.lit(60.0), inclination - 15.0).alias("inc_min"),
        F.lit(90.0).alias("inc_max"),
        F.greatest(F.lit(1.0), a * 0.3).alias("a_min"),
        (a * 3.0).alias("a_max"),
        (t0 - 0.1).alias("t0_min"),
        (t0 + 0.1).alias("t0_max"),
        (period * 0.999).alias("per_min"),
        (period * 1.001).alias("per_max"),
    )


def any_contains(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out
