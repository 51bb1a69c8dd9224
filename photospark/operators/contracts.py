"""Checks of catalogues, payload documents and phase outputs; every check returns violations as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photospark.functions.scalars import is_iso8601, is_number
from photospark.operators.catalogue import COLUMN_ALIASES, resolve_columns

# The catalogue contract in canonical names, and the allowed words.
CATALOGUE_CONTRACT = {
    "tic_id": "int", "sector": "int", "tmag": "float", "ra": "float", "dec": "float", "candidate_num": "int",
    "period": "float", "t0": "float", "sde": "float", "snr": "float", "cdpp": "float", "depth": "float",
    "duration": "float", "n_cadences": "int",
    "odd_even_depth_diff": "float", "secondary_eclipse_depth": "float", "centroid_shift_sigma": "float",
    "v_shape_metric": "float", "crowdsap": "float", "duration_period_ratio": "float",
    "predicted_class": "int", "prob_pc": "float", "prob_eb": "float", "prob_blend": "float", "prob_sv": "float",
    "confidence_tier": "string",
}
TIERS = ("GOLD", "SILVER", "BRONZE", "FALSE_POSITIVE")
PAYLOAD_DISPOSITIONS = (
    "CONFIRMED_PLANET", "BINARY_STAR_ECLIPSE", "BACKGROUND_STELLAR_CONTAMINATION", "FALSE_ALARM",
)
RECOVERY_STATUSES = ("RECOVERED", "NOT_RECOVERED", "INSUFFICIENT_DATA")
SECTOR_STATUSES = ("PASS", "FAIL")

_SCHEMA = "rule string, column string, severity string, n bigint"


def _type_fits(kind: str, data: T.DataType) -> bool:
    return isinstance(data, T.StringType) if kind == "string" else isinstance(data, T.NumericType)


def validate_catalogue(df: DataFrame) -> DataFrame:
    """Violations (rule, column, severity, n) of the catalogue contract; empty if the table is good.

    Missing columns and values out of range fail, a column of another type
    warns. All value checks share one scan; tiers are compared in any case.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    found = [("missing", c, "FAIL", 1) for c in CATALOGUE_CONTRACT if c not in types]
    found += [
        ("type", c, "WARN", 1) for c, kind in CATALOGUE_CONTRACT.items() if c in types and not _type_fits(kind, types[c])
    ]
    checks: dict[tuple[str, str], Column] = {}
    for c in ("prob_pc", "prob_eb", "prob_blend", "prob_sv"):
        if c in types and _type_fits("float", types[c]):
            checks[("range", c)] = is_number(F.col(c)) & ~F.col(c).between(0.0, 1.0)
    if isinstance(types.get("confidence_tier"), T.StringType):
        checks[("allowed", "confidence_tier")] = ~F.coalesce(F.upper("confidence_tier"), F.lit("NONE")).isin(*TIERS)
    spark = df.sparkSession
    static = spark.createDataFrame(found, _SCHEMA)
    if not checks:
        return static
    counts = df.agg(*[F.count_if(bad).alias(f"_{i}") for i, bad in enumerate(checks.values())])
    rows = ", ".join(f"'{rule}', '{c}', 'FAIL', _{i}" for i, (rule, c) in enumerate(checks))
    values = counts.selectExpr(f"stack({len(checks)}, {rows}) AS (rule, column, severity, n)").filter("n > 0")
    return static.unionByName(values)


def validate_payload(documents: DataFrame) -> DataFrame:
    """Violations (document, ticId, path, rule, severity) of payload documents.

    A document holds timestamp, pipelineVersion, hourElapsed and the map of candidates.
    """
    header = {
        ("timestamp", "iso8601"): F.col("timestamp").isNull() | ~is_iso8601(F.col("timestamp")),
        ("pipelineVersion", "required"): F.col("pipelineVersion").isNull(),
        ("hourElapsed", "required"): F.col("hourElapsed").isNull(),
        ("candidates", "required"): F.col("candidates").isNull(),
    }
    top = documents.select("document", F.lit(None).cast("string").alias("ticId"), _broken(header))
    entries = documents.select("document", F.explode("candidates").alias("key", "entry"))
    s, lc = F.col("entry.signal"), F.col("entry.lightCurve")
    tr, sh = F.col("entry.validation.triceratops"), F.col("entry.validation.sherlock")
    modes = [tr["modes"][m] for m in ("tp", "eb", "heb", "bgob")]
    outside = lambda x, a, b: x.isNull() | F.isnan(x) | ~x.between(a, b)
    unlike = lambda x, allowed: x.isNull() | ~x.isin(*allowed)
    checks = {
        ("signal", "required"): s.isNull(), ("lightCurve", "required"): lc.isNull(),
        ("validation", "required"): tr.isNull() | sh.isNull(),
        ("signal.ticId", "key"): s.isNotNull() & ~s["ticId"].eqNullSafe(F.col("key")),
        ("signal.ra", "range"): outside(s["ra"], 0.0, 360.0),
        ("signal.dec", "range"): outside(s["dec"], -90.0, 90.0),
        ("signal.confidenceTier", "allowed"): unlike(s["confidenceTier"], TIERS),
        ("signal.disposition", "allowed"): unlike(s["disposition"], PAYLOAD_DISPOSITIONS),
        **{(f"signal.{n}", "required"): s[n].isNull() for n in ("name", "period", "depth", "sde", "snr", "t0", "duration")},
        ("lightCurve.raw", "length"): ~F.size(lc["rawPhase"]).eqNullSafe(F.size(lc["rawFlux"])),
        ("lightCurve.model", "length"): ~F.size(lc["modelPhase"]).eqNullSafe(F.size(lc["modelFlux"])),
        ("validation.triceratops.fpp", "range"): outside(tr["fpp"], 0.0, 1.0),
        ("validation.triceratops.nfpp", "required"): tr["nfpp"].isNull(),
        ("validation.triceratops.modes", "required"): tr["modes"].isNull(),
        ("validation.triceratops.modes", "sum"): F.abs(modes[0] + modes[1] + modes[2] + modes[3] - 1.0) > 0.05,
        ("validation.sherlock.sectors", "required"): sh["sectors"].isNull() | sh["snrPerSector"].isNull(),
        ("validation.sherlock.overallRecoveryStatus", "allowed"): unlike(sh["overallRecoveryStatus"], RECOVERY_STATUSES),
        ("validation.sherlock.passFailMatrix", "required"): sh["passFailMatrix"].isNull(),
        ("validation.sherlock.passFailMatrix.status", "allowed"): F.exists(
            sh["passFailMatrix"], lambda e: e["status"].isNull() | ~e["status"].isin(*SECTOR_STATUSES)
        ),
    }
    inner = entries.select("document", F.col("key").alias("ticId"), _broken(checks))
    both = top.unionByName(inner).withColumn("b", F.explode("broken"))
    return both.select(
        "document", "ticId", "b.path", "b.rule", F.when(F.col("b.rule") == "sum", "WARN").otherwise("FAIL").alias("severity")
    )


def _broken(checks: dict[tuple[str, str], Column]) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule")))
        for (path, rule), bad in checks.items()
    ])).alias("broken")


def validate_phase1(
    catalogue: DataFrame, series: DataFrame, min_sde: float = 5.0, on: Sequence[str] = ("tic_id", "sector"),
    aliases: dict[str, Sequence[str]] = COLUMN_ALIASES,
) -> DataFrame:
    """One row per check of a detection catalogue: rule, detail, n and whether it passed.

    Required columns under any of their names, at least one candidate at
    ``min_sde``, and a series for at least half of the referenced ones.
    """
    resolved, missing = resolve_columns(catalogue, aliases)
    spark = catalogue.sparkSession
    columns = spark.createDataFrame(
        [("required_columns", ",".join(missing), len(missing), not missing)], "rule string, detail string, n bigint, passed boolean"
    )
    out = columns
    if "sde" in resolved.columns:
        strong = resolved.agg(F.count_if(is_number(F.col("sde")) & (F.col("sde") >= min_sde)).alias("n"))
        out = out.unionByName(strong.select(
            F.lit("significant_candidates").alias("rule"), F.lit("").alias("detail"), "n", (F.col("n") > 0).alias("passed")
        ))
    if all(c in resolved.columns for c in on):
        referenced = resolved.select(*on).distinct()
        have = series.select(*on).distinct().withColumn("_have", F.lit(1))
        counted = referenced.join(have, list(on), "left").agg(
            F.count_if(F.col("_have").isNull()).alias("n"), F.count(F.lit(1)).alias("_all")
        )
        out = out.unionByName(counted.select(
            F.lit("series_present").alias("rule"), F.lit("").alias("detail"), "n", (F.col("n") <= F.col("_all") * 0.5).alias("passed")
        ))
    return out
