"""Rows of the published products: report, candidate list, star documents, payload, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photospark.functions import rules
from photospark.functions.rules import relative_error
from photospark.functions.scalars import clean_num, days_to_hours, is_number
from photospark.operators.features import transit_epochs
from photospark.operators.fold import bin_centres, explode_view
from photospark.operators.recovery import fold_model
from photospark.schema import CANDIDATE_KEY, SERIES_KEY

# Column orders of the published products.
REPORT_COLUMNS = (
    "tic_id", "period", "depth", "duration", "sde", "snr", "classification", "disposition", "confidence_score",
    "confidence_tier", "period_err", "depth_err", "duration_err", "rp_rs", "rp_rs_err", "inclination", "inclination_err",
)
LIST_COLUMNS = (
    "tic_id", "period", "depth", "sde", "snr", "classification", "disposition", "confidence_score", "confidence_tier", "duration",
)
STAR_COLUMNS = (
    "tic_id", "period", "depth", "duration", "sde", "snr", "classification", "disposition", "confidence_score", "confidence_tier",
    "ra", "dec", "rp_rs", "rp_rs_err", "inclination", "inclination_err", "period_err", "depth_err", "duration_err",
)
PLOTS = {
    "diagnostic_4panel": "diagnostic_4panel.png", "periodogram": "periodogram.html", "phase_folded": "phase_folded.html",
    "softmax": "softmax.html", "corner": "corner.png",
}
#: class number -> disposition word of the payload
PAYLOAD_CLASSES = ("CONFIRMED_PLANET", "BINARY_STAR_ECLIPSE", "BACKGROUND_STELLAR_CONTAMINATION", "FALSE_ALARM")


def _or_null(df: DataFrame, name: str, kind: str = "double") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _judged(catalogue: DataFrame) -> dict[str, Column]:
    """Classification, disposition, confidence and tier as the report words them."""
    label = F.coalesce(_or_null(catalogue, "predicted_class", "int"), F.lit(-1))
    sde = F.coalesce(_or_null(catalogue, "sde"), F.lit(0.0))
    score = clean_num(_or_null(catalogue, "prob_pc"), 0.0)
    return {
        "classification": rules.class_label(label),
        "disposition": rules.report_disposition(label, sde),
        "confidence_score": score,
        "confidence_tier": rules.confidence_tier(score, inclusive=True),
    }


def catalogue_report(catalogue: DataFrame) -> DataFrame:
    """The 17 report columns in order; columns the catalogue lacks are null."""
    judged = _judged(catalogue)
    return catalogue.select(*[
        F.col("tic_id") if c == "tic_id" else (judged[c] if c in judged else _or_null(catalogue, c)).alias(c) for c in REPORT_COLUMNS
    ])


def report_text(report: DataFrame, decimals: int = 6) -> DataFrame:
    """Report rows with fixed decimals, as they are written to CSV."""
    doubles = [f.name for f in report.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return report.withColumns({
        c: F.when(is_number(F.col(c)), F.format_string(f"%.{decimals}f", F.col(c))) for c in doubles
    })


def _measured(catalogue: DataFrame, name: str) -> Column:
    """A measured value; 0 and NaN mean there is none."""
    value = _or_null(catalogue, name)
    return F.when(is_number(value) & (value != 0), value)


def candidate_list(catalogue: DataFrame) -> DataFrame:
    """The ten fields of the candidate list, id as text; no filter is applied."""
    judged = _judged(catalogue)
    sde = clean_num(_or_null(catalogue, "sde"), 0.0)
    out = []
    for c in LIST_COLUMNS:
        value = F.col("tic_id").cast("string") if c == "tic_id" else sde if c == "sde" else judged.get(c)
        out.append((value if value is not None else _measured(catalogue, c)).alias(c))
    return catalogue.select(*out)


def star_documents(
    catalogue: DataFrame, triceratops: DataFrame | None = None, posterior: DataFrame | None = None, min_sde: float = 7.0
) -> DataFrame:
    """One document row per candidate at or above ``min_sde``: values, plot paths, optional verification."""
    chosen = catalogue.filter(is_number(F.col("sde")) & (F.col("sde") >= min_sde))
    judged = _judged(chosen)
    fields = [
        (F.col("tic_id").cast("string") if c == "tic_id" else judged[c] if c in judged else
         clean_num(_or_null(chosen, c), 0.0) if c == "sde" else _measured(chosen, c)).alias(c)
        for c in STAR_COLUMNS
    ]
    plots = F.struct(*[
        F.concat(F.lit("/plots/"), F.col("tic_id").cast("string"), F.lit(f"/{file}")).alias(name) for name, file in PLOTS.items()
    ]).alias("plots")
    keys = [c for c in CANDIDATE_KEY if c != "tic_id"]
    docs = chosen.select(*[F.col(k).alias(f"_{k}") for k in keys if k in chosen.columns], *fields, plots)
    if triceratops is not None:
        verdict = triceratops.select(F.col("tic_id").cast("string").alias("tic_id"), F.struct("fpp", "nfpp").alias("triceratops"))
        docs = docs.join(verdict, "tic_id", "left")
    else:
        docs = docs.withColumn("triceratops", F.lit(None).cast("struct<fpp:double,nfpp:double>"))
    if posterior is not None:
        there = posterior.select(F.col("tic_id").cast("string").alias("tic_id")).distinct().withColumn("_has", F.lit(True))
        docs = docs.join(there, "tic_id", "left").withColumn("mcmc_available", F.coalesce("_has", F.lit(False))).drop("_has")
    else:
        docs = docs.withColumn("mcmc_available", F.lit(False))
    return docs.withColumnsRenamed({f"_{k}": k for k in keys})


def best_per_star(candidates: DataFrame, keys: tuple[str, ...] = ("tic_id",)) -> DataFrame:
    """Most significant candidate of every star (or of the given keys)."""
    ties = [(-F.col(c)).alias(f"_{c}") for c in CANDIDATE_KEY if c in candidates.columns]
    others = [c for c in candidates.columns if c not in keys]
    return candidates.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct(F.col("sde"), *ties)).alias("_b")
    ).select(*keys, "_b.*")


def sector_matrix(candidates: DataFrame, period_tolerance: float = 0.01, depth_tolerance: float = 0.3) -> DataFrame:
    """Recovery of every star sector by sector, measured against its most significant candidate.

    A sector passes if its best period and depth agree with that candidate.
    One sector alone is insufficient data; otherwise the star is recovered if
    at least half of its sectors pass. Sectors are reduced to one row each
    before they are collected.
    """
    sectors = best_per_star(candidates.select(*CANDIDATE_KEY, "period", "depth", "snr", "sde"), SERIES_KEY)
    best = best_per_star(sectors).select("tic_id", F.col("period").alias("_p"), F.col("depth").alias("_d"))
    match = F.coalesce(relative_error(F.col("period"), F.col("_p")) < period_tolerance, F.lit(False))
    consistent = F.coalesce(relative_error(F.col("depth"), F.col("_d")) < depth_tolerance, F.col("depth") == F.col("_d"))
    rows = sectors.join(best, "tic_id").withColumns({"periodMatch": match, "depthConsistency": consistent}).withColumn(
        "status", F.when(F.col("periodMatch") & F.col("depthConsistency"), "PASS").otherwise("FAIL")
    )
    matrix = F.array_sort(F.collect_list(F.struct("sector", "periodMatch", "depthConsistency", "snr", "status")))
    passed, total = F.count_if(F.col("status") == "PASS"), F.count(F.lit(1))
    return rows.groupBy("tic_id").agg(
        matrix.alias("passFailMatrix"),
        F.when(total < 2, "INSUFFICIENT_DATA").when(passed * 2 >= total, "RECOVERED").otherwise("NOT_RECOVERED").alias("overallRecoveryStatus"),
    ).select(
        "tic_id",
        F.transform("passFailMatrix", lambda e: e["sector"]).alias("sectors"),
        F.transform("passFailMatrix", lambda e: e["snr"]).alias("snrPerSector"),
        "passFailMatrix", "overallRecoveryStatus",
    )


def payload_entries(
    candidates: DataFrame, views: DataFrame, triceratops: DataFrame, sectors: DataFrame, n_global: int = 2001, n_local: int = 201
) -> DataFrame:
    """(ticId, entry) of the most significant candidate of every star.

    Depth in parts per thousand and duration in hours. The raw curve is the
    global view and the model curve the local one; missing parts are null.
    """
    best = best_per_star(candidates)
    keys = list(CANDIDATE_KEY)
    words = F.create_map(*[x for i, w in enumerate(PAYLOAD_CLASSES) for x in (F.lit(i), F.lit(w))])
    disposition = F.coalesce(F.try_element_at(words, F.col("predicted_class")), F.lit("FALSE_ALARM"))
    joined = (
        best.join(views.select(*keys, "global_view", "local_view"), keys, "left")
        .join(triceratops.select("tic_id", F.struct("fpp", "nfpp", F.struct("tp", "eb", "heb", "bgob").alias("modes")).alias("triceratops")), "tic_id", "left")
        .join(sectors.select("tic_id", F.struct("sectors", "snrPerSector", "passFailMatrix", "overallRecoveryStatus").alias("sherlock")), "tic_id", "left")
    )
    tic = F.col("tic_id").cast("string")
    signal = F.struct(
        tic.alias("ticId"), F.concat(F.lit("TIC "), tic).alias("name"), "ra", "dec", "period",
        (F.col("depth") * 1000.0).alias("depth"), "sde", "snr", "t0", days_to_hours(F.col("duration")).alias("duration"),
        rules.confidence_tier(F.col("prob_pc")).alias("confidenceTier"), disposition.alias("disposition"),
    )
    curve = F.when(F.col("global_view").isNotNull(), F.struct(
        bin_centres(n_global).alias("rawPhase"), F.col("global_view").alias("rawFlux"),
        bin_centres(n_local).alias("modelPhase"), F.col("local_view").alias("modelFlux"),
    ))
    return joined.select(
        tic.alias("ticId"),
        F.struct(signal.alias("signal"), curve.alias("lightCurve"), F.struct("triceratops", "sherlock").alias("validation")).alias("entry"),
    )


def build_payload(
    entries: DataFrame, documents: int, timestamp: str, version: str = "1.0.0", hour_elapsed: float = 18.0
) -> DataFrame:
    """Payload documents: header and a map of candidates.

    The candidates are spread over ``documents`` maps by the hash of their id,
    so a document stays small; readers join the maps by key.
    """
    spread = entries.withColumn("document", F.pmod(F.xxhash64("ticId"), F.lit(documents)).cast("int"))
    packed = spread.groupBy("document").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("ticId", "entry")), lambda a, b: F.when(
            a["ticId"] < b["ticId"], -1).when(a["ticId"] > b["ticId"], 1).otherwise(0))).alias("candidates")
    )
    return packed.select(
        "document", F.lit(timestamp).alias("timestamp"), F.lit(version).alias("pipelineVersion"),
        F.lit(hour_elapsed).alias("hourElapsed"), "candidates",
    )


# ---- diagnostics -------------------------------------------------------------------


def class_bars(catalogue: DataFrame) -> DataFrame:
    """One row per candidate and class with its probability."""
    return catalogue.selectExpr(
        *CANDIDATE_KEY, "stack(4, 'PC', prob_pc, 'EB', prob_eb, 'Blend', prob_blend, 'StellarVar', prob_sv) AS (class, probability)"
    )


def folded_model(views: DataFrame, fits: DataFrame, n: int, baseline: float = 1.0, keys: tuple[str, ...] = CANDIDATE_KEY) -> DataFrame:
    """Folded flux, model and residual per phase bin of fitted candidates."""
    folded = explode_view(views, "global_view", keys, "flux")
    model = fold_model(fits, n, baseline, keys)
    return folded.join(model, [*keys, "bin"]).withColumn("residual", F.col("flux") - F.col("model"))


def diagnostic_tables(
    candidates: DataFrame, series: DataFrame, views: DataFrame, periodogram: DataFrame, fits: DataFrame, n: int = 2001,
    baseline: float = 1.0,
) -> dict[str, DataFrame]:
    """The tables behind the diagnostic panels of the given candidates.

    The periodogram is the computed one; models come from the fits, not from drawing.
    """
    stars = candidates.select(*SERIES_KEY).distinct()
    return {
        "light_curve": series.join(stars, list(SERIES_KEY), "left_semi"),
        "epochs": transit_epochs(series, candidates),
        "periodogram": periodogram.join(stars, list(SERIES_KEY), "left_semi"),
        "folded": folded_model(views, fits, n, baseline),
        "classes": class_bars(candidates),
    }
