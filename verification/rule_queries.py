"""Classification rules and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from photospark.functions import rules, scalars
from photospark.functions.labels import map_label_kepler, map_label_tfop, map_label_toi
from photospark.operators import search
from verification import views
from verification.catalogue_queries import _TIER_SQL, CK, KEPLER_SQL, TFOP_SQL, TOI_SQL
from verification.registry import query, rounded, sql_r6
from verification.views import DAY_US, with_views

KEY = ("tic_id", "sector", "planet_num")


def _pick(df, *columns):
    return rounded(df.select(*KEY, *columns))


@query(
    "pr4_sde_gate",
    with_views("cand") + f"SELECT {CK}, FALSE AS bls_consistent, CASE WHEN sde < 5 THEN 'DISCARD' WHEN sde < 7 THEN 'SUB_THRESHOLD' "
    "ELSE 'FULL_PIPELINE' END AS disposition FROM cand",
)
def _(spark, sf):
    return _pick(search.sde_gate(views.cand(spark, sf)), "bls_consistent", "disposition")


@query("pr5_gate1", with_views("cand") + f"SELECT {CK} FROM cand WHERE sde >= 7 AND prob_pc > 0.7::DOUBLE")
def _(spark, sf):
    return _pick(views.cand(spark, sf).filter(rules.gate1(F.col("sde"), F.col("prob_pc"))))


@query("pr6_gate2", with_views("cand") + f"SELECT {CK} FROM cand WHERE sde >= 7 AND prob_pc > 0.85::DOUBLE")
def _(spark, sf):
    return _pick(views.cand(spark, sf).filter(rules.gate2(F.col("sde"), F.col("prob_pc"))))


@query(
    "pr7_processable",
    with_views("meta") + "SELECT tic_id FROM meta WHERE download_status = 'SUCCESS' AND (exclusion_reason IS NULL OR exclusion_reason = 'NONE')",
)
def _(spark, sf):
    return views.meta(spark, sf).filter(rules.processable(F.col("download_status"), F.col("exclusion_reason"))).select("tic_id")


_CLASS_SQL = "CASE predicted_class WHEN 0 THEN 'PC' WHEN 1 THEN 'EB' WHEN 2 THEN 'Blend' WHEN 3 THEN 'StellarVar' ELSE 'UNKNOWN' END"
_DISP_SQL = (
    "CASE WHEN sde < 5 THEN 'SUB-THRESHOLD' WHEN predicted_class = 0 THEN 'PLANET CANDIDATE' WHEN predicted_class = 1 THEN 'ECLIPSING BINARY' "
    "WHEN predicted_class = 2 THEN 'BACKGROUND BLEND' WHEN predicted_class = 3 THEN 'STELLAR VARIABILITY' ELSE 'SUB-THRESHOLD' END"
)


@query("pr8_class_label", with_views("cand") + f"SELECT {CK}, {_CLASS_SQL} AS classification FROM cand")
def _(spark, sf):
    return _pick(views.cand(spark, sf), rules.class_label(F.col("predicted_class")).alias("classification"))


@query("pr9_report_disposition", with_views("cand") + f"SELECT {CK}, {_DISP_SQL} AS disposition FROM cand")
def _(spark, sf):
    return _pick(views.cand(spark, sf), rules.report_disposition(F.col("predicted_class"), F.col("sde")).alias("disposition"))


@query(
    "pr10_confidence_tier",
    with_views("cand") + f"SELECT {CK}, {_TIER_SQL} AS inclusive, CASE WHEN prob_pc > 0.9::DOUBLE THEN 'GOLD' WHEN prob_pc > 0.7::DOUBLE "
    "THEN 'SILVER' ELSE 'BRONZE' END AS exclusive FROM cand",
)
def _(spark, sf):
    p = F.col("prob_pc")
    return _pick(
        views.cand(spark, sf), rules.confidence_tier(p, True).alias("inclusive"), rules.confidence_tier(p, False).alias("exclusive")
    )


@query(
    "pr12_crowdsap",
    with_views("meta") + f"SELECT tic_id, {sql_r6('CASE WHEN contratio IS NULL THEN 1.0 ELSE greatest(least(1.0::DOUBLE - contratio, 1.0), 0.0) END')} AS crowdsap FROM meta",
)
def _(spark, sf):
    return rounded(views.meta(spark, sf).select("tic_id", rules.crowdsap(F.col("contratio")).alias("crowdsap")))


_GATE_SQL = """, g AS (SELECT *, crowdsap < 0.5::DOUBLE AND list_position(probs, list_max(probs)) = 1 AS blocked,
  probs[2] + probs[3] + probs[4] + 1e-10::DOUBLE AS rest FROM pred)
"""


@query(
    "pr13_crowdsap_gate",
    with_views("pred") + _GATE_SQL + "SELECT vec_id, " + ", ".join(
        f"{sql_r6(f'CASE WHEN blocked THEN {0.0 if i == 1 else f'probs[{i}] / rest'} ELSE probs[{i}] END')} AS p{i}" for i in range(1, 5)
    ) + " FROM g",
)
def _(spark, sf):
    gated = rules.crowdsap_gate(F.col("probs"), F.col("crowdsap"))
    return rounded(
        views.pred(spark, sf).select("vec_id", gated.alias("g")).select(
            "vec_id", *[F.get("g", F.lit(i)).alias(f"p{i + 1}") for i in range(4)]
        )
    )


@query(
    "pr14_classify_fpp",
    with_views("cand") + f"""SELECT {CK}, CASE WHEN fpp IS NULL OR nfpp IS NULL THEN 'FAILED' WHEN fpp < 0.015::DOUBLE AND nfpp < 0.001::DOUBLE THEN 'VALIDATED'
WHEN fpp < 0.5::DOUBLE AND nfpp < 0.001::DOUBLE THEN 'LIKELY_PLANET' WHEN nfpp > 0.1::DOUBLE THEN 'LIKELY_NEARBY_FP' ELSE 'INCONCLUSIVE' END AS status
FROM (SELECT *, CASE WHEN predicted_class >= 0 THEN prob_pc END AS fpp, CASE WHEN predicted_class = 3 THEN depth * 40.0::DOUBLE ELSE depth / 5.0::DOUBLE END AS nfpp FROM cand)""",
)
def _(spark, sf):
    fpp = F.when(F.col("predicted_class") >= 0, F.col("prob_pc"))
    nfpp = F.when(F.col("predicted_class") == 3, F.col("depth") * 40.0).otherwise(F.col("depth") / 5.0)
    return _pick(views.cand(spark, sf), rules.classify_fpp(fpp, nfpp).alias("status"))


@query(
    "pr15_recovery_verdict",
    with_views("cand") + f"""SELECT {CK}, ext IS NOT NULL AND abs(ext - period) / period < 0.001::DOUBLE AS recovered,
round((1.0::DOUBLE - abs(ext - period) / period) * 100.0::DOUBLE, 4) + 0.0 AS pct,
CASE WHEN ext IS NULL THEN 'NOT_RECOVERED' WHEN abs(ext - period) / period < 0.001::DOUBLE THEN 'CONSISTENT' ELSE 'INCONSISTENT' END AS verdict
FROM (SELECT *, CASE WHEN predicted_class >= 0 THEN period + depth / 7.0::DOUBLE END AS ext FROM cand)""",
)
def _(spark, sf):
    ext = F.when(F.col("predicted_class") >= 0, F.col("period") + F.col("depth") / 7.0)
    found = views.cand(spark, sf).withColumn("v", rules.recovery_verdict(ext, F.col("period")))
    return rounded(
        found.select(
            *KEY, "v.recovered", F.col("v.period_agreement_pct").alias("pct"), F.col("v.status").alias("verdict")
        )
    )


@query("pr16_map_label_kepler", with_views("disp") + f"SELECT row_no, CAST({KEPLER_SQL.replace('trim(disposition) =', 'disposition =')} AS BIGINT) AS label FROM disp")
def _(spark, sf):
    return rounded(views.disp(spark, sf).select("row_no", map_label_kepler(F.col("disposition")).alias("label")))


@query("pr17_map_label_tfop", with_views("disp") + f"SELECT row_no, CAST({TFOP_SQL} AS BIGINT) AS label FROM disp")
def _(spark, sf):
    return rounded(views.disp(spark, sf).select("row_no", map_label_tfop(F.col("disposition")).alias("label")))


@query("pr18_map_label_toi", with_views("disp") + f"SELECT row_no, CAST({TOI_SQL} AS BIGINT) AS label FROM disp")
def _(spark, sf):
    return rounded(views.disp(spark, sf).select("row_no", map_label_toi(F.col("disposition")).alias("label")))


_M = "(time - 1.575::DOUBLE)"
_PH = f"((CASE WHEN {_M} % 3.0::DOUBLE < 0 THEN ({_M} % 3.0::DOUBLE + 3.0::DOUBLE) % 3.0::DOUBLE ELSE {_M} % 3.0::DOUBLE END) / 3.0::DOUBLE)"


@query(
    "pr19_in_transit",
    with_views("lc") + f""", p AS (SELECT *, {_PH} AS ph FROM lc)
SELECT tic_id, time_us, abs(CASE WHEN ph > 0.5 THEN ph - 1.0::DOUBLE ELSE ph END) <= 0.15::DOUBLE / 3.0::DOUBLE / 2.0::DOUBLE AS centred,
ph < 0.15::DOUBLE / 3.0::DOUBLE / 2.0::DOUBLE OR ph > 1.0::DOUBLE - 0.15::DOUBLE / 3.0::DOUBLE / 2.0::DOUBLE AS wrapped FROM p""",
)
def _(spark, sf):
    args = (F.col("time"), F.lit(3.0), F.lit(1.575), F.lit(0.15))
    return views.lc(spark, sf).select(
        "tic_id", "time_us", scalars.in_transit(*args).alias("centred"), scalars.in_transit_wrapped(*args).alias("wrapped")
    )


@query(
    "pr20_verdict_bands",
    with_views("cand") + f"""SELECT {CK}, CASE WHEN prob_pc > 0.5::DOUBLE THEN 'RED' WHEN prob_pc > 0.01::DOUBLE THEN 'AMBER' ELSE 'GREEN' END AS fpp_band,
CASE WHEN depth * 30.0::DOUBLE > 0.1::DOUBLE THEN 'RED' WHEN depth * 30.0::DOUBLE > 0.005::DOUBLE THEN 'AMBER' ELSE 'GREEN' END AS nfpp_band,
{sql_r6('depth * 10.0::DOUBLE + duration')} AS blend, duration > 0.1::DOUBLE AS eb_alert, depth * 10.0::DOUBLE + duration > 0.1::DOUBLE AS blend_alert,
CASE WHEN status = 'F' THEN 'SIGNAL CLEAR. CONFIDENCE METRICS STABLE.' WHEN status = 'O' THEN 'WARNING: HIGH FPP INDICATES LIKELY ECLIPSING BINARY.'
ELSE 'CRITICAL: BACKGROUND STAR DETECTED IN APERTURE BLEND.' END AS verdict FROM cand""",
)
def _(spark, sf):
    disposition = F.when(F.col("status") == "F", "CONFIRMED_PLANET").when(F.col("status") == "O", "BINARY_STAR_ECLIPSE").otherwise("FALSE_ALARM")
    bands = rules.verdict_bands(
        disposition, F.col("prob_pc"), F.col("depth") * 30.0, F.col("duration"), F.col("duration"), F.col("depth") * 10.0
    )
    return rounded(views.cand(spark, sf).select(*KEY, bands.alias("b")).select(*KEY, "b.*"))


@query(
    "pr27_prior_bounds",
    with_views("cand") + f"SELECT {CK}, {sql_r6('greatest(0.001::DOUBLE, depth * 100 * 0.3::DOUBLE)')} AS rp_min, {sql_r6('least(0.5::DOUBLE, depth * 100 * 3.0::DOUBLE)')} AS rp_max, "
    f"{sql_r6('greatest(60.0::DOUBLE, 90.0::DOUBLE * prob_pc - 15.0::DOUBLE)')} AS inc_min, 90.0::DOUBLE AS inc_max, {sql_r6('greatest(1.0::DOUBLE, sde * 0.3::DOUBLE)')} AS a_min, {sql_r6('sde * 3.0::DOUBLE')} AS a_max, "
    f"{sql_r6('t0 - 0.1::DOUBLE')} AS t0_min, {sql_r6('t0 + 0.1::DOUBLE')} AS t0_max, {sql_r6('period * 0.999::DOUBLE')} AS per_min, {sql_r6('period * 1.001::DOUBLE')} AS per_max FROM cand",
)
def _(spark, sf):
    bounds = rules.prior_bounds(F.col("depth") * 100, F.lit(90.0) * F.col("prob_pc"), F.col("sde"), F.col("t0"), F.col("period"))
    return rounded(views.cand(spark, sf).select(*KEY, bounds.alias("b")).select(*KEY, "b.*"))


@query(
    "sc1_text_codes",
    with_views("disp") + "SELECT row_no, upper(trim(disposition)) AS code, lpad(CAST(tic_id AS VARCHAR), 16, '0') AS padded, "
    "regexp_replace(disposition, '\\s+', '', 'g') AS squeezed FROM disp",
)
def _(spark, sf):
    return views.disp(spark, sf).select(
        "row_no", scalars.norm_code(F.col("disposition")).alias("code"), scalars.pad_id(F.col("tic_id")).alias("padded"),
        scalars.strip_spaces(F.col("disposition")).alias("squeezed"),
    )


@query(
    "sc2_parse_recovery_log",
    with_views("logs") + """, l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM logs),
t AS (SELECT conv_id, turn, no, unnest(regexp_split_to_array(trim(line), '\\s+')) AS tok, unnest(range(len(regexp_split_to_array(trim(line), '\\s+')))) AS i
  FROM l WHERE contains(lower(line), 'best') AND contains(lower(line), 'period')),
n AS (SELECT *, TRY_CAST(tok AS DOUBLE) AS x FROM t WHERE regexp_full_match(tok, '[-.]*[0-9][-.0-9]*')),
s AS (SELECT conv_id, turn, no, arg_min(coalesce(x, -1), i) AS x FROM n WHERE x IS NULL OR x BETWEEN 0.5 AND 30 GROUP BY ALL),
r AS (SELECT conv_id, turn, arg_min(x, no) AS x FROM s WHERE x > 0 GROUP BY ALL)
SELECT logs.conv_id, logs.turn, x AS period FROM logs LEFT JOIN r ON r.conv_id = logs.conv_id AND r.turn = logs.turn""",
)
def _(spark, sf):
    return views.logs(spark, sf).select("conv_id", "turn", scalars.recovery_log_period(F.col("text")).alias("period"))


@query("sc3_phase", with_views("lc") + f", p AS (SELECT *, {_PH} AS ph FROM lc) SELECT tic_id, time_us, {sql_r6('CASE WHEN ph > 0.5 THEN ph - 1.0::DOUBLE ELSE ph END')} AS phase FROM p")
def _(spark, sf):
    return rounded(views.lc(spark, sf).select("tic_id", "time_us", scalars.phase(F.col("time"), F.lit(3.0), F.lit(1.575)).alias("phase")))


@query(
    "sc4_orbit",
    with_views("cand") + f"""SELECT {CK}, {sql_r6('cbrt(6.674e-11::DOUBLE * ((0.5::DOUBLE + prob_pc) * 1.989e30::DOUBLE) * ((period * 86400.0::DOUBLE) * (period * 86400.0::DOUBLE)) / (4.0::DOUBLE * pi() * pi())) / ((0.5::DOUBLE + prob_pc) * 6.957e8::DOUBLE)')} AS a_rs,
{sql_r6('sqrt(depth)')} AS rp, {sql_r6('sqrt(depth) * sqrt(depth) * 1e6::DOUBLE', 3)} AS ppm, {sql_r6('duration * 24.0::DOUBLE')} AS hours,
{sql_r6('duration / 24.0::DOUBLE')} AS days, {sql_r6('t0 + round_even((1325.5::DOUBLE - t0) / period, 0) * period')} AS shifted FROM cand""",
)
def _(spark, sf):
    mass = F.lit(0.5) + F.col("prob_pc")
    rp = scalars.rp_from_depth(F.col("depth"))
    picked = views.cand(spark, sf).select(
        *KEY, scalars.a_over_rs(F.col("period"), mass, mass).alias("a_rs"), rp.alias("rp"),
        F.round(scalars.depth_ppm(rp), 3).alias("ppm"), scalars.days_to_hours(F.col("duration")).alias("hours"),
        scalars.hours_to_days(F.col("duration")).alias("days"),
        scalars.shift_epoch(F.col("t0"), F.col("period"), F.lit(1325.5)).alias("shifted"),
    )
    return rounded(picked)


_T14 = (
    "per / pi() * asin(greatest(least(1.0::DOUBLE / a * sqrt(greatest((rp + 1.0::DOUBLE) * (rp + 1.0::DOUBLE) - (a * cos(radians(inc))) * (a * cos(radians(inc))), 0.0::DOUBLE)) "
    "/ sin(radians(inc)), 1.0::DOUBLE), -1.0::DOUBLE))"
)


@query("sc5_duration_t14", with_views("samples") + f"SELECT tic_id, walker, step, {sql_r6('rp')} AS rp, {sql_r6(_T14)} AS t14 FROM samples")
def _(spark, sf):
    t14 = scalars.duration_t14(F.col("per"), F.col("a"), F.col("inc"), F.col("rp"))
    return rounded(views.samples(spark, sf).select("tic_id", "walker", "step", "rp", t14.alias("t14")))


@query(
    "sc8_softmax",
    with_views("pred") + ", e AS (SELECT vec_id, list_transform(probs, lambda x: exp((ln(x) - ln(list_max(probs))) / 1.5::DOUBLE)) AS e FROM pred) "
    "SELECT vec_id, " + ", ".join(f"{sql_r6(f'e[{i}] / list_sum(e)')} AS p{i}" for i in range(1, 5)) + " FROM e",
)
def _(spark, sf):
    soft = scalars.softmax_t(F.transform("probs", lambda x: F.log(x)), F.lit(1.5))
    return rounded(
        views.pred(spark, sf).select("vec_id", soft.alias("s")).select("vec_id", *[F.get("s", F.lit(i)).alias(f"p{i + 1}") for i in range(4)])
    )


@query(
    "sc9_grids",
    with_views("cand") + f", g AS (SELECT i, 0.5::DOUBLE * pow(10.0, i * (log10(60.0) / 9)) AS p FROM range(10) r(i)) "
    f"SELECT g.i, {sql_r6('any_value(p)')} AS period, count(cand.period) AS longer FROM g LEFT JOIN cand ON cand.period > g.p GROUP BY g.i",
)
def _(spark, sf):
    grid = scalars.log_grid(spark, 0.5, 30.0, 10, "p")
    periods = [row["p"] for row in grid.orderBy("i").collect()]
    counts = views.cand(spark, sf).agg(*[F.count_if(F.col("period") > p).alias(str(i)) for i, p in enumerate(periods)])
    stacked = ", ".join(f"{i}, {p!r}D, `{i}`" for i, p in enumerate(periods))
    return rounded(counts.selectExpr(f"stack(10, {stacked}) AS (i, period, longer)"))


@query(
    "sc10_metadata_json",
    with_views("meta") + f"SELECT tic_id, {sql_r6('tmag')} AS tmag, download_status FROM meta",
)
def _(spark, sf):
    stars = views.meta(spark, sf).select("tic_id", scalars.encode_meta(["tmag", "download_status"]).alias("meta_json"))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("tmag", T.DoubleType()), T.StructField("download_status", T.StringType())])
    return rounded(stars.select("tic_id", scalars.decode_meta(F.col("meta_json"), schema).alias("m")).select("tic_id", "m.*"))


@query(
    "sc11_dates",
    "SELECT o_orderkey, regexp_matches(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '^[0-9]{4}-[0-9]{2}-[0-9]{2}T') AS iso, "
    "regexp_matches(o_orderstatus, '^[0-9]{4}-') AS not_iso, strftime(o_orderdate + to_hours(18), '%Y-%m-%dT%H:%M:%S') AS later FROM orders",
)
def _(spark, sf):
    from verification.registry import table

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    fmt = "yyyy-MM-dd'T'HH:mm:ss"
    return table(spark, sf, "orders").select(
        "o_orderkey", scalars.is_iso8601(F.date_format("o_orderdate", fmt)).alias("iso"),
        scalars.is_iso8601(F.col("o_orderstatus")).alias("not_iso"),
        F.date_format(scalars.hour_offset(F.col("o_orderdate"), F.lit(18)), fmt).alias("later"),
    )


@query(
    "sc12_format",
    with_views("cand") + f"SELECT {CK}, CASE WHEN predicted_class < 0 THEN '—' WHEN predicted_class = 1 THEN printf('%.4f', depth / 7.0::DOUBLE + 0.0000123::DOUBLE) "
    "ELSE printf('%.4f', depth / 7.0::DOUBLE + 0.0000123::DOUBLE) || ' ± ' || printf('%.4f', duration) END AS text FROM cand",
)
def _(spark, sf):
    value = F.when(F.col("predicted_class") >= 0, F.col("depth") / 7.0 + 0.0000123)
    error = F.when(F.col("predicted_class") != 1, F.col("duration"))
    return _pick(views.cand(spark, sf), scalars.fmt_value(value, error).alias("text"))


@query(
    "sc13_clean_num",
    with_views("lc") + f"SELECT tic_id, time_us, {sql_r6('CASE WHEN isnan(flux) THEN -1.0 ELSE flux END')} AS flux FROM lc",
)
def _(spark, sf):
    return rounded(views.lc(spark, sf).select("tic_id", "time_us", scalars.clean_num(F.col("flux"), -1.0).alias("flux")))


@query(
    "wn3_epoch_parity",
    with_views("lc") + ", e AS (SELECT tic_id, time_us, CAST(round_even((time - 14.2::DOUBLE) / 1.7::DOUBLE, 0) AS BIGINT) AS epoch FROM lc) "
    "SELECT tic_id, time_us, epoch, CAST(((epoch % 2) + 2) % 2 AS BIGINT) AS parity FROM e",
)
def _(spark, sf):
    args = (F.col("time"), F.lit(1.7), F.lit(14.2))
    return rounded(views.lc(spark, sf).select(
        "tic_id", "time_us", scalars.epoch_number(*args).alias("epoch"), scalars.epoch_parity(*args).alias("parity")
    ))
