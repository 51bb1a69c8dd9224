"""Rule tables and scalar expressions with their boundaries."""

import math

import pytest
from pyspark.sql import functions as F

from photospark.functions import rules, scalars
from photospark.functions.labels import map_label_kepler, map_label_tfop, map_label_toi
from photospark.operators import catalogue as cat
from photospark.schema import GATED_SCHEMA


def values(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_classify_fpp(spark):
    rows = [
        (0.01, 0.0005), (0.015, 0.0005), (0.014, 0.001), (0.3, 0.0005), (0.5, 0.0005), (0.3, 0.2), (0.9, 0.1), (0.9, 0.11),
        (None, 0.1), (0.1, None), (0.6, 0.05),
    ]
    got = values(spark, "f double, n double", rows, rules.classify_fpp(F.col("f"), F.col("n")))
    assert got == [
        "VALIDATED", "LIKELY_PLANET", "INCONCLUSIVE", "LIKELY_PLANET", "INCONCLUSIVE", "LIKELY_NEARBY_FP", "INCONCLUSIVE",
        "LIKELY_NEARBY_FP", "FAILED", "FAILED", "INCONCLUSIVE",
    ]


def test_recovery_log(spark):
    rows = [
        ("Best period: 3.5 days",), ("best fit\nperiod 2.0",), ("BEST PERIOD 0.5",), ("best period 30.0",), ("best period 0.49",),
        ("best period 30.01 7.0",), ("best period none",), ("",), ("period best -3.0",), ("noise 1.0\nbest period = 2.25 d\nbest period 9.0",),
        ("best period 1.2.3 4.0\nbest period 5.0",), (None,),
    ]
    got = values(spark, "t string", rows, scalars.recovery_log_period(F.col("t")))
    assert got == [3.5, None, 0.5, 30.0, None, 7.0, None, None, None, 2.25, 5.0, None]


def test_labels(spark):
    texts = ["PC", "cp ", "FP", "EB", "beb", "NTP", "nearby eclipsing binary", "Background planet", "odd", "", None, "UNK", "AFP", "penumbra"]
    rows = [(t,) for t in texts]
    t = F.col("t")
    assert values(spark, "t string", rows, map_label_kepler(t)) == [0, 0, 3, 1, 2, 3, 1, 0, 3, -1, -1, 3, 1, 3]
    assert values(spark, "t string", rows, map_label_tfop(t)) == [0, 0, 3, 1, 2, -1, 2, 2, -1, -1, -1, -1, -1, 0]
    assert values(spark, "t string", rows, map_label_toi(t)) == [0, 0, 1, 1, 2, -1, 1, 0, -1, -1, -1, -1, -1, -1]


def test_gates_and_ranking(spark):
    rows = [(1, 8.5, 0.92), (2, 6.0, 0.88), (3, 9.0, 0.65), (4, 7.0, 0.71), (5, 3.5, 0.50), (6, float("nan"), 0.99), (7, 9.0, float("nan"))]
    df = spark.createDataFrame(rows, "tic_id bigint, sde double, prob_pc double")
    sde, p = F.col("sde"), F.col("prob_pc")
    assert {r.tic_id for r in df.filter(rules.gate1(sde, p)).collect()} == {1, 4}
    assert {r.tic_id for r in df.filter(rules.gate2(sde, p)).collect()} == {1}
    ranked = spark.createDataFrame([(i, 7.0 + i, 0.9) for i in range(20)], "tic_id bigint, sde double, prob_pc double")
    assert [r.tic_id for r in cat.top_by_score(ranked, 5).collect()] == [19, 18, 17, 16, 15]


def test_tiers(spark):
    rows = [(0.95,), (0.90,), (0.8,), (0.70,), (0.1,), (None,), (float("nan"),)]
    assert values(spark, "p double", rows, rules.confidence_tier(F.col("p"))) == ["GOLD", "GOLD", "SILVER", "SILVER", "BRONZE", "BRONZE", "BRONZE"]
    assert values(spark, "p double", rows, rules.confidence_tier(F.col("p"), False)) == ["GOLD", "SILVER", "SILVER", "BRONZE", "BRONZE", "BRONZE", "BRONZE"]


def test_crowdsap(spark):
    rows = [(0.2,), (-1.0,), (1.5,), (None,), (float("nan"),)]
    assert values(spark, "c double", rows, rules.crowdsap(F.col("c"))) == [0.8, 1.0, 0.0, 1.0, 1.0]
    probs = F.array(F.lit(0.6), F.lit(0.2), F.lit(0.1), F.lit(0.1))
    out = spark.createDataFrame([(0.4,), (0.5,), (None,)], "c double").select(rules.crowdsap_gate(probs, F.col("c")).alias("g")).collect()
    assert out[0].g[0] == 0.0 and sum(out[0].g) == pytest.approx(1.0) and out[1].g[0] == 0.6 and out[2].g[0] == 0.6


def test_phase_and_parity(spark):
    rows = [(t,) for t in (-2.4, -1.0, 0.0, 1.4, 1.5, 2.5, 3.5)]
    t, p, t0 = F.col("t"), F.lit(2.0), F.lit(0.0)
    got = values(spark, "t double", rows, scalars.phase(t, p, t0))
    want = []
    for (x,) in rows:
        f = (x % 2.0) / 2.0
        want.append(f - 1 if f > 0.5 else f)
    assert got == pytest.approx(want)
    assert values(spark, "t double", rows, scalars.epoch_number(t, p, t0)) == [-1, 0, 0, 1, 1, 1, 2]
    assert values(spark, "t double", rows, scalars.epoch_parity(t, p, t0)) == [1, 0, 0, 1, 1, 1, 0]


def test_orbit(spark):
    row = spark.range(1).select(
        scalars.a_over_rs(F.lit(365.25), F.lit(1.0), F.lit(1.0)).alias("a"),
        scalars.duration_t14(F.lit(2.0), F.lit(10.0), F.lit(90.0), F.lit(0.1)).alias("d"),
        scalars.duration_t14(F.lit(2.0), F.lit(10.0), F.lit(70.0), F.lit(0.1)).alias("none"),
        scalars.shift_epoch(F.lit(1.0), F.lit(3.0), F.lit(20.0)).alias("s"),
    ).first()
    assert row.a == pytest.approx(215.0, rel=0.01)
    assert row.d == pytest.approx(2.0 / math.pi * math.asin(0.11)) and row.none == 0.0 and row.s == 19.0


def test_prior_bounds(spark):
    b = spark.range(1).select(rules.prior_bounds(F.lit(0.1), F.lit(88.0), F.lit(10.0), F.lit(0.0), F.lit(2.0)).alias("b")).first().b
    assert (b.rp_min, b.rp_max, b.inc_max) == pytest.approx((0.03, 0.3, 90.0))
    assert b.per_max - 2.0 == pytest.approx(0.002) and b.t0_min == -0.1 and b.inc_min == 73.0


def test_text_helpers(spark):
    row = spark.range(1).select(
        scalars.fmt_value(F.lit(1.23456), F.lit(0.1)).alias("a"), scalars.fmt_value(F.lit(None).cast("double")).alias("b"),
        scalars.fmt_value(F.lit(2.0)).alias("c"), scalars.pad_id(F.lit(42)).alias("d"), scalars.strip_spaces(F.lit(" TIC 1 2 ")).alias("e"),
        scalars.is_iso8601(F.lit("2026-01-01T00:00:00Z")).alias("f"), scalars.is_iso8601(F.lit("01.01.2026")).alias("g"),
    ).first()
    assert tuple(row) == ("1.2346 ± 0.1000", "—", "2.0000", "0" * 14 + "42", "TIC12", True, False)


def test_empty_gated_schema(spark):
    empty = spark.createDataFrame([], GATED_SCHEMA)
    assert empty.columns == [
        "tic_id", "sector", "planet_num", "period", "t0", "duration", "depth", "sde", "snr", "cdpp", "chi2", "chi2_red",
        "bls_consistent", "disposition",
    ]
