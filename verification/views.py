"""Stand-ins for survey tables built from the driver tables, in Spark and in SQL.

Every view reads its whole table. ``SQL[name]`` is the text of the common table
expression that defines the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photospark.schema import DAY_US
from verification.registry import table

DIP_PERIOD_US = 3 * DAY_US
DIP_T0_US = 136_080_000_000
DIP_DURATION_US = 12_960_000_000

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

SQL: dict[str, str] = {}


def with_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named views and the ones they use."""
    needed: list[str] = []

    def add(name):
        for other in DEPENDS.get(name, ()):
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in needed) + "\n"


DEPENDS = {"lc_dip": ("lc",), "pred": ("pred_raw",)}


def _events(spark: SparkSession, sf: str, tic) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    start_us = 1_704_067_200_000_000  # 2024-01-01T00:00:00
    time_us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(start_us)
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        tic.cast("bigint").alias("tic_id"),
        F.lit(1).alias("sector"),
        time_us.alias("time_us"),
        (time_us / DAY_US).alias("time"),
        F.when(F.col("event_id") % 97 == 0, F.lit(float("nan")))
        .otherwise(F.lit(1.0) + F.col("value") / 1000.0).alias("flux"),
        F.lit(0.001).alias("flux_err"),
        F.when(k < 10, k).otherwise(F.lit(0)).alias("quality"),
    )


_EVENT_SQL = """
SELECT CAST({tic} AS BIGINT) AS tic_id, CAST(1 AS BIGINT) AS sector,
       epoch_us(ts) - 1704067200000000 AS time_us,
       (epoch_us(ts) - 1704067200000000) / 86400000000.0::DOUBLE AS time,
       CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE
            ELSE 1.0::DOUBLE + value / 1000.0::DOUBLE END AS flux,
       0.001::DOUBLE AS flux_err,
       CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) < 10
            THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) ELSE 0 END AS quality
FROM events"""

SQL["lc"] = _EVENT_SQL.format(
    tic="CASE event_type " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(EVENT_TYPES, 1)) + " ELSE 0 END"
)
SQL["lc_user"] = _EVENT_SQL.format(tic="user_id")
SQL["lc_dip"] = f"""
SELECT tic_id, sector, time_us, time,
       CASE WHEN ((time_us - {DIP_T0_US} + {DIP_DURATION_US // 2}) % {DIP_PERIOD_US} + {DIP_PERIOD_US})
                 % {DIP_PERIOD_US} < {DIP_DURATION_US}
            THEN flux * 0.9::DOUBLE ELSE flux END AS flux,
       flux_err, quality
FROM lc WHERE NOT isnan(flux)"""


def lc(spark, sf):
    """Five long series, one per event type."""
    tic = F.lit(0)
    for i, name in enumerate(EVENT_TYPES, 1):
        tic = F.when(F.col("event_type") == name, i).otherwise(tic)
    return _events(spark, sf, tic)


def lc_user(spark, sf):
    """Many sparse series, one per user."""
    return _events(spark, sf, F.col("user_id"))


def lc_dip(spark, sf):
    """``lc`` with a 10 % dip every three days, without the cadences that have no flux."""
    offset = F.pmod(F.col("time_us") - DIP_T0_US + DIP_DURATION_US // 2, F.lit(DIP_PERIOD_US))
    return lc(spark, sf).filter(~F.isnan("flux")).withColumn(
        "flux", F.when(offset < DIP_DURATION_US, F.col("flux") * 0.9).otherwise(F.col("flux"))
    )


SQL["cand"] = """
SELECT o_custkey AS tic_id, CAST(1 + o_orderkey % 3 AS BIGINT) AS sector,
       CAST(o_orderkey // 3 AS BIGINT) AS planet_num,
       0.5::DOUBLE + (o_orderkey % 2950) / 100.0::DOUBLE AS period,
       (o_orderkey % 100) / 50.0::DOUBLE AS t0,
       0.05::DOUBLE + (o_orderkey % 20) / 100.0::DOUBLE AS duration,
       (o_orderkey % 500) / 100000.0::DOUBLE AS depth,
       o_totalprice / 31250.0::DOUBLE AS sde,
       o_totalprice / 31250.0::DOUBLE * 1.3::DOUBLE AS snr,
       (o_orderkey % 101) / 100.0::DOUBLE AS prob_pc,
       CAST(CASE WHEN o_orderkey % 7 = 6 THEN -1 ELSE o_orderkey % 4 END AS BIGINT) AS predicted_class,
       o_orderstatus AS status
FROM orders"""


def cand(spark, sf):
    """One candidate per order; ``planet_num`` is unique within (tic_id, sector)."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    sde = price / 31250.0
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("tic_id"),
        (F.lit(1) + key % 3).cast("int").alias("sector"),
        F.floor(key / 3).cast("int").alias("planet_num"),
        (F.lit(0.5) + (key % 2950) / 100.0).alias("period"),
        ((key % 100) / 50.0).alias("t0"),
        (F.lit(0.05) + (key % 20) / 100.0).alias("duration"),
        ((key % 500) / 100000.0).alias("depth"),
        sde.alias("sde"),
        (sde * 1.3).alias("snr"),
        ((key % 101) / 100.0).alias("prob_pc"),
        F.when(key % 7 == 6, -1).otherwise(key % 4).cast("int").alias("predicted_class"),
        F.col("o_orderstatus").alias("status"),
    )


SQL["meta"] = """
SELECT c_custkey AS tic_id, CAST(1 + c_nationkey % 3 AS BIGINT) AS sector,
       CASE WHEN c_custkey % 50 <> 0 THEN 4.0::DOUBLE + (c_custkey % 120) / 10.0::DOUBLE END AS tmag,
       CASE WHEN c_custkey % 33 <> 0 THEN 3000.0::DOUBLE + c_acctbal * 0.7::DOUBLE END AS teff,
       CASE WHEN c_custkey % 13 <> 0 THEN (c_custkey % 13) / 10.0::DOUBLE END AS contratio,
       (c_custkey % 3600) / 10.0::DOUBLE AS ra,
       (c_custkey % 1800) / 10.0::DOUBLE - 90.0::DOUBLE AS dec,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'FAILED' ELSE 'SUCCESS' END AS download_status,
       CASE WHEN c_nationkey % 5 = 0 THEN NULL WHEN c_nationkey % 5 = 1 THEN 'SATURATED' ELSE 'NONE' END
         AS exclusion_reason
FROM customer"""


def meta(spark, sf):
    """One star per customer."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("tic_id"),
        (F.lit(1) + F.col("c_nationkey") % 3).cast("int").alias("sector"),
        F.when(key % 50 != 0, F.lit(4.0) + (key % 120) / 10.0).alias("tmag"),
        F.when(key % 33 != 0, F.lit(3000.0) + F.col("c_acctbal") * 0.7).alias("teff"),
        F.when(key % 13 != 0, (key % 13) / 10.0).alias("contratio"),
        ((key % 3600) / 10.0).alias("ra"),
        ((key % 1800) / 10.0 - 90.0).alias("dec"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "FAILED").otherwise("SUCCESS").alias("download_status"),
        F.when(F.col("c_nationkey") % 5 == 0, F.lit(None).cast("string"))
        .when(F.col("c_nationkey") % 5 == 1, "SATURATED").otherwise("NONE").alias("exclusion_reason"),
    )


# Disposition texts assigned to parts in turn.
DISPOSITION_TEXTS = (
    "PC", "KP", "CP", "APC", "EB", "SB", "AFP", "BEB", "NEB", "BTP", "V", "IS", "O", "FA", "FP", "SG",
    "NTP", "UNK", " pc ", "", "planet candidate", "Background Planet", "eclipsing binary",
    "nearby eb", "blended source", "contaminated", "variable star", "instrument noise", "mystery",
)

SQL["disp"] = (
    "SELECT p_partkey AS tic_id, p_partkey AS row_no, "
    f"CASE WHEN p_partkey % 30 = 29 THEN p_type ELSE list_extract([{', '.join(repr(t) for t in DISPOSITION_TEXTS)}], "
    "CAST(p_partkey % 30 + 1 AS BIGINT)) END AS disposition FROM part"
)


def disp(spark, sf):
    """One disposition row per part."""
    texts = F.array(*[F.lit(t) for t in DISPOSITION_TEXTS])
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("tic_id"), key.alias("row_no"),
        F.when(key % 30 == 29, F.col("p_type")).otherwise(F.get(texts, (key % 30).cast("int"))).alias("disposition"),
    )


def _softmax_sql(first):
    terms = [f"exp(embedding[{first + i}]::DOUBLE * 4.0)" for i in range(4)]
    total = " + ".join(terms)
    return "[" + ", ".join(f"({t}) / ({total})" for t in terms) + "]"


SQL["pred_raw"] = f"""
SELECT vec_id, CAST(label % 4 AS BIGINT) AS label, (vec_id % 10) / 10.0::DOUBLE AS crowdsap,
       {_softmax_sql(1)} AS cnn, {_softmax_sql(5)} AS xgb
FROM embeddings"""
SQL["pred"] = """
SELECT vec_id, label, crowdsap, cnn, xgb, cnn AS probs,
       CAST(list_position(cnn, list_max(cnn)) - 1 AS BIGINT) AS pred
FROM pred_raw"""


def pred(spark, sf):
    """Two classifier outputs per embedding; ``probs`` and ``pred`` are those of the first."""
    def softmax(first):
        powers = [F.exp(F.get("embedding", F.lit(first + i)).cast("double") * 4.0) for i in range(4)]
        total = powers[0] + powers[1] + powers[2] + powers[3]
        return F.array(*[p / total for p in powers])

    return table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") % 4).cast("int").alias("label"),
        ((F.col("vec_id") % 10) / 10.0).alias("crowdsap"),
        softmax(0).alias("cnn"), softmax(4).alias("xgb"),
    ).withColumn("probs", F.col("cnn")).withColumn(
        "pred", (F.array_position("probs", F.array_max("probs")) - 1).cast("int")
    )


SQL["pixels"] = """
SELECT l_suppkey AS tic_id, CAST(1 AS BIGINT) AS sector, l_orderkey AS cadence,
       l_orderkey * 172800000 / 86400000000.0::DOUBLE AS time,
       CAST(l_linenumber % 5 AS BIGINT) AS row, CAST(l_partkey % 5 AS BIGINT) AS col, l_quantity AS flux
FROM lineitem"""


def pixels(spark, sf):
    """One pixel reading per line item."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("tic_id"), F.lit(1).alias("sector"), F.col("l_orderkey").alias("cadence"),
        (F.col("l_orderkey") * 172_800_000 / DAY_US).alias("time"),
        (F.col("l_linenumber") % 5).cast("int").alias("row"),
        (F.col("l_partkey") % 5).cast("int").alias("col"), F.col("l_quantity").alias("flux"),
    )


SQL["star_cand"] = """
SELECT s_suppkey AS tic_id, CAST(1 AS BIGINT) AS sector, CAST(1 AS BIGINT) AS planet_num,
       1.0::DOUBLE + s_suppkey % 7 AS period, (s_suppkey % 10) / 10.0::DOUBLE AS t0,
       0.2::DOUBLE + (s_suppkey % 3) / 10.0::DOUBLE AS duration,
       s_acctbal / 1000.0::DOUBLE + 5.0::DOUBLE AS sde, s_nationkey % 4 = 0 AS computed
FROM supplier"""


def star_cand(spark, sf):
    """One candidate per supplier, for the pixel table."""
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.alias("tic_id"), F.lit(1).alias("sector"), F.lit(1).alias("planet_num"),
        (F.lit(1.0) + key % 7).alias("period"), ((key % 10) / 10.0).alias("t0"),
        (F.lit(0.2) + (key % 3) / 10.0).alias("duration"),
        (F.col("s_acctbal") / 1000.0 + 5.0).alias("sde"), (F.col("s_nationkey") % 4 == 0).alias("computed"),
    )


SQL["samples"] = """
SELECT l_suppkey AS tic_id, CAST(l_linenumber AS BIGINT) AS walker, l_orderkey AS step,
       0.05::DOUBLE + l_discount AS rp, least(85.0::DOUBLE + l_quantity / 10.0::DOUBLE, 90.0::DOUBLE) AS inc,
       5.0::DOUBLE + l_quantity / 5.0::DOUBLE AS a, l_tax AS t0, 1.0::DOUBLE + l_tax AS per
FROM lineitem"""


def samples(spark, sf):
    """One posterior sample per line item."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("tic_id"), F.col("l_linenumber").cast("int").alias("walker"),
        F.col("l_orderkey").alias("step"),
        (F.lit(0.05) + F.col("l_discount")).alias("rp"),
        F.least(F.lit(85.0) + F.col("l_quantity") / 10.0, F.lit(90.0)).alias("inc"),
        (F.lit(5.0) + F.col("l_quantity") / 5.0).alias("a"),
        F.col("l_tax").alias("t0"), (F.lit(1.0) + F.col("l_tax")).alias("per"),
    )


SQL["view64"] = "SELECT vec_id, CAST(label % 4 AS BIGINT) AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


def view64(spark, sf):
    """One 64-bin view per embedding."""
    return table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") % 4).cast("int").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("v"),
    )


SQL["logs"] = """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0
         THEN 'best period: ' || CAST((turn * 7 + conv_id) % 40 AS VARCHAR) || '.5 d' || chr(10) || text
         ELSE text END AS text
FROM conversations"""


def logs(spark, sf):
    """Turn texts; every third one starts with a recovery line."""
    number = ((F.col("turn") * 7 + F.col("conv_id")) % 40).cast("string")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.when(
            F.col("turn") % 3 == 0, F.concat(F.lit("best period: "), number, F.lit(".5 d\n"), F.col("text"))
        ).otherwise(F.col("text")).alias("text"),
    )
