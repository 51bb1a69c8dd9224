"""Round trips through the sources and sinks: whole tables are written, read back and compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photospark.functions.scalars import clean_num
from photospark.plans.groups import spread, whole_groups
from photospark.plans.lineage import scratch_path
from photospark.schema import TRICERATOPS_SCHEMA
from photospark.sources import publish as sink
from photospark.sources import archive, series, tables
from verification import views
from verification.catalogue_queries import CK
from verification.registry import query, rounded, sql_r6, table
from verification.rule_queries import _DISP_SQL
from verification.views import with_views


def _pack(blocks: DataFrame) -> DataFrame:
    """The cadences of every (tic_id, block) as an archive."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta = np.array("{}")
        for rows, bounds in whole_groups(batches, ["tic_id", "block"]):
            columns = {name: rows.column(name).to_numpy() for name in ("time", "flux", "flux_err")} | {"quality": rows.column("quality").to_numpy().astype(np.int32)}
            for some in np.array_split(np.arange(len(bounds) - 1), max(1, len(bounds) // 2_000)):
                files = [archive.encode(**{n: c[bounds[i]:bounds[i + 1]] for n, c in columns.items()}, meta_json=meta) for i in some]
                first = rows.select(["tic_id", "block"]).take(bounds[some])
                yield pa.RecordBatch.from_arrays([
                    first.column(0).combine_chunks(), first.column(1).combine_chunks(), pa.array(["raw"] * len(files)), pa.array(files, pa.binary()),
                ], ["tic_id", "sector", "kind", "content"])

    placed = spread(blocks, ["tic_id", "block"]).sortWithinPartitions("tic_id", "block")
    return placed.select("tic_id", "block", "time", "flux", "flux_err", "quality").mapInArrow(pack, "tic_id bigint, sector int, kind string, content binary")


@query(
    "io1_decode_series",
    with_views("lc_user") + f"SELECT tic_id, CAST(time_us // 86400000000 AS BIGINT) AS sector, count(*) AS n, {sql_r6('sum(CASE WHEN isnan(flux) THEN 0 ELSE flux END)')} AS total, "
    "CAST(sum(quality) AS BIGINT) AS quality, CAST(sum(time_us) AS BIGINT) AS time_us FROM lc_user GROUP BY ALL",
)
def _(spark, sf):
    blocks = views.lc_user(spark, sf).withColumn("block", F.floor(F.col("time")).cast("int"))
    files = _pack(blocks)
    rows = series.decode_series(files)
    return rounded(rows.groupBy("tic_id", "sector").agg(
        F.count(F.lit(1)).alias("n"), F.sum(clean_num(F.col("flux"))).alias("total"),
        F.sum("quality").alias("quality"), F.sum("time_us").alias("time_us"),
    ))


def _archives(spark, sf):
    """Archives of every star and third of a month of ``lc_user`` in the shared folder; those of some stars are cut off."""
    path = scratch_path(spark, "archives")
    blocks = views.lc_user(spark, sf).withColumn("block", F.floor(F.col("time") / 10).cast("int"))
    files = _pack(blocks)
    cut = F.when(F.col("tic_id") % 10 == 3, F.expr("substring(content, 1, 100)")).otherwise(F.col("content"))
    archive.write_archives(files.withColumn("content", cut), path)
    return path


_FILES_SQL = with_views("lc_user") + "SELECT tic_id, CAST(time_us // 864000000000 AS BIGINT) AS sector"


@query(
    "io1_read_series_archive",
    _FILES_SQL + f", count(*) AS n, {sql_r6('sum(CASE WHEN isnan(flux) THEN 0 ELSE flux END)')} AS total, "
    "CAST(sum(quality) AS BIGINT) AS quality, CAST(sum(time_us) AS BIGINT) AS time_us FROM lc_user WHERE tic_id % 10 <> 3 GROUP BY ALL",
)
def _(spark, sf):
    rows = series.read_series_archive(spark, _archives(spark, sf), kind="raw")
    return rounded(rows.groupBy("tic_id", "sector").agg(
        F.count(F.lit(1)).alias("n"), F.sum(clean_num(F.col("flux"))).alias("total"),
        F.sum("quality").alias("quality"), F.sum("time_us").alias("time_us"),
    ))


@query(
    "io1_archive_errors",
    _FILES_SQL + ", 'raw' AS kind, TRUE AS told FROM lc_user WHERE tic_id % 10 = 3 AND time_us // 864000000000 IN (0, 2) GROUP BY ALL",
)
def _(spark, sf):
    bad = series.read_series_archive(spark, _archives(spark, sf), sectors=[0, 2], errors=True)
    return rounded(bad.select("tic_id", "sector", "kind", (F.length("error") > 0).alias("told")))


@query("io3_series_keys_listed", _FILES_SQL + ", 'raw' AS kind FROM lc_user WHERE time_us // 864000000000 IN (0, 2) GROUP BY ALL")
def _(spark, sf):
    listed = series.series_keys(spark, _archives(spark, sf), sectors=[0, 2])
    return rounded(listed.select("tic_id", "sector", "kind"))


@query("io2_write_series", with_views("lc") + "SELECT tic_id, time_us, CAST(1 AS BIGINT) AS sector, flux_err FROM lc")
def _(spark, sf):
    path = scratch_path(spark, "series")
    series.write_series(views.lc(spark, sf), path)
    return rounded(series.read_series(spark, path, [1]).select("tic_id", "time_us", "sector", "flux_err"))


@query(
    "io3_series_keys",
    "SELECT o_custkey AS tic_id, CAST(1 + o_orderkey % 3 AS BIGINT) AS sector, 'raw' AS kind FROM orders WHERE o_orderkey % 3 IN (0, 2)",
)
def _(spark, sf):
    name = F.format_string("tic%016d_s%04d_raw.npz", F.col("o_custkey"), F.lit(1) + F.col("o_orderkey") % 3)
    listed = table(spark, sf, "orders").select(*series.file_key(name))
    return rounded(listed.filter(F.col("sector").isin(1, 3)))


@query(
    "io4_read_tce_csv",
    f"SELECT o_orderkey AS kepid, {sql_r6('o_totalprice / 24.0')} AS duration, o_orderpriority AS label_class FROM orders",
)
def _(spark, sf):
    path = scratch_path(spark, "tce")
    key = F.col("o_orderkey")
    table(spark, sf, "orders").select(
        key.alias("kepid"), F.lit(1).alias("tce_plnt_num"), (key / 7.0).alias("tce_period"), (key / 3.0).alias("tce_time0bk"),
        F.col("o_totalprice").alias("tce_duration"), F.lit(10.0).alias("tce_depth"), F.col("o_orderpriority").alias("av_training_set"),
        F.lit("unused").alias("extra"),
    ).write.option("header", True).csv(path)
    return rounded(tables.read_tce_csv(spark, path).select("kepid", "duration", "label_class"))


@query("io5_read_dispositions_csv", "SELECT p_partkey AS tic_id, p_type AS disposition FROM part WHERE p_size <> 7")
def _(spark, sf):
    path = scratch_path(spark, "dispositions")
    part = table(spark, sf, "part")
    text = F.when(F.col("p_size") == 7, "none").otherwise(F.col("p_partkey").cast("string"))
    part.select(text.alias("TIC ID"), F.col("p_type").alias("TFOPWG Disposition")).write.option("header", True).csv(path)
    return tables.read_dispositions_csv(spark, path).select("tic_id", "disposition")


@query("io6_catalogue", with_views("cand") + f"SELECT {CK}, {sql_r6('sde')} AS s FROM cand WHERE sde >= 5")
def _(spark, sf):
    path = scratch_path(spark, "catalogue")
    tables.write_catalogue(views.cand(spark, sf), path)
    read = tables.read_catalogue(spark, path, ["tic_id", "sector", "planet_num", "sde"])
    return rounded(read.filter("sde >= 5").withColumnRenamed("sde", "s"))


@query(
    "io7_ld_table",
    with_views("meta") + f", c AS (SELECT CAST(floor((teff - 3000) / 200) AS BIGINT) AS i, count(*) AS stars FROM meta WHERE teff BETWEEN 3000 AND 10000 GROUP BY ALL) "
    f"SELECT i AS row_no, {sql_r6('3000.0::DOUBLE + 200 * i')} AS teff, {sql_r6('0.45::DOUBLE - 0.25::DOUBLE * (200 * i / 7000.0::DOUBLE)', 9)} AS u1, "
    f"{sql_r6('0.25::DOUBLE - 0.05::DOUBLE * (200 * i / 7000.0::DOUBLE)', 9)} AS u2, stars FROM c",
)
def _(spark, sf):
    cell = F.floor((F.col("teff") - 3000) / 200).alias("row_no")
    stars = views.meta(spark, sf).filter("teff between 3000 and 10000").groupBy(cell).agg(F.count(F.lit(1)).alias("stars"))
    return rounded(tables.ld_table(spark).join(stars, "row_no").select("row_no", "teff", "u1", "u2", "stars"), 9)


@query("io8_read_results_json", f"SELECT s_suppkey AS tic_id, {sql_r6('s_acctbal / 10000')} AS fpp, NULL::DOUBLE AS nfpp, s_name AS status FROM supplier")
def _(spark, sf):
    path = scratch_path(spark, "results")
    results = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("tic_id"), (F.col("s_acctbal") / 10000).alias("fpp"), F.col("s_name").alias("status"), F.lit(1).alias("other")
    )
    tables.write_results_json(results.repartition(F.col("tic_id")), path)
    read = tables.read_results_json(spark, path, TRICERATOPS_SCHEMA)
    return rounded(read.select("tic_id", "fpp", "nfpp", "status"))


@query("io9_run_log", "SELECT n_name AS step, CAST(n_nationkey AS BIGINT) AS n, NULL AS runtime FROM nation UNION ALL SELECT s_name, NULL, CAST(round(s_acctbal, 2) AS DOUBLE) FROM supplier")
def _(spark, sf):
    path = scratch_path(spark, "log")
    tables.append_run_log(table(spark, sf, "nation").select(F.col("n_name").alias("step"), F.col("n_nationkey").alias("n")), path)
    tables.append_run_log(table(spark, sf, "supplier").select(F.col("s_name").alias("step"), F.col("s_acctbal").alias("runtime")), path)
    schema = T.StructType([T.StructField("step", T.StringType()), T.StructField("n", T.LongType()), T.StructField("runtime", T.DoubleType())])
    return tables.read_run_log(spark, path, schema)


@query(
    "io10_export_catalogue_csv",
    with_views("cand") + f"SELECT CAST(tic_id AS VARCHAR) AS tic_id, printf('%.6f', sde) AS sde, {_DISP_SQL} AS disposition, NULL::VARCHAR AS rp_rs FROM cand",
)
def _(spark, sf):
    path = scratch_path(spark, "csv")
    sink.export_catalogue_csv(views.cand(spark, sf), path)
    return spark.read.csv(path, header=True).select("tic_id", "sde", "disposition", "rp_rs")


@query(
    "io11_export_candidates_json",
    with_views("cand") + f"SELECT CAST(tic_id AS VARCHAR) AS tic_id, {sql_r6('nullif(depth, 0)')} AS depth, {_DISP_SQL} AS disposition FROM cand",
)
def _(spark, sf):
    path = scratch_path(spark, "json")
    sink.export_candidates_json(views.cand(spark, sf), path)
    schema = T.StructType([T.StructField("tic_id", T.StringType()), T.StructField("depth", T.DoubleType()), T.StructField("disposition", T.StringType())])
    return rounded(spark.read.schema(schema).json(path))


@query("io12_export_star_json", with_views("cand") + "SELECT CAST(tic_id AS VARCHAR) AS tic_id, '/plots/' || tic_id || '/softmax.html' AS softmax, FALSE AS mcmc_available FROM cand WHERE sde >= 7")
def _(spark, sf):
    path = scratch_path(spark, "stars")
    sink.export_star_json(views.cand(spark, sf), path, by_star=False)
    read = spark.read.schema("tic_id string, plots struct<softmax:string>, mcmc_available boolean").json(path)
    return read.select("tic_id", F.col("plots.softmax").alias("softmax"), "mcmc_available")
