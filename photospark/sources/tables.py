"""Catalogue tables: CSV, parquet and JSON sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photospark.operators.catalogue import tidy_dispositions
from photospark.sources.archive import store_of

TCE_SCHEMA = T.StructType([
    T.StructField("kepid", T.LongType()),
    T.StructField("tce_plnt_num", T.IntegerType()),
    T.StructField("tce_period", T.DoubleType()),
    T.StructField("tce_time0bk", T.DoubleType()),
    T.StructField("tce_duration", T.DoubleType()),
    T.StructField("tce_depth", T.DoubleType()),
    T.StructField("av_training_set", T.StringType()),
])


def ld_table(spark: SparkSession) -> DataFrame:
    """Limb-darkening coefficients, linear in temperature: 36 rows from 3000 K in steps of 200 K."""
    teff = F.lit(3000.0) + F.lit(200.0) * F.col("id")
    share = (teff - 3000.0) / 7000.0
    return spark.range(36).select(
        F.col("id").alias("row_no"), teff.alias("teff"),
        (F.lit(0.45) - F.lit(0.25) * share).alias("u1"), (F.lit(0.25) - F.lit(0.05) * share).alias("u2"),
    )


def read_tce_csv(spark: SparkSession, path: str) -> DataFrame:
    """Threshold-crossing events: seven columns by name, label copied to ``label_class``.

    Durations arrive in hours; ``duration`` is in days.
    """
    raw = spark.read.csv(path, header=True, comment="#")
    typed = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in TCE_SCHEMA.fields])
    return typed.withColumns(
        {"label_class": F.col("av_training_set"), "duration": F.col("tce_duration") / 24.0}
    )


def read_dispositions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Follow-up dispositions with ``#`` comments; rows without a numeric id are dropped.

    ``row_no`` keeps the file order: by path, by block of the file, by line.
    """
    raw = spark.read.csv(path, header=True, comment="#")
    # Spark packs blocks into tasks by size, so only inside a block does the running number follow the lines
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    numbered = raw.select("*", place.alias("row_no"))
    return tidy_dispositions(numbered)


def read_catalogue(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_catalogue(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_results_json(df: DataFrame, path: str) -> None:
    """Every row as a JSON document in a file of its own.

    Spark's writer opens, checksums and commits each file on its own, which costs
    tens of milliseconds a row. A task that runs again writes the same names.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(path)
        store.create_dir(base, recursive=True)
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                hidden = f"{base}/.{uuid.uuid4().hex}.part"
                with store.open_output_stream(hidden) as out:
                    out.write(text.encode())
                store.move(hidden, f"{base}/part-{part:05d}-{n:08d}.json")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    # counting alone would not run the writer for its rows
    df.select(F.to_json(F.struct("*"))).mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def read_results_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Per-star result documents, one or many per folder; absent fields are null."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def append_run_log(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def read_run_log(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read the JSON-lines log; its lines may have different keys."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)
