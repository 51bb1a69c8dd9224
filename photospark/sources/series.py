"""Light-curve archives and tables."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photospark.schema import META_SCHEMA
from photospark.sources import archive
from photospark.sources.archive import FILE_NAME


def file_key(path: Column) -> list[Column]:
    """(tic_id, sector, kind) from an archive file name."""
    part = lambda i: F.regexp_extract(path, FILE_NAME, i)
    return [
        part(1).try_cast("bigint").alias("tic_id"), part(2).try_cast("int").alias("sector"), part(3).alias("kind"),
    ]


def _files(
    spark: SparkSession, path: str, sectors: Sequence[int] | None = None, kind: str | None = None
) -> DataFrame:
    """Archive files; sectors and kind are part of the name pattern, so other files are never opened."""
    part = "*" if sectors is None else "{" + ",".join(f"{int(s):04d}" for s in sectors) + "}"
    pattern = f"tic*_s{part}_{kind or '*'}.npz"
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def series_keys(
    spark: SparkSession, path: str, sectors: Sequence[int] | None = None, kind: str | None = None
) -> DataFrame:
    """Keys of the archive files of some sectors; the files are listed, not read."""
    listed = _files(spark, path, sectors, kind).select(*file_key(F.col("path")), F.col("path"), F.col("length"))
    return listed.filter("tic_id is not null")


def _selected(spark, path, sectors, kind):
    return _files(spark, path, sectors, kind).select(*file_key(F.col("path")), "content").filter("tic_id is not null")


def read_series_archive(
    spark: SparkSession, path: str, sectors: Sequence[int] | None = None, kind: str | None = None, errors: bool = False
) -> DataFrame:
    """One row per cadence of the archive files.

    Sectors, kind and any later filter on ``tic_id`` or ``sector`` choose files by
    name; the others are never opened. A file that cannot be decoded does not
    stop the read: with ``errors`` the result is the list (tic_id, sector, kind,
    error) of such files instead.
    """
    rows = archive.read_archives(spark, path)
    if sectors is not None:
        rows = rows.filter(F.col("sector").isin([int(s) for s in sectors]))
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    return _told(rows, errors)


def _told(rows: DataFrame, errors: bool) -> DataFrame:
    if errors:
        return rows.filter("error is not null").select("tic_id", "sector", "kind", "error")
    return rows.filter("error is null").drop("error")


def decode_series(files: DataFrame, errors: bool = False) -> DataFrame:
    """Decode archive contents (tic_id, sector, kind, content) into cadences, or list the broken ones."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (
            (tic, sector, name, lambda content=content: content)
            for batch in batches for tic, sector, name, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
        )
        yield from archive.batches(files)

    return _told(files.select("tic_id", "sector", "kind", "content").mapInArrow(decode, archive.ROWS), errors)


def read_series_meta(
    spark: SparkSession, path: str, sectors: Sequence[int] | None = None, kind: str | None = None
) -> DataFrame:
    """Metadata of the archive files: the JSON text and its known fields."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content in batch["content"]:
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as data:
                        text = str(data["meta_json"]) if "meta_json" in data.files else None
                        texts.append(json.dumps(json.loads(text)) if text else None)
                except Exception:
                    texts.append(None)
            yield batch[["tic_id", "sector", "kind"]].assign(meta_json=texts)

    raw = _selected(spark, path, sectors, kind).mapInPandas(decode, "tic_id bigint, sector int, kind string, meta_json string")
    known = [f for f in META_SCHEMA.fields if f.name not in ("tic_id", "sector")]
    # JSON written by NumPy programs may hold NaN, which is not a JSON value
    clean = F.regexp_replace("meta_json", r":\s*(NaN|-?Infinity)", ": null")
    return raw.select(
        "tic_id", "sector", "kind", "meta_json",
        *[F.get_json_object(clean, f"$.{f.name}").try_cast(f.dataType).alias(f.name) for f in known],
    )


def write_series(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write cadences as parquet by sector, files ordered by star and time; extra columns are kept."""
    ordered = df.repartitionByRange("sector", "tic_id", "time_us").sortWithinPartitions("sector", "tic_id", "time_us")
    ordered.write.mode(mode).partitionBy("sector").parquet(path)


def read_series(spark: SparkSession, path: str, sectors: Sequence[int] | None = None) -> DataFrame:
    """Cadences written by ``write_series``; other sectors are never opened."""
    df = spark.read.parquet(path)
    return df if sectors is None else df.filter(F.col("sector").isin(*[int(s) for s in sectors]))
