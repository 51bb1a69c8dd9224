"""Writers of the published products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photospark.operators.publish import candidate_list, catalogue_report, report_text, star_documents


def export_catalogue_csv(catalogue: DataFrame, path: str, files: int | None = None) -> None:
    """The report as CSV, most significant first, doubles with six decimals.

    The sort is distributed: part files follow each other in order. ``files=1``
    gives one file, for catalogues that one task can write.
    """
    allowed = catalogue_report(catalogue)
    ordered = report_text(allowed.orderBy(F.col("sde").desc_nulls_last(), F.col("tic_id")))
    if files is not None:
        ordered = ordered.coalesce(files)
    ordered.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def export_candidates_json(catalogue: DataFrame, path: str) -> None:
    """The candidate list, one JSON object per line."""
    candidate_list(catalogue).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_star_json(
    catalogue: DataFrame, path: str, triceratops: DataFrame | None = None, posterior: DataFrame | None = None, by_star: bool = True
) -> None:
    """Star documents as JSON: a folder per star, or plain part files with ``by_star=False``."""
    docs = star_documents(catalogue, triceratops, posterior)
    if by_star:
        docs = docs.withColumn("star", F.col("tic_id"))
        docs = docs.repartitionByRange("star")
        docs.write.mode("overwrite").option("ignoreNullFields", False).partitionBy("star").json(path)
    else:
        docs.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_payload(documents: DataFrame, path: str) -> None:
    """Payload documents, one JSON object per line."""
    documents.write.mode("overwrite").json(path)


def read_payload(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)

