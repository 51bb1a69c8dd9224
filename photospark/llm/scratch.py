"""Tables between two steps, written to the folder all executors share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.plans.lineage import scratch_path

#: Rows of a counted table that may be broadcast; its rows are a few numbers wide.
BROADCAST_ROWS = 50_000


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: computed once, no lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_by(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """``keep`` as a table bucketed by ``columns``: later grouping and cogrouping by them moves none of its rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, *columns).option("path", path).saveAsTable(table)
    return spark.table(table)


def small(df: DataFrame) -> DataFrame:
    """``df`` hinted for broadcast if it has at most ``BROADCAST_ROWS`` rows; beyond, Spark chooses the join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as the struct ``row``, with a ``doc_id`` that is unique to each row (its place in the files it is read from) in place of its own.

    ``text``, ``lang`` and ``source`` stay columns where there are such. What is
    not a plain Parquet table is written to the shared folder first.
    """
    def placed(rows: DataFrame) -> DataFrame:
        own = [c for c in ("text", "lang", "source") if c in rows.columns]
        return rows.select(
            F.struct(*[rows[c] for c in rows.columns]).alias("row"), *own, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))

    # above other plans (a join, an explode) two rows can have the same place
    plain = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"
    try:
        rows = placed(docs if plain else keep(docs, "rows"))
    except AnalysisException:
        rows = placed(keep(docs, "rows"))
    names = sorted(r["file"] for r in rows.select("file").distinct().collect())
    files = docs.sparkSession.createDataFrame([(name, i) for i, name in enumerate(names)], "file string, number bigint")
    rows = rows.join(small(files), "file")
    return rows.withColumn("doc_id", F.shiftleft("number", 40) + F.col("place")).drop("file", "number", "place")
