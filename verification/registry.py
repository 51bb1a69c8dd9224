"""Registry of (query, SQL twin) pairs and small helpers shared by both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB twin, left out where SQL cannot express it."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(value: Column, digits: int = 6) -> Column:
    """Rounded double, NaN as null and no negative zero."""
    value = value.cast("double")
    return F.when(~F.isnan(value), F.round(value, digits) + F.lit(0.0))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column and widen the integers, for comparison with SQL."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = r6(c, digits)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def sql_r6(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"
