"""Session settings that the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins by measured size and splits skewed partitions,
#: also where that costs a shuffle before a following aggregation.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings to a session builder; set ``spark.checkpoint.dir`` to shared storage on a cluster."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
