"""Ordered running totals without a single-task window.

A window ordered over a whole group sorts that group in one task. Here each
group is cut into ordered cells. The running total of a row is the total of the
earlier cells (a window over one row per cell) plus the running total inside its
own cell, so the largest sort is one cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photospark.plans.lineage import pin

#: Rows that one cell, and so one sort, should hold at most.
CELL_ROWS = 2_000_000


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    cell: Column,
    order: Sequence[Column],
    values: dict[str, Column],
) -> DataFrame:
    """Add, per entry of ``values``, its sum over the rows before this one in ``order``.

    ``cell`` is an integer that never decreases along ``order`` inside a group.
    """
    keys = list(keys)
    with_cell = df.withColumn("_cell", cell)
    totals = with_cell.groupBy(*keys, "_cell").agg(
        *[F.sum(v).alias(f"_t_{n}") for n, v in values.items()]
    )
    before_cell = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_cell",
        *[F.coalesce(F.sum(f"_t_{n}").over(before_cell), F.lit(0)).alias(f"_o_{n}") for n in values],
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = with_cell.withColumns(
        {f"_l_{n}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()}
    )
    joined = local.join(offsets, [*keys, "_cell"])
    names = list(values)
    return joined.withColumns({n: F.col(f"_o_{n}") + F.col(f"_l_{n}") for n in names}).drop(
        "_cell", *[f"_o_{n}" for n in names], *[f"_l_{n}" for n in names]
    )


def ordinal(
    df: DataFrame, keys: Sequence[str], cell: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """Add the 1-based position of each row in its group, as ``row_number`` would."""
    numbered = prefix_sum(df, keys, cell, order, {name: F.lit(1).cast("bigint")})
    return numbered.withColumn(name, F.col(name) + 1)


def range_cells(df: DataFrame, order: Sequence[Column], name: str, cells: int | None = None) -> DataFrame:
    """Add an integer cell that follows ``order``, balanced by Spark's range partitioning.

    There are enough cells for one task to hold each. The result is pinned
    because the sampled range bounds must not change between the branches that
    use the cell.
    """
    if cells is None:
        df = pin(df)
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cells = max(partitions, -(-df.count() // CELL_ROWS))
    return pin(df.repartitionByRange(cells, *order).withColumn(name, F.spark_partition_id()))
