"""Per-group order statistics that hold for groups of any size.

Spark's exact ``percentile`` keeps all distinct values of a group in one task.
That is right for a light curve of normal length and wrong for a group that
holds a large part of the table. The functions here count the groups first
(one map-side combined aggregation). Groups up to ``max_rows`` use the built-in
aggregate or window; for larger ones the rows in cells of the value range are
counted, then those in cells of the cell that holds the wanted rank, until a
single value is left; each pass is a partial aggregation. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photospark.plans.lineage import pin

#: Rows of one group that one task may hold.
MAX_GROUP_ROWS = 2_000_000
#: Rows of a counted table that may be broadcast.
BROADCAST_ROWS = 200_000

#: Cells that a range of values is cut into by a pass.
_CELLS = 1 << 16


def row_limit(df: DataFrame, keys: Sequence[str], max_rows: int | None = MAX_GROUP_ROWS) -> int | None:
    """``max_rows`` if some group of ``df`` is larger, else ``None``.

    Operators that only drop rows or split groups further cannot make a group
    larger, so one count at the source serves a whole chain: ``None`` tells the
    functions below that no group needs the way for large ones.
    """
    if max_rows is None:
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return max_rows if (counts.agg(F.max("_rows")).first()[0] or 0) > max_rows else None


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` pinned and counted, hinted for broadcast only if it has at most ``max_rows`` rows.

    Beyond that Spark chooses the join, with skew handling by adaptive execution.
    """
    pinned = pin(df)
    return F.broadcast(pinned) if pinned.count() <= max_rows else pinned


def spread(df: DataFrame, keys: Sequence[str], n_groups: int | None = None) -> DataFrame:
    """Hash ``df`` by ``keys`` into enough partitions for a kernel that costs time rather than bytes.

    Adaptive execution merges small partitions by their bytes, which would run
    costly groups one after the other; a given number of partitions is kept.
    About eight groups per task if there are many, many partitions per group
    (so that few share one) if there are few.
    """
    spark = df.sparkSession
    n = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if n_groups is not None:
        n = max(1, min(16 * n_groups, max(n, min(n_groups // 8, 50_000))))
    return df.repartition(n, *keys)


def group_starts(rows: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows at which a new group starts, for rows sorted by whole-number keys; nulls are a group."""
    new = np.arange(rows.num_rows) == 0
    for key in keys:
        column = rows.column(key)
        null, value = (np.asarray(c) for c in (column.is_null(), column.fill_null(0)))
        new[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of a partition sorted by ``keys`` as (rows of whole groups, bounds of the groups)."""
    def told(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held)
        return rows, np.append(group_starts(rows, keys), rows.num_rows)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and len(group_starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), keys)) > 1:
            yield told(held)
            held = []
        last = int(group_starts(batch, keys)[-1])
        if last:
            yield told([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield told(held)


class Split(NamedTuple):
    """Rows of normal groups, rows of large ones and the keys of the large ones (``None`` if there are none)."""

    small: DataFrame
    large: DataFrame | None
    keys: DataFrame | None


def split_by_size(df: DataFrame, keys: Sequence[str], max_rows: int | None = MAX_GROUP_ROWS) -> Split:
    """Split ``df`` by the size of its groups at ``max_rows``.

    There are at most ``rows / max_rows`` large groups; their key table is
    counted before it is broadcast.
    """
    if max_rows is None:
        return Split(df, None, None)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > max_rows)
    if large.isEmpty():
        return Split(df, None, None)
    large = small_side(large.select(*keys))
    return Split(df.join(large, list(keys), "left_anti"), df.join(large, list(keys), "left_semi"), large)


def join_to_groups(
    few: DataFrame, many: DataFrame, keys: Sequence[str], max_rows: int | None = MAX_GROUP_ROWS
) -> tuple[DataFrame, int | None]:
    """Inner join of ``few`` (candidates) to ``many`` (their series) that no long series can gather.

    Long series are joined apart: the candidates that belong to them are
    counted and broadcast, so the rows of the series stay where they are. Also
    returns ``max_rows`` if there are long series, else ``None``.
    """
    small, large, large_keys = split_by_size(many, keys, max_rows)
    out = few.join(small, list(keys))
    if large is None:
        return out, None
    theirs = small_side(few.join(large_keys, list(keys), "left_semi"))
    return out.unionByName(theirs.join(large, list(keys)).select(*out.columns)), max_rows


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: dict[str, tuple[Column, float]],
    max_rows: int | None = MAX_GROUP_ROWS,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact quantiles per group, linearly interpolated, one output column per entry of ``values``.

    ``values`` maps an output name to (expression, fraction); null values are
    ignored. ``extra`` holds other aggregates (counts, deviations) that come
    from the same pass.
    """
    keys = list(keys)
    others = [column.alias(name) for name, column in (extra or {}).items()]
    small, large, _ = split_by_size(df, keys, max_rows)
    # one percentile aggregate, hence one map of values, per expression: fractions of the same Column object share it
    shared: dict[int, tuple[Column, list[tuple[str, float]]]] = {}
    for name, (value, frac) in values.items():
        shared.setdefault(id(value), (value, []))[1].append((name, frac))
    grouped = small.groupBy(*keys).agg(
        *[F.percentile(value, F.array(*[F.lit(float(f)) for _, f in wanted])).alias(f"_q{k}") for k, (value, wanted) in enumerate(shared.values())], *others
    )
    lists = {name: F.get(f"_q{k}", F.lit(i)).alias(name) for k, (_, wanted) in enumerate(shared.values()) for i, (name, _) in enumerate(wanted)}
    out = grouped.select(*keys, *[lists[name] for name in values], *(extra or {}))
    if large is None:
        return out
    return out.unionByName(large_quantiles(large, keys, values, extra))


def large_quantiles(df: DataFrame, keys: Sequence[str], values: dict[str, tuple[Column, float]], extra: dict[str, Column] | None = None) -> DataFrame:
    """``group_quantiles`` of groups that are known to be large: the values are kept and counted in passes."""
    keys = list(keys)
    others = [column.alias(name) for name, column in (extra or {}).items()]
    parts = df.groupBy(*keys).agg(*others) if others else df.select(*keys).distinct()
    for name, (value, frac) in values.items():
        parts = parts.join(_celled_quantile(df, keys, value, frac, name), keys, "left")
    return parts.select(*keys, *values, *(extra or {}))


def with_group_median(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column], max_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """Add the exact median of each expression over its group as a column."""
    small, large, _ = split_by_size(df, keys, max_rows)
    window = Window.partitionBy(*keys)
    out = small.withColumns({name: F.median(value).over(window) for name, value in values.items()})
    if large is None:
        return out
    medians = large_quantiles(large, keys, {n: (v, 0.5) for n, v in values.items()})
    return out.unionByName(large.join(small_side(medians), list(keys), "left"))


def _cell(v: Column, low: Column, high: Column) -> Column:
    """Cell of a value between ``low`` and ``high``, rising with the value; the two ends never share one.

    Equal steps, equal ratios where the values span more than a factor of two,
    the sign where both signs occur. Values that are not finite have cells of their own.
    """
    share = lambda part, whole: F.floor(part / whole * _CELLS)
    inner = (
        F.when((low < 0) & (high > 0), F.signum(v).cast("bigint"))
        .when((low > 0) & (high / 2 > low), share(F.log(v) - F.log(low), F.log(high) - F.log(low)))
        .when((high < 0) & (low / 2 < high), share(F.log(-low) - F.log(-v), F.log(-low) - F.log(-high)))
        .when(high > low, share(v - low, high - low))
        .otherwise(F.lit(0).cast("bigint"))
    )
    return (
        F.when(F.isnan(v), F.lit(2 * _CELLS)).when(v == float("inf"), F.lit(2 * _CELLS - 1)).when(v == float("-inf"), F.lit(-_CELLS))
        .otherwise(inner).cast("bigint")
    )


def _celled_quantile(df, keys, value, frac, name):
    """One exact quantile per group by counting the cells of a value range, then those of the cell that holds the wanted rank.

    A pass shuffles at most ``_CELLS`` counts per group and task. Every pass
    cuts the range by that factor, so that a few passes reach a single value
    however often values repeat.
    """
    keys = list(keys)
    rows = df.select(*keys, (value.cast("double") + F.lit(0.0)).alias("_v")).filter(F.col("_v").isNotNull()).persist()
    v = F.col("_v")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    found = pin(
        rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
        .withColumns({"_below": F.lit(0).cast("bigint"), "_whole": F.lit(True), "_done": F.lit(False), "_next": F.lit(None).cast("double")})
    )
    position = (F.col("_n") - 1) * F.lit(float(frac))
    weight = position - F.floor(position)
    running = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_cell"))
    holds = lambda rank: (rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end"))
    low, high = holds(F.floor(position)), holds(F.ceil(position))
    done = found.filter("_done")
    while n_open := (work := found.filter(~F.col("_done")).select(*keys, "_n", "_below", "_lo", "_hi", "_whole")).count():
        cells = (
            rows.join(F.broadcast(work) if n_open <= BROADCAST_ROWS else work, keys)
            .filter(F.col("_whole") | v.between(F.col("_lo"), F.col("_hi")))
            .groupBy(*keys, "_n", "_below", _cell(v, F.col("_lo"), F.col("_hi")).alias("_cell"))
            .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
            .withColumn("_end", F.col("_below") + running)
        )
        # ranks in two cells are the last value of the one and the first of the other
        found = pin(
            cells.filter(low | high).groupBy(*keys, "_n").agg(
                F.max(F.when(low, F.col("_end") - F.col("_c"))).alias("_below"), F.max(F.when(low, F.col("_min"))).alias("_lo"),
                F.max(F.when(low, F.col("_max"))).alias("_hi"), F.max(F.when(high, F.col("_min"))).alias("_next"), F.count(F.lit(1)).alias("_held"),
            ).withColumns({"_whole": F.lit(False), "_done": (F.col("_held") > 1) | (F.col("_lo") == F.col("_hi"))}).drop("_held")
        )
        done = done.unionByName(found.filter("_done"))
    rows.unpersist()
    between = F.col("_hi") * (F.lit(1.0) - weight) + F.col("_next") * weight
    # an infinite value times a weight of 0 is no number
    return done.select(*keys, F.when(F.col("_hi") == F.col("_next"), F.col("_hi")).otherwise(between).alias(name))
