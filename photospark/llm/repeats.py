"""Shared steps of the operators that find repeated windows: claims, their resolution, and the spans to remove.

A *claim* stands for a run of windows that start next to each other in one
document: ``anchor`` is a name that each of these windows contains and that any
equal window elsewhere must contain too, ``content`` a hash of all words or
bytes the run covers. It holds its document and ``place``, which packs first
start, run length and weight. Equal claims are combined inside a task (one row
stands for all, the others are marked as repeated at once), so a passage in a
third of all documents sends a row per task and not one per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLAIMS = "anchor bigint, content bigint, doc bigint, place bigint"
#: Claims that a task combines at a time.
COMBINED = 300_000
#: place = first start << 18 | anchor - first start << 10 | (starts - 1) << 2 | weight; weight 0: known as repeated, 1: one, 2: more than one.
SPAN_BITS, WEIGHT_BITS = 8, 2
FIRST_AT = 2 * SPAN_BITS + WEIGHT_BITS
#: Most starts of a run, hence largest width of a window of words.
MOST_STARTS = 1 << SPAN_BITS


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of stretches of a sequence of 64-bit codes, from prefix sums of a polynomial modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        powers = np.full(n + 1, self.BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers[:n], out=self._sums[1:])
        powers.fill(self.INVERSE)
        powers[0] = 1
        self._back = np.cumprod(powers, out=powers)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self._sums[stop] - self._sums[start]) * self._back[start] + (stop - start).astype(np.uint64))

    def all(self, width: int) -> np.ndarray:
        """The hash of each stretch of ``width`` codes."""
        return mix((self._sums[width:] - self._sums[:-width]) * self._back[: len(self._sums) - width] + np.uint64(width))


def place(first: np.ndarray, last: np.ndarray, anchor: np.ndarray | int = 0) -> np.ndarray:
    """Place of the starts first..last, whose anchor begins ``anchor`` after the first."""
    return (first << FIRST_AT) | (anchor << (SPAN_BITS + WEIGHT_BITS)) | ((last - first) << WEIGHT_BITS) | 1


def weight_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << WEIGHT_BITS) - 1))


def unpack(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first starts, last starts) of places."""
    first = places >> FIRST_AT
    return first, first + ((places >> WEIGHT_BITS) & (MOST_STARTS - 1))


def anchor_of(places: np.ndarray) -> np.ndarray:
    return (places >> (SPAN_BITS + WEIGHT_BITS)) & (MOST_STARTS - 1)


def combine(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Claims as Arrow batches; of equal claims within a batch the first in (doc, place) gets weight 2, the others 0."""
    held: list[tuple] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        anchor, content, doc, where = (np.concatenate(c) for c in zip(*held, strict=True))
        both = mix(anchor) ^ content
        order = np.lexsort((where, doc, both))
        same = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        same[1:] = (both[a] == both[b]) & (content[a] == content[b])
        followed = np.append(same[1:], False)
        where[order[same]] -= 1
        where[order[~same & followed]] += 1
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc), pa.array(where)], ["anchor", "content", "doc", "place"])

    for part in parts:
        if len(part[0]):
            held.append(part)
            rows += len(part[0])
        if rows >= COMBINED:
            yield flush()
            held, rows = [], 0
    if held:
        yield flush()


def dealt(claims: DataFrame) -> DataFrame:
    """Claims with ``key``: the anchor, or a key of its own for what is known as repeated (it needs no other row)."""
    known = weight_of(F.col("place")) == 0
    return claims.withColumn("key", F.when(known, F.xxhash64("doc", "place")).otherwise(F.col("anchor")))


def shared(claims: DataFrame) -> DataFrame:
    """Claims whose anchor occurs more than once, with ``mixed``: other content occurs with the anchor too."""
    group = Window.partitionBy("key")
    out = dealt(claims).withColumns({
        "weight": weight_of(F.col("place")),
        "total": F.sum(weight_of(F.col("place"))).over(group),
        "mixed": F.min("content").over(group) < F.max("content").over(group),
    })
    return out.filter((F.col("weight") == 0) | (F.col("total") > 1))


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``doc_id, text`` of all documents with the array of their places (null if none)."""
    listed = places.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("place").alias("places"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(listed, "doc_id", "left")


def place_lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(all places of a batch, number of places per row)."""
    column = batch.column(batch.schema.get_field_index("places"))
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64), counts


def starts_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every start that the places of a batch hold: (row of the batch, start, weight of its place), in order."""
    places, counts = place_lists(batch)
    row = np.repeat(np.arange(batch.num_rows), counts)
    first, last = unpack(places)
    n = last - first + 1
    again = np.repeat(np.arange(len(n)), n)
    start = first[again] + np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
    return row[again], start, places[again] & ((1 << WEIGHT_BITS) - 1)


def covered(first: np.ndarray, last: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``width`` that starts in one of the ranges first..last."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(last + width, n), -1)
    return np.cumsum(edge[:-1]) > 0
