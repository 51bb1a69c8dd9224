"""Best-fit packing after Martello-Toth reduction.

Piece lengths are integers up to the capacity, so the whole instance is a
histogram of at most ``capacity`` counts: bounded whatever the corpus. The
driver reduces it (fix sets that dominate every other filling of their bin),
packs the rest best-fit decreasing, and gets a plan of patterns with
multiplicities. Spark ranks the pieces of each length and looks up the slot of
each rank. No piece passes through the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photospark.llm.bytebpe import END, pieces
from photospark.llm.scratch import keep

CAPACITY = 1024
VOCABULARY = "byte_bpe_50k.json"
#: Parts into which the pieces of one length are dealt for ranking.
PARTS = 256

Pattern = tuple[int, ...]


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixed bins (pattern, how often) and what is left.

    From the longest piece j down, a set is fixed if it dominates all feasible
    sets with j: j alone if nothing fits beside it; j with the one piece that
    fills the bin; j with its best partner if only one more fits, or if two
    more fit at most and the partner is at least as long as any such two.
    """
    left = {s: n for s, n in sorted(counts.items()) if n > 0}
    sizes = sorted(left)
    fixed: list[tuple[Pattern, int]] = []

    def take(*pattern: int) -> None:
        need = Counter(pattern)
        times = min(left[s] // k for s, k in need.items())
        fixed.append((pattern, times))
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
                sizes.pop(bisect_left(sizes, s))

    def shortest(own: int) -> list[int]:
        """The three shortest pieces beside one piece of length ``own``."""
        out: list[int] = []
        for s in sizes[:4]:
            out += [s] * min(3, left[s] - (s == own))
            if len(out) >= 3:
                break
        return out[:3]

    at = capacity
    while sizes and (up := bisect_right(sizes, at)):
        j = sizes[up - 1]
        room = capacity - j
        few = shortest(j)
        k = sizes[up - 1] if (up := bisect_right(sizes, room)) else 0
        if k == j and left[j] == 1:
            k = sizes[up - 2] if up > 1 else 0
        if not few or few[0] > room:
            take(j)
        elif k == room or len(few) < 2 or few[0] + few[1] > room:
            take(j, k)
        elif (len(few) < 3 or sum(few) > room) and k >= _best_pair(sizes, left, j, room):
            take(j, k)
        else:
            at = j - 1
    return fixed, left


def _best_pair(sizes: list[int], left: dict[int, int], own: int, room: int) -> int:
    """Largest sum up to ``room`` of two pieces beside one of length ``own``."""
    best, low, high = 0, 0, bisect_right(sizes, room) - 1
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room or low == high and left[sizes[low]] - (sizes[low] == own) < 2:
            high -= 1
            continue
        best = max(best, total)
        low += 1
    return best


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: bins of the same filling are handled together."""
    rooms: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    keys: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in rooms or not rooms[room]:
            i = bisect_left(keys, room)
            if i == len(keys) or keys[i] != room:
                keys.insert(i, room)
        rooms[room].append((pattern, times))

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            i = bisect_left(keys, s)
            if i < len(keys):
                room = keys[i]
                pattern, times = rooms[room].pop()
                if not rooms[room]:
                    keys.pop(i)
            else:
                room, pattern, times = capacity, (), n
            each = room // s
            used = min(times, n // each)
            if used:
                put(room - each * s, pattern + (s,) * each, used)
                n -= used * each
            if n and used < times:
                put(room - n * s, pattern + (s,) * n, 1)
                n, used = 0, used + 1
            if pattern and times > used:
                put(room, pattern, times - used)
    return [bin_ for room in keys for bin_ in rooms[room]]


def slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The plan as (length, first rank, number of ranks, first sequence, offset)."""
    fixed, left = reduce_instance(counts, capacity)
    out, ranks, sequence = [], Counter(), 0
    for pattern, times in fixed + best_fit(left, capacity):
        offset = 0
        for s in pattern:
            out.append((s, ranks[s], times, sequence, offset))
            ranks[s] += times
            offset += s
        sequence += times
    return out


def document_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32. One pass, no shuffle."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, piece, start, length, ids, at in pieces(batches, vocabulary, capacity, end):
            view = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(at))
            yield pa.RecordBatch.from_arrays(
                [doc_id.cast(pa.int64()), *(pa.array(c.astype(np.int64)) for c in (piece, start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset`` there.

    Null texts are empty documents (one piece, the end id). Repeated rows are
    packed each. The histogram that goes to the driver has at most
    ``capacity`` rows; an empty table gives an empty result. Runs two jobs
    while it is built: the pieces are written once, then counted.
    """
    spark = docs.sparkSession
    rows = keep(document_pieces(docs, capacity, vocabulary, end), "pieces")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)))
    counts = keep(rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    plan = slots({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = rows.withColumn("_own", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")))
    ranked = ranked.join(counts.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before")), ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    table = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "s bigint, lo bigint, n bigint, sequence bigint, offset bigint")
    hit = (F.col("length") == F.col("s")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("lo") + F.col("n"))
    # the plan is bounded by the capacity, not by the corpus
    return ranked.join(F.broadcast(table), hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.col("_rank") - F.col("lo")).alias("sequence_id"), F.col("offset"))
