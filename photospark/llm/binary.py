"""Packed token ids as binary rows, ready for training.

Each task encodes its documents, splits long ones without loss, and packs a
bounded buffer of pieces best-fit decreasing; the open bin with the least
sufficient room is found by descending a segment tree over the rooms. A row of
the output is one sequence: its ids as a little-endian matrix row padded to the
capacity, the cumulative segment lengths, where positions start anew, and which
document and piece each segment is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.llm.bestfit import CAPACITY, VOCABULARY
from photospark.llm.bytebpe import END, pieces

#: Ids that a task packs at a time. More gives fuller sequences and takes more memory (8 bytes an id).
BUFFER_IDS = 3 << 20
#: Id in the places that no segment fills.
PAD = 0
SCHEMA = (
    "sequence_id bigint, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "segment_docs array<bigint>, segment_pieces array<int>"
)


class Rooms:
    """Segment tree over 0..capacity that counts open bins by the room they have left."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        node = room + self.width
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, bin) with the smallest room of at least ``least``, removed from the tree; ``None`` if there is none."""
        node = least + self.width
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.width
        bin_ = self.bins[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, bin_


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in ``lengths``, longest first, each where the least sufficient room is left."""
    rooms, bins = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        room, bin_ = found if found else (capacity, len(bins))
        if not found:
            bins.append([])
        bins[bin_].append(i)
        rooms.add(room - lengths[i], bin_)
    return bins


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end: int = END, dtype: str = "<u2") -> DataFrame:
    """One row per packed sequence (``SCHEMA``).

    An id that ``dtype`` does not hold ends the job with an error. Null texts are empty
    documents of the end id alone. A sequence is packed from the documents of
    one task; only the last sequences of a buffer stay partly empty. No shuffle.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)

    def flush(held: list[tuple], first: int) -> pa.RecordBatch:
        docs, *arrays = zip(*held, strict=True)
        doc = pa.concat_arrays([d.cast(pa.int64()) for d in docs])
        piece, length, ids, at = map(np.concatenate, arrays)
        if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
            raise ValueError(f"id {ids.max()} does not fit into {dtype}; name a wider dtype")
        bins = best_fit_decreasing(length.tolist(), capacity)
        matrix = np.full((len(bins), capacity), PAD, dtype)
        cuts = []
        for row, members in zip(matrix, bins, strict=True):
            here = [0]
            for i in members:
                row[here[-1] : here[-1] + length[i]] = ids[at[i] : at[i] + length[i]]
                here.append(here[-1] + int(length[i]))
            cuts.append(here)
        segments = np.array([i for b in bins for i in b], np.int64)
        ends = pa.array(np.cumsum([0, *map(len, bins)]), pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.array(first + np.arange(len(bins))), pa.array([c[-1] for c in cuts], pa.int32()), pa.array([row.tobytes() for row in matrix], pa.binary()),
            pa.array(cuts, pa.list_(pa.int32())), pa.array([c[:-1] for c in cuts], pa.list_(pa.int32())),
            pa.ListArray.from_arrays(ends, doc.take(pa.array(segments))), pa.ListArray.from_arrays(ends, pa.array(piece[segments].astype(np.int32))),
        ], ["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "segment_docs", "segment_pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        total = 0
        for doc_id, piece, _, length, ids, at in pieces(batches, vocabulary, capacity, end):
            held.append((doc_id, piece, length, ids, at + total))
            total += len(ids)
            if total >= BUFFER_IDS:
                yield (out := flush(held, sequence))
                sequence += out.num_rows
                held, total = [], 0
        if held:
            yield flush(held, sequence)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write_packed(docs: DataFrame, path: str, **options) -> DataFrame:
    """``packed`` written as Parquet files under ``path`` and read back."""
    packed(docs, **options).write.parquet(path)
    return docs.sparkSession.read.schema(SCHEMA).parquet(path)
