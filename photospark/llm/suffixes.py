"""Removal of repeated byte strings by depth-limited radix sort of suffixes.

All suffixes are compared through their first ``width`` bytes only, digit by
digit from the most significant one, and a group of one leaves at once:

* digit 1: the least-hash chunk of ``CHUNK`` bytes within those ``width`` bytes.
  Equal prefixes have the same chunk at the same place, and neighbouring
  suffixes share it, so one row stands for a run of suffixes;
* digit 2: all bytes that a run of suffixes covers. Where a group of digit 1
  holds one value of it, its suffixes are equal pairwise and done;
* digit 3, only in groups that are still mixed: the chunk with half of the
  bytes that are left, before or behind it. Each suffix holds one of the two,
  and again one row stands for the suffixes that hold the same;
* digit 4, only in what is mixed after that: the ``width`` bytes of each single
  suffix.

The groups that remain are exactly the repeated strings; each keeps its first
occurrence and marks the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photospark.llm import repeats
from photospark.llm.fragments import raw, slices
from photospark.llm.scratch import keep

WIDTH = 100
CHUNK = 32
#: Starts that are worked on at a time (about 100 bytes of memory each).
BLOCK = 1 << 20
#: A 64-bit code for each byte value, by a rule.
CODES = repeats.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _least(values: np.ndarray, reach: int) -> np.ndarray:
    """Place of the first smallest of each ``reach`` values in a row."""
    n = len(values) - reach + 1
    keyed = (values >> np.uint64(32) << np.uint64(32)) | np.arange(len(values), dtype=np.uint64)
    full = -(-len(values) // reach) * reach
    table = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    table[: len(values)] = keyed
    table = table.reshape(-1, reach)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[reach - 1 : reach - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def claims_of(body: np.ndarray, offsets: np.ndarray, ids: np.ndarray, width: int, chunk: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Claims (digits 1 and 2) of all suffixes of at least ``width`` bytes, block by block."""
    for base in range(0, max(len(body) - width + 1, 0), BLOCK):
        part = body[base : base + BLOCK + width - 1]
        rolling = repeats.Rolling(CODES[part])
        chunks = rolling.all(chunk)
        anchor = _least(chunks, width - chunk + 1)
        start = base + np.arange(len(anchor))
        row = np.searchsorted(offsets, start, side="right") - 1
        inside = start + width <= offsets[row + 1]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
        new &= inside
        first = np.flatnonzero(new)
        if not len(first):
            continue
        # a run ends before the next one, at the end of what fits in its text, or with the block
        fits = np.minimum(offsets[row[first] + 1] - width - base, len(anchor) - 1)
        last = np.minimum(np.append(first[1:], len(anchor)) - 1, fits)
        content = repeats.mix(rolling(first, last + width) + (anchor[first] - first).astype(np.uint64))
        text = offsets[row[first]] - base
        yield chunks[anchor[first]], content, ids[row[first]], repeats.place(first - text, last - text, anchor[first] - first)


def later(docs: DataFrame, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """(doc, place) of all byte strings of ``width`` that occur earlier (smaller id, or same document and earlier start), in runs.

    Documents without id take no part. Writes the shared claims to the shared folder.
    """
    if width - chunk + 1 > repeats.MOST_STARTS:
        raise ValueError(f"width may exceed chunk by {repeats.MOST_STARTS - 1} at most")
    named = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in slices(batches):
                body, offsets = raw(batch.column(1))
                yield from claims_of(body, offsets, batch.column(0).to_numpy(zero_copy_only=False), width, chunk)

        return repeats.combine(parts())

    def in_blocks(batch: pa.RecordBatch, row: np.ndarray, at: np.ndarray) -> Iterator[tuple[repeats.Rolling, np.ndarray, int]]:
        """Hashes of a stretch of the texts, which of ``at`` (starts in texts ``row``) lie in it, and where it starts."""
        body, offsets = raw(batch.column(1))
        whole = offsets[row] + at
        for base in range(0, len(body), BLOCK):
            here = np.flatnonzero((whole >= base) & (whole < base + BLOCK))
            if len(here):
                low = max(base - width, 0)
                yield repeats.Rolling(CODES[body[low : base + BLOCK + 2 * width]]), here, offsets[row[here]] - low

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = (width - chunk) // 2

        def parts():
            for batch in slices(batches):
                places, counts = repeats.place_lists(batch)
                row = np.repeat(np.arange(batch.num_rows), counts)
                first, last = repeats.unpack(places)
                anchor = first + repeats.anchor_of(places)
                ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)[row]
                for rolling, here, text in in_blocks(batch, row, first) if len(row) else ():
                    f, e, a, d = first[here], last[here], anchor[here], ids[here]
                    for before in (True, False):
                        s, t = (f, np.minimum(e, a - side)) if before else (np.maximum(f, a - side + 1), e)
                        some = s <= t
                        s, t, x, at = s[some], t[some], a[some], text[some]
                        key = rolling(at + x - side, at + x + chunk) if before else rolling(at + x, at + x + width - side + 1)
                        content = repeats.mix(rolling(at + s, at + t + width) + (x - s).astype(np.uint64))
                        yield key + np.uint64(before), content, d[some], repeats.place(s, t, x - s)

        return repeats.combine(parts())

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in slices(batches):
                row, start, _ = repeats.starts_of(batch)
                ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
                for rolling, here, text in in_blocks(batch, row, start) if len(row) else ():
                    at = text + start[here]
                    yield rolling(at, at + width), rolling(at, at + width // 2), ids[row[here]], repeats.place(start[here], start[here])

        return repeats.combine(parts())

    def sorted_out(rows: DataFrame) -> DataFrame:
        """doc, place, again (starts earlier too), open (other suffixes of its group may be equal to some of its own)."""
        order = Window.partitionBy("key", "content").orderBy("doc", "place")
        again = (F.col("weight") == 0) | (F.row_number().over(order) > 1)
        rows = repeats.shared(rows).withColumn("again", again)
        return rows.select("doc", "place", "again", (F.col("mixed") & ~F.col("again")).alias("open")).filter("again or open")

    found = keep(sorted_out(named.mapInArrow(claims, repeats.CLAIMS)), "suffixes")
    further = sorted_out(repeats.with_places(docs, found.filter("open").select("doc", "place")).mapInArrow(halves, repeats.CLAIMS))
    last = sorted_out(repeats.with_places(docs, further.filter("open").select("doc", "place")).mapInArrow(single, repeats.CLAIMS))
    return reduce(DataFrame.unionByName, [rows.filter("again").select("doc", "place") for rows in (found, further, last)])


def dedup(docs: DataFrame, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of all documents.

    Texts are UTF-8 bytes; a null text is empty. A byte goes if a string of
    ``width`` bytes that covers it starts earlier too; ``n_spans`` counts the
    maximal removed runs. Strings never reach across documents. Ids must be
    unique: rows that share one count as one document's copies.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            body, offsets = raw(batch.column(1))
            places, counts = repeats.place_lists(batch)
            ends = np.cumsum(counts)
            gone, spans, kept = [], [], []
            for i in range(batch.num_rows):
                text = body[offsets[i] : offsets[i + 1]]
                if counts[i]:
                    drop = repeats.covered(*repeats.unpack(places[ends[i] - counts[i] : ends[i]]), width, len(text))
                    gone.append(int(drop.sum()))
                    spans.append(int(drop[0]) + int((drop[1:] & ~drop[:-1]).sum()))
                    text = text[~drop]
                else:
                    gone.append(0)
                    spans.append(0)
                kept.append(text.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return repeats.with_places(docs, later(docs, width, chunk)).mapInArrow(
        cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
