"""Encode whole texts through their distinct fragments.

A text is cut where no token can reach across (a table over pairs of
neighbouring bytes says where), so the ids of a text are the ids of its
fragments in order. Fragments recur, so only distinct ones are encoded and the
rest is Arrow and NumPy indexing. Texts for which the table does not hold are
encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time, and distinct fragments remembered between such slices.
SLICE_BYTES = 6 << 20
REMEMBERED = 250_000


def held(key: tuple, make: Callable):
    """What ``make`` gives, kept in the worker process for its next tasks with this key; another key takes its place.

    Kernels travel by value, so their own module would be new in every task.
    """
    import sys
    import types

    place = sys.modules.setdefault("photospark_worker", types.ModuleType("photospark_worker"))
    if getattr(place, "key", None) != key:
        place.key = place.value = None
        place.value = make()
        place.key = key
    return place.value


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text of each holds about ``limit`` bytes (or one row); null texts become empty."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        text = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        batch = pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a large_string array without nulls."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, off - off[0]


class FragmentEncoder:
    """Ids of texts by ``encode``, called with lists of distinct fragments.

    ``cuts[a, b]`` tells whether a text may be cut between bytes a and b;
    ``whole`` is a regular expression of texts that may not be cut at all.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], cuts: np.ndarray, whole: str, remembered: int = REMEMBERED):
        self._encode, self._cuts, self._whole, self._remembered = encode, cuts, whole, remembered
        self._rows: dict[str, int] = {}
        self._lists: list[np.ndarray] = []

    def _look_up(self, distinct: list[str]) -> list[np.ndarray]:
        new = [f for f in distinct if f not in self._rows]
        for f, ids in zip(new, self._encode(new), strict=True):
            self._rows[f] = len(self._lists)
            self._lists.append(np.array(ids, np.uint32))
        found = [self._lists[self._rows[f]] for f in distinct]
        if len(self._rows) > self._remembered:
            # those of the last slice stay, hence the frequent ones
            self._rows, self._lists = dict(zip(distinct, range(len(distinct)), strict=True)), list(found)
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other as uint32, offsets of the texts in them)."""
        body, off = raw(texts)
        n = len(texts)
        if not len(body):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        start = np.zeros(len(body), bool)
        start[1:] = self._cuts[body[:-1], body[1:]]
        uncut = np.flatnonzero(pc.match_substring_regex(texts, self._whole).to_numpy(zero_copy_only=False))
        for i in uncut:
            start[off[i] : off[i + 1]] = False
        start[off[:-1][off[:-1] < off[1:]]] = True
        places = np.flatnonzero(start)
        frags = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(np.append(places, len(body))), pa.py_buffer(body)).dictionary_encode()
        lists = self._look_up(frags.dictionary.to_pylist())
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate(lists)
        codes = frags.indices.to_numpy()
        sizes = size[codes]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat((np.cumsum(size) - size)[codes] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(places, off)]
