"""Removal of repeated passages by recompression.

Words get names, and rounds shorten each text by naming maximal runs of equal
symbols and pairs of symbols (a name's hash tells whether it may be the left or
the right half of a pair). A name is a hash of what it names, so each round
names alike in all documents without an exchange. With every symbol goes its
*context*, the words on which its existence depends: a window that contains the
context contains the symbol wherever else it occurs. Each window is anchored
at the first symbol of the highest level that it determines; Spark groups the
anchors of all documents, symbols that occur once rule out their windows, and
the rest is verified by hashes of whole stretches and, where stretches differ,
of the single windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photospark.llm import repeats
from photospark.llm.fragments import slices
from photospark.llm.scratch import keep, keyed

WIDTH = 35
#: Rounds of naming; more give fewer, longer symbols with wider contexts.
ROUNDS = 6


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit codes of all words, offsets of the texts in them)."""
    words = pc.ascii_split_whitespace(texts)
    offsets = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(flat.dictionary))
    empty = pc.index(flat.dictionary, pa.scalar("", flat.dictionary.type)).as_py()
    codes = names[flat.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    offsets = offsets - offsets[0]
    if empty >= 0:
        real = flat.indices.to_numpy() != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return codes, offsets


def _levels(codes: np.ndarray, offsets: np.ndarray, rounds: int) -> list[tuple[np.ndarray, ...]]:
    """Per level (names, starts, context starts, context ends) of the symbols of all texts, in order."""
    n = len(codes)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    name, start = codes, np.arange(n)
    stop, low, high, own = start + 1, start, start + 1, doc
    out = [(name, start, low, high)]
    codes_ = np.append(codes, np.uint64(0))
    for r in range(rounds):
        # runs: a symbol depends on both neighbours being other symbols, which one differing word shows
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(name)) - 1
        length = last - first + 1
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
        here, s, e = own[first], start[first], stop[last]
        edge_left, edge_right = (first == 0) | (own[before] != here), (last == len(name) - 1) | (own[after] != here)
        lo = np.minimum(low[first], s - 1)
        hi = np.maximum(high[last], e + 1)
        alike = ~edge_left & (codes_[s - 1] == codes_[e - 1])
        lo = np.where(alike, np.minimum(lo, low[before]), lo)
        alike = ~edge_right & (codes_[np.minimum(e, n)] == codes_[s])
        hi = np.where(alike, np.maximum(hi, high[after]), hi)
        name = np.where(length > 1, repeats.mix(name[first] + repeats.mix(length.astype(np.uint64) + np.uint64(1 << 32))), name[first])
        start, stop, low, high, own = s, e, lo, hi, here
        # pairs: left symbols followed by right ones; an unpaired symbol depends on its neighbour
        right = (repeats.mix(name + np.uint64(r + 1)) & np.uint64(1)).astype(bool)
        m = len(name)
        paired = np.zeros(m, bool)
        paired[:-1] = ~right[:-1] & right[1:] & (own[:-1] == own[1:])
        second = np.zeros(m, bool)
        second[1:] = paired[:-1]
        nxt, prv = np.minimum(np.arange(m) + 1, m - 1), np.maximum(np.arange(m) - 1, 0)
        at_end, at_start = own[nxt] != own, own[prv] != own
        if m:
            at_end[-1], at_start[0] = True, True
        hi = np.where(right, high, np.where(at_end, stop + 1, high[nxt]))
        lo = np.where(~right, low, np.where(at_start, start - 1, low[prv]))
        hi, lo = np.where(paired, high[nxt], hi), np.where(paired, low, lo)
        stop = np.where(paired, stop[nxt], stop)
        name = np.where(paired, repeats.mix(name * np.uint64(3) + repeats.mix(name[nxt] + np.uint64(r))), name)
        kept = ~second
        name, start, stop, low, high, own = name[kept], start[kept], stop[kept], lo[kept], hi[kept], own[kept]
        out.append((name, start, low, high))
    return out


def claims_of(codes: np.ndarray, offsets: np.ndarray, ids: np.ndarray, width: int, rounds: int) -> tuple[np.ndarray, ...]:
    """Claims of all windows of the texts."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    none = np.zeros(0, np.int64)
    if not len(row):
        return none.view(np.uint64), none.view(np.uint64), none, none
    window = offsets[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    levels = _levels(codes, offsets, rounds)
    anchor = np.zeros(len(window), np.uint64)
    anchor_at = np.full(len(window), -1, np.int64)
    level_of = np.full(len(window), -1, np.int8)
    open_ = np.arange(len(window))
    for level in range(len(levels) - 1, -1, -1):
        name, start, low, high = levels[level]
        p = window[open_]
        i = np.minimum(np.searchsorted(low, p), len(low) - 1)
        inside = (low[i] >= p) & (high[i] <= p + width)
        hit, i = open_[inside], i[inside]
        anchor[hit], anchor_at[hit], level_of[hit] = repeats.mix(name[i] + np.uint64(level)), start[i], level
        open_ = open_[~inside]
        if not len(open_):
            break
    new = np.ones(len(window), bool)
    new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (level_of[1:] != level_of[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    a, b = window[first], window[last]
    content = repeats.mix(repeats.Rolling(codes)(a, b + width) + (anchor_at[first] - a).astype(np.uint64))
    base = offsets[row[first]]
    return anchor[first], content, ids[row[first]], repeats.place(a - base, b - base)


def repeated(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """(doc, place) of all windows of ``width`` words that occur more than once, in runs.

    Documents without id take no part. The claims are shuffled once by anchor;
    what is left undecided (windows at the ends of common stretches) is decided
    window by window. Writes the shared claims to the shared folder.
    """
    if width > repeats.MOST_STARTS:
        raise ValueError(f"windows of at most {repeats.MOST_STARTS} words")
    named = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in slices(batches):
                codes, offsets = word_codes(batch.column(1))
                yield claims_of(codes, offsets, batch.column(0).to_numpy(zero_copy_only=False), width, rounds)

        return repeats.combine(parts())

    same = Window.partitionBy("key", "content")
    found = repeats.shared(named.mapInArrow(claims, repeats.CLAIMS)).withColumns({
        "copies": F.sum("weight").over(same), "nth": F.row_number().over(same.orderBy("doc", "place"))})
    again = (F.col("weight") == 0) | (F.col("copies") > 1)
    # of stretches that occur more than once, one stands in when single windows are compared
    found = keep(found.select("doc", "place", again.alias("again"), (F.col("mixed") & (F.col("weight") > 0) & (~again | (F.col("nth") == 1))).alias("open")), "claims")
    asked = found.filter("open").select("doc", F.when(F.col("again"), F.col("place").bitwiseOR(F.lit(3))).otherwise(F.col("place").bitwiseAND(F.lit(-4))).alias("place"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in slices(batches):
                row, start, weight = repeats.starts_of(batch)
                if not len(row):
                    continue
                codes, offsets = word_codes(batch.column(1))
                at = offsets[row] + start
                rolling = repeats.Rolling(codes)
                # a copied stretch counts twice: it is repeated, and so is any window equal to one of its own
                twice = np.flatnonzero(weight == 3)
                every = np.concatenate([np.arange(len(at)), twice])
                at, row, start = at[every], row[every], start[every]
                yield rolling(at, at + width), rolling(at, at + width // 2), pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)[row], repeats.place(start, start)

        return repeats.combine(parts())

    single = repeats.with_places(docs, asked).mapInArrow(windows, repeats.CLAIMS)
    group = Window.partitionBy("key", "content")
    single = repeats.dealt(single).withColumn("total", F.sum(repeats.weight_of(F.col("place"))).over(group))
    single = single.filter((repeats.weight_of(F.col("place")) == 0) | (F.col("total") > 1)).select("doc", "place")
    return found.filter("again").select("doc", "place").unionByName(single)


def dedup(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text of the kept words, joined by a space) of all documents.

    Words are runs without ASCII white space. A word goes if some window of
    ``width`` words that covers it starts anywhere else too. A null text has no
    words. Ids must be unique: rows that share one count as copies of each
    other and lose the same words.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            places, counts = repeats.place_lists(batch)
            ends = np.cumsum(counts)
            total, gone, kept = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.encode().split()
                if counts[i]:
                    first, last = repeats.unpack(places[ends[i] - counts[i] : ends[i]])
                    drop = repeats.covered(first, last, width, len(words))
                    left = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                else:
                    left = words
                total.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])

    return repeats.with_places(docs, repeated(docs, width, rounds)).mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without repeated passages: texts that lose words become their kept words joined by a space, others stay as they are.

    ``n_chars``, if there is one, follows the text. All rows and columns stay,
    and rows with a null or repeated id lose their own repeated words.
    """
    keys = keyed(docs)
    left = dedup(keys.select("doc_id", "text"), width).filter("n_removed > 0").select("doc_id", "kept")
    rows = keys.select("doc_id", "row").join(left, "doc_id", "left")
    new = {"text": F.coalesce("kept", F.col("row")["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
