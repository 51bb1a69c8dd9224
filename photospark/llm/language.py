"""Language-model scores by a weighted backoff automaton.

The model is an interpolated n-gram model over words. All its counts cover the
whole corpus and grow with it: single words, and every pair and triple that
occurs at least ``LEAST`` times in the training texts. Texts are cut into
blocks, written once as word numbers into a table bucketed by block, so that
the steps below bring answers to the blocks and move no text.

1. A block sends its words, and a short fingerprint of each of its pairs and
   triples, to the parts that their leading bits name. A part adds up and
   answers, in the order it was asked, with the counts of the words and with a
   bit for each fingerprint: may it be in the model?
2. For those only the block sends the full code with its count, and is told
   the count over the corpus. The bit errs to one side only, so the model is exact.
3. The contexts of the kept n-grams (how many arcs leave them, with what count
   in all) go the same way: each n-gram is added to its context by the block
   that comes first in its part.

So no task and no driver holds the n-grams of the corpus, and nothing is
broadcast. A block then builds the part of the automaton that its texts can
reach and walks it (``automaton``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.llm.automaton import ADDED, Automaton
from photospark.llm.fragments import slices
from photospark.llm.repeats import mix
from photospark.llm.scratch import keep, keep_by
from photospark.llm.substrings import word_codes

#: Least count of a pair or triple of the model.
LEAST = 2
#: Text bytes of a block, and least number of leading bits of a code that name its part (there are at least as many parts as blocks).
BLOCK_BYTES = 8 << 20
PART_BITS = 8
#: Bits of a fingerprint beyond the logarithm of the number of places: about 1 of 2**4 that are not in the model is asked for in full.
SPARE_BITS = 4
#: Code of the end of a text.
END = np.uint64(0x9AE16A3B2F90404F)
#: Kinds of what is asked: words, fingerprints, pairs and triples, contexts.
WORDS, PRINTS, GRAMS, CONTEXTS = 1, 2, 3, 4
ASKED = "part int, block bigint, kind int, codes binary, a binary, b binary"
TOLD = "part int, block bigint, kind int, a binary, b binary"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the lower-cased words and one end per text, offsets)."""
    words, off = word_codes(pc.ascii_lower(texts))
    n = len(off) - 1
    out = np.full(len(words) + n, END, np.uint64)
    row = np.repeat(np.arange(n), np.diff(off))
    out[np.arange(len(words)) + row] = words
    return out, off + np.arange(n + 1)


def _gram_code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Code of what ``a`` stands for followed by the word ``b``."""
    return mix(a * np.uint64(3) + mix(b))


def _order(codes: np.ndarray) -> np.ndarray:
    """Places of the codes by their leading bits, then by place (the last bits that number the places do not count): numbers sort faster than places of numbers."""
    low = np.uint64((1 << len(codes).bit_length()) - 1)
    return (np.sort((codes & ~low) | np.arange(len(codes), dtype=np.uint64)) & low).astype(np.int64)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, number of each key among them)."""
    low = len(keys).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + low > 63:
        return np.unique(keys, return_inverse=True)
    both = np.sort(keys << low | np.arange(len(keys)))
    ordered = both >> low
    new = np.append(True, ordered[1:] != ordered[:-1])
    at = np.empty(len(keys), np.int64)
    at[both & ((1 << low) - 1)] = np.cumsum(new) - 1
    return ordered[new], at


def _bounds(codes: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Ends of the parts (leading bits) in ordered codes of ``width`` bits, a 0 in front."""
    return np.append(np.searchsorted(codes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)), len(codes))


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value per stretch of ``values``: its length and its numbers (of codes the differences), byte plane by byte plane, compressed."""
    codec, out = pa.Codec("zstd", 1), []
    steps = values.copy()
    if values.dtype == np.uint64:
        steps[1:] -= values[:-1]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if a == b:
            out.append(b"")
            continue
        part = steps[a:b].copy()
        part[0] = values[a]
        out.append((b - a).to_bytes(4, "little") + codec.compress(part.view(np.uint8).reshape(b - a, -1).T.tobytes(), asbytes=True))
    return pa.array(out, pa.binary())


def _unpacked(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all values, number of values in each row)."""
    codec, width, out = pa.Codec("zstd", 1), np.dtype(kind).itemsize, [np.zeros(0, kind)]
    for value in column.to_pylist():
        n = int.from_bytes(value[:4], "little")
        if n:
            planes = np.frombuffer(codec.decompress(value[4:], width * n), np.uint8).reshape(width, n)
            part = np.ascontiguousarray(planes.T).view(kind).ravel()
            out.append(np.cumsum(part, dtype=kind) if kind is np.uint64 else part)
        else:
            out.append(out[0])
    return np.concatenate(out), np.fromiter(map(len, out[1:]), np.int64, len(out) - 1)


def _ask(block: int, kind: int, codes: np.ndarray, bits: int, *numbers: np.ndarray, width: int = 64) -> pa.Table:
    """Rows of one block: its ordered codes of ``width`` bits and up to two numbers of each, a row per part that has any."""
    bounds = _bounds(codes, bits, width)
    rows = len(bounds) - 1
    nothing = pa.nulls(rows, pa.binary())
    packed = [*[_packed(x.astype(np.int32), bounds) for x in numbers], nothing, nothing][:2]
    out = pa.table(
        [pa.array(np.arange(rows, dtype=np.int32)), pa.array(np.full(rows, block, np.int64)), pa.array(np.full(rows, kind, np.int32)), _packed(codes, bounds), *packed],
        ["part", "block", "kind", "codes", "a", "b"])
    return out.filter(pa.array(np.diff(bounds) > 0))


def _added(rows: pa.Table, *names: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """All rows of a part: (ends of the rows, sums of each number over equal codes, first of its kind), in the order of the rows."""
    codes, size = _unpacked(rows.column("codes"), np.uint64)
    order = np.argsort(codes)
    s = codes[order]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(s)))
    first = np.zeros(len(codes), bool)
    first[order[start]] = True
    sums = []
    for name in names:
        x = _unpacked(rows.column(name), np.int32)[0].astype(np.int64)
        total = np.empty_like(x)
        total[order] = np.repeat(np.add.reduceat(x[order], start), length) if len(start) else x
        sums.append(total)
    return np.append(0, np.cumsum(size)), sums, first


def _tell(rows: pa.Table, bounds: np.ndarray, *numbers: np.ndarray) -> pa.Table:
    """One row for each asking one, with numbers in the order of its codes."""
    nothing = pa.nulls(rows.num_rows, pa.binary())
    packed = [*[_packed(x, bounds) for x in numbers], nothing][:2]
    return pa.table([*[rows.column(c) for c in ("part", "block", "kind")], *packed], ["part", "block", "kind", "a", "b"])


class _Told:
    """Answers to one block, kind by kind in the order of what it asked."""

    def __init__(self, rows: pa.Table):
        self.rows = rows

    def __call__(self, kind: int, column: str, dtype: type) -> np.ndarray:
        mine = self.rows.filter(pc.equal(self.rows.column("kind"), kind)).sort_by("part")
        return _unpacked(mine.column(column), dtype)[0]


class _Block:
    """Words, pairs and triples of a block by numbers of its own; all that it asks for and is told is in an order that follows from its texts."""

    def __init__(self, row: pa.Table):
        self.key = row.column("block")[0].as_py()
        self.ids, held, lengths = (row.column(c).combine_chunks().flatten() for c in ("ids", "held", "lengths"))
        self.held = held.to_numpy(zero_copy_only=False).astype(bool)
        self.off = np.append(0, np.cumsum(lengths.to_numpy().astype(np.int64)))
        self.codes = _unpacked(row.column("vocabulary"), np.uint64)[0]
        self.words = _unpacked(row.column("words"), np.int32)[0].astype(np.int64)
        text = np.repeat(np.arange(len(self.held)), np.diff(self.off))
        train = ~self.held[text]
        self.count = np.bincount(self.words[train], minlength=len(self.codes))
        self.word_order = _order(self.codes)
        # places whose word ends a pair, and a triple, within its text
        two = np.flatnonzero(text[1:] == text[:-1]) + 1
        three = np.flatnonzero(text[2:] == text[:-2]) + 2
        size = max(1, len(self.codes))
        pairs, at = _numbered(self.words[two - 1] * size + self.words[two])
        self.pair = (pairs // size, pairs % size)
        self.pair_count = np.bincount(at[train[two]], minlength=len(pairs))
        pair_at = np.zeros(len(self.words), np.int64)
        pair_at[two] = at
        triples, at = _numbered(pair_at[three - 1] * size + self.words[three])
        tail = np.zeros(len(triples), np.int64)
        tail[at] = pair_at[three]
        self.triple = (triples // size, triples % size, tail)
        self.triple_count = np.bincount(at[train[three]], minlength=len(triples))

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of pairs and then triples by leading bits of the code, their codes and counts in it)."""
        self.pair_codes = _gram_code(self.codes[self.pair[0]], self.codes[self.pair[1]])
        codes = np.concatenate([self.pair_codes, _gram_code(self.pair_codes[self.triple[0]], self.codes[self.triple[1]])])
        order = _order(codes)
        return order, codes[order], np.concatenate([self.pair_count, self.triple_count])[order]

    def chosen(self, told: _Told) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``grams`` of those that may be in the model."""
        good = told(PRINTS, "a", np.uint8).astype(bool)
        return tuple(x[good] for x in self.grams())

    def learn(self, told: _Told) -> tuple[np.ndarray, np.ndarray]:
        """Takes the counts over the corpus in place of its own; (is each pair, triple counted here first)."""
        self.count = np.zeros(len(self.codes), np.int64)
        self.count[self.word_order] = told(WORDS, "a", np.int64)
        order = self.chosen(told)[0]
        n, first = (np.zeros(len(self.pair_count) + len(self.triple_count), np.int64) for _ in range(2))
        n[order], first[order] = told(GRAMS, "a", np.int64), told(GRAMS, "b", np.uint8)
        self.pair_count, self.triple_count = np.split(n, [len(self.pair_count)])
        return tuple(np.split(first.astype(bool), [len(self.pair_count)]))

    def contexts(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(order of words and then pairs that may be states, by code; their ordered codes); after ``learn``."""
        word = np.zeros(len(self.codes), bool)
        word[self.pair[0]] = True
        pair = np.zeros(len(self.pair_count), bool)
        pair[self.triple[0]] = True
        which = np.flatnonzero(np.concatenate([word & (self.count >= least), pair & (self.pair_count >= least)]))
        codes = np.concatenate([self.codes, self.pair_codes])[which]
        order = _order(codes)
        return which[order], codes[order]


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """A row per block of texts: ids, held out or not, numbers of words, the block's vocabulary (frequent words first) and its texts as numbers in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, done, part = 0, 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            ids, out, lengths = (pa.concat_arrays(x) for x in list(zip(*held, strict=True))[:3])
            codes, words, count = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True, return_counts=True)
            order = np.lexsort((codes, -count))
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            n = len(ids)
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in (ids, out, lengths)]
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | done], pa.int64()), *lists, _packed(codes[order], np.array([0, len(order)])), _packed(rank[words], np.array([0, len(words)]))],
                ["block", "ids", "held", "lengths", "vocabulary", "words"])

        for batch in slices(batches, block_bytes):
            n_bytes = pc.sum(pc.binary_length(batch.column(0))).as_py() or 0
            if held and size + n_bytes > block_bytes:
                yield flush()
                held, size, done = [], 0, done + 1
            codes, off = tokens(batch.column(0))
            held.append((batch.column(1), batch.column(2), pa.array(np.diff(off), pa.int64()), codes))
            size += n_bytes
        if held:
            yield flush()

    key = F.col("doc_id")
    out = F.coalesce(F.crc32(key.cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return docs.select("text", key.cast("bigint").alias("doc_id"), out.alias("held_out")).mapInArrow(
        run, "block bigint, ids array<bigint>, held array<boolean>, lengths array<bigint>, vocabulary binary, words binary")


def score(docs: DataFrame, share: float | None = None, block_bytes: int = BLOCK_BYTES, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all documents.

    Learns from documents whose crc32 of the id (as text) is no multiple of
    10; documents without id are learned from too. Pairs and triples that occur
    ``least`` times are in the model; a ``share`` of the training tokens takes
    the place of ``least`` if one is given. ``base_score`` is the
    add-``ADDED`` single-word model, ``score`` the automaton's log10
    probability. A null text is empty: its end alone. Runs jobs while it is
    built; the blocks and their counts are written to the shared folder.
    """
    blocks = keep_by(_blocks(docs, block_bytes), "text-blocks", "block")
    length = F.aggregate(F.arrays_zip("lengths", "held"), F.lit(0).cast("bigint"), lambda n, x: n + F.when(x["held"], 0).otherwise(x["lengths"]))
    every = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda n, x: n + x)
    sums = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum(length).alias("train"), F.sum(every).alias("all")).first()
    n_train, n_all = sums["train"] or 0, sums["all"] or 0
    floor = max(1, least if share is None else share * n_train)
    bits = max(PART_BITS, math.ceil(math.log2(max(1, sums["blocks"]))))
    print_bits = min(64, max(bits, math.ceil(math.log2(max(2, 2 * n_all))) + SPARE_BITS))
    enough = math.ceil(floor)

    def prints(row: pa.Table) -> pa.Table:
        block = _Block(row)
        _, codes, n = block.grams()
        # the count of a fingerprint matters up to what is enough
        short = _ask(block.key, PRINTS, codes >> np.uint64(64 - print_bits), bits, np.minimum(n, enough), width=print_bits)
        return pa.concat_tables([_ask(block.key, WORDS, block.codes[block.word_order], bits, block.count[block.word_order]), short])

    def known(rows: pa.Table) -> pa.Table:
        """Counts of words and bits of fingerprints for whoever asked; the part's number of words of the training texts."""
        mine = rows.filter(pc.equal(rows.column("kind"), WORDS))
        bounds, (n,), first = _added(mine, "a")
        types = int((first & (n > 0)).sum())
        told = [_tell(mine, bounds, n)]
        mine = rows.filter(pc.equal(rows.column("kind"), PRINTS))
        bounds, (n,), _ = _added(mine, "a")
        told.append(_tell(mine, bounds, (n >= enough).astype(np.uint8)))
        told.append(pa.table([pa.array([0], pa.int32()), pa.array([types])], ["kind", "n_types"]))
        return pa.concat_tables(told, promote_options="default").select(["part", "block", "kind", "a", "b", "n_types"])

    first_told = keep(blocks.groupBy("block").applyInArrow(prints, ASKED).groupBy("part").applyInArrow(known, TOLD + ", n_types bigint"), "word-counts")
    below = n_train + ADDED * ((first_told.agg(F.sum("n_types")).first()[0] or 0) + 1)
    first_told = first_told.filter("kind > 0").drop("n_types")

    def codes(row: pa.Table, told: pa.Table) -> pa.Table:
        block = _Block(row)
        _, ordered, n = block.chosen(_Told(told))
        return _ask(block.key, GRAMS, ordered, bits, n)

    def counts(rows: pa.Table) -> pa.Table:
        bounds, (n,), first = _added(rows, "a")
        good = n >= floor
        return _tell(rows, bounds, np.where(good, n, 0), (first & good).astype(np.uint8))

    def met(answers: DataFrame):
        return blocks.groupBy("block").cogroup(answers.groupBy("block"))

    told = first_told.unionByName(keep(met(first_told.filter(f"kind = {PRINTS}")).applyInArrow(codes, ASKED).groupBy("part").applyInArrow(counts, TOLD), "gram-counts"))

    def arcs(row: pa.Table, told: pa.Table) -> pa.Table:
        block = _Block(row)
        first2, first3 = block.learn(_Told(told))
        which, ordered = block.contexts(floor)
        n = len(block.codes)
        head = np.concatenate([block.pair[0][first2], n + block.triple[0][first3]])
        size = np.concatenate([block.pair_count[first2], block.triple_count[first3]])
        total = np.bincount(head, size, n + len(block.pair_count))
        return _ask(block.key, CONTEXTS, ordered, bits, total[which], np.bincount(head, minlength=len(total))[which])

    def states(rows: pa.Table) -> pa.Table:
        bounds, sums, _ = _added(rows, "a", "b")
        return _tell(rows, bounds, *sums)

    told = told.unionByName(keep(met(told).applyInArrow(arcs, ASKED).groupBy("part").applyInArrow(states, TOLD), "context-counts"))

    def scored(row: pa.Table, told: pa.Table) -> pa.Table:
        block, answers = _Block(row), _Told(told)
        block.learn(answers)
        which, _ = block.contexts(floor)
        n = len(block.codes)
        total, arcs = (np.zeros(n + len(block.pair_count), np.int64) for _ in range(2))
        total[which], arcs[which] = answers(CONTEXTS, "a", np.int64), answers(CONTEXTS, "b", np.int64)
        model = Automaton(block.count, below, block.pair, block.pair_count, block.triple, block.triple_count, total[:n], arcs[:n], total[n:], arcs[n:])
        start = block.off[:-1]
        known, base, full = (np.add.reduceat(x, start) for x in ((block.count > 0).astype(np.int64)[block.words], model.single[block.words], model.walk(block.words, block.off)))
        return pa.table([
            block.ids, pa.array(block.held), pa.array(np.diff(block.off)), pa.array(known), pa.array(np.full(len(start), n_train, np.int64)), pa.array(base), pa.array(full)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met(told).applyInArrow(
        scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
