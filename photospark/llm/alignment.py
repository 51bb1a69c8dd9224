"""Alignment of the tokens of two vocabularies over the same bytes.

Tokens of both sides that overlap belong to one group; groups end where tokens
of both end. Every token points to the token that reaches farthest right among
those that overlap it (itself included); doubling all pointers at once, in
vectors, takes each token to the last one of its group, which labels it.

Texts are aligned through their distinct fragments: where no token of either
side can reach across, a group ends too, so the groups of a text are those of
its fragments in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.llm import bytebpe, sentence
from photospark.llm.fragments import held, raw, slices
from photospark.llm.scratch import keep

#: Bytes of text of a block, and distinct fragments remembered between blocks.
SLICE_BYTES = 2 << 20
REMEMBERED = 150_000
#: Fragments that are aligned at a time, and pairs that are expanded at a time.
ALIGNED = 20_000
EXPANDED = 300_000
#: Bits of a token id of side B in the code of a pair.
BITS = 32


def labels(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every token of two sides that cover the same bytes, by pointer jumping.

    ``end_a`` and ``end_b`` are the rising ends of the tokens; both sides start
    at 0 and end at the same byte. Tokens of no bytes do not occur.
    """
    ends = np.concatenate([end_a, end_b])
    n, m = len(end_a), len(end_b)
    # the token of the other side that holds the last byte of a token reaches farthest of those that overlap it
    other = np.concatenate([n + np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)])
    own = np.arange(n + m)
    # of two that end together, the one of side A is the last of the group
    to = np.where(ends[other] > ends, other, np.where((own >= n) & (ends[other] == ends), other, own))
    while not np.array_equal(after := to[to], to):
        to = after
    last = np.flatnonzero(to == own)
    number = np.zeros(n + m, np.int64)
    number[last[np.argsort(ends[last], kind="stable")]] = np.arange(len(last))
    group = number[to]
    return group[:n], group[n:]


class Aligned(NamedTuple):
    """Alignment of a run of fragments: counts per fragment, text of the groups, and distinct id pairs with their links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    listed: list[str | None]
    pairs: np.ndarray
    links: np.ndarray
    bounds: np.ndarray


def _counted(owner: np.ndarray, codes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, code), sorted, with the sum of the weights."""
    order = np.lexsort((codes, owner))
    owner, codes, weight = owner[order], codes[order], weight[order]
    first = np.ones(len(codes), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])
    at = np.flatnonzero(first)
    return owner[at], codes[at], np.add.reduceat(weight, at) if len(at) else weight[:0]


def _linked(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, owner: np.ndarray, n: int):
    """(fragment, pair, links) of all groups; ids are counted within their group before they are paired, and groups are paired in portions."""
    ga, a, wa = _counted(group_a, ids_a, np.ones(len(ids_a), np.int64))
    gb, b, wb = _counted(group_b, ids_b, np.ones(len(ids_b), np.int64))
    first, count = np.searchsorted(gb, np.arange(n)), np.bincount(gb, minlength=n)
    size = count[ga]
    ends = np.cumsum(size)
    found, at = [], 0
    while at < len(ga):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + EXPANDED, side="right")))
        rows = np.repeat(np.arange(at, to), size[at:to])
        there = first[ga[rows]] + np.arange(len(rows)) - np.repeat(ends[at:to] - size[at:to] - before, size[at:to])
        found.append(_counted(owner[ga[rows]], (a[rows] << BITS) | b[there], wa[rows] * wb[there]))
        at = to
    if len(found) == 1:
        return found[0]
    joined = [np.concatenate(part) for part in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    return _counted(*joined)


class Aligner:
    """Aligns fragments under a byte-level vocabulary (A) and a SentencePiece one (B)."""

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(byte_vocabulary)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary)
        self._lead = len(self._b.encode("\n"))
        shown = _byte_values()
        size = self._a.get_vocab_size()
        # added tokens keep their own text
        bytes_a = [bytes(shown[c] for c in t) if all(c in shown for c in t) else t.encode() for t in map(self._a.id_to_token, range(size))]
        pieces = map(self._b.id_to_piece, range(self._b.get_piece_size()))
        bytes_b = [bytes([int(p[1:-1], 16)]) if self._b.is_byte(i) else p.replace(sentence.SPACE, " ").encode() for i, p in enumerate(pieces)]
        self._spelt = [_Spelling(bytes_a), _Spelling(bytes_b)]
        agenda = sentence.Agenda(self._b)
        self.cuts = bytebpe._cuts() & sentence._cuts(agenda)
        self.whole = bytebpe.WHOLE.rpartition("|")[0] + "|" + sentence.WHOLE

    def __call__(self, fragments: list[str]) -> Aligned:
        """Fragments whose tokens do not spell them have no tokens and no text of groups."""
        n = len(fragments)
        a = [e.ids for e in self._a.encode_batch_fast(fragments, add_special_tokens=False)]
        # a new line is part of no piece, so it shields the fragment from the library's own leading space
        b = [ids[self._lead:] for ids in self._b.encode(["\n" + f for f in fragments], num_threads=1)]
        body, off = raw(pa.array(fragments, pa.large_string()))
        good, sides = np.ones(n, bool), []
        for side, spelt in zip((a, b), self._spelt, strict=True):
            count = np.fromiter(map(len, side), np.int64, n)
            ids = np.fromiter(chain.from_iterable(side), np.int64, int(count.sum()))
            good &= spelt.same(ids, count, body, off)
            sides.append((ids, count))
        (ids_a, n_a), (ids_b, n_b) = ((ids[np.repeat(good, count)], count * good) for ids, count in sides)
        # all fragments one after the other: their bounds are ends on both sides
        group_a, group_b = labels(*(np.cumsum(x.length[ids]) for x, ids in zip(self._spelt, (ids_a, ids_b), strict=True)))
        groups = int(group_a[-1]) + 1 if len(group_a) else 0
        owner = np.zeros(groups, np.int64)
        owner[group_a] = np.repeat(np.arange(n), n_a)
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        n_groups = np.bincount(owner, minlength=n)
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, owner, in_a * in_b)
        texts = self._texts(ids_a, in_a, ids_b, in_b)
        cut = np.concatenate([[0], np.cumsum(n_groups)])
        listed = [";".join(texts[cut[i] : cut[i + 1]]) if g else None for i, g in enumerate(good.tolist())]
        at, pairs, links = _linked(group_a, ids_a, group_b, ids_b, owner, groups)
        return Aligned(n_a, n_b, n_groups, n_links, listed, pairs, links, np.searchsorted(at, np.arange(n + 1)))

    @staticmethod
    def _texts(ids_a, in_a, ids_b, in_b) -> list[str]:
        def joined(ids, count):
            off = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            return pc.binary_join(pa.ListArray.from_arrays(off, pc.cast(pa.array(ids), pa.string())), ",")

        return pc.binary_join_element_wise(joined(ids_a, in_a), joined(ids_b, in_b), "|").to_pylist()


def _byte_values() -> dict[str, int]:
    """Byte of each sign of a byte-level vocabulary: printable Latin-1 bytes show as themselves, the rest as signs from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class _Spelling:
    """The bytes of the tokens of a vocabulary, for comparing runs of tokens with texts."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self._off = np.concatenate([[0], np.cumsum(self.length)])
        self._flat = np.frombuffer(b"".join(tokens), np.uint8)

    def same(self, ids: np.ndarray, count: np.ndarray, body: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Whether the tokens of each text (``count`` of them) spell it; texts are not empty."""
        total = np.concatenate([[0], np.cumsum(self.length[ids])])[np.concatenate([[0], np.cumsum(count)])]
        size = np.diff(off)
        fits = np.diff(total) == size
        told = self._flat[_rows(self._off, ids[np.repeat(fits, count)])]
        wrong = told != body[np.repeat(fits, size)]
        out = fits.copy()
        out[np.repeat(np.flatnonzero(fits), size[fits])[wrong]] = False
        return out


class _Memory:
    """Alignments of fragments as growing columns. Past ``remembered`` rows only those of the last slice stay, hence the frequent ones."""

    def __init__(self, aligner: Aligner, remembered: int = REMEMBERED):
        self._aligner, self._remembered = aligner, remembered
        self._row: dict[str, int] = {}
        self._counts, self._listed, self._off = np.zeros((0, 4), np.int64), [], np.zeros(1, np.int64)
        self._pairs, self._links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, fragments: list[str]) -> tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        """(counts, texts of groups, offsets into pairs, pairs, links) of distinct fragments."""
        missing = [f for f in fragments if f not in self._row]
        parts = [self._aligner(missing[at : at + ALIGNED]) for at in range(0, len(missing), ALIGNED)]
        if parts:
            self._row.update(zip(missing, range(len(self._row), len(self._row) + len(missing)), strict=True))
            self._counts = np.concatenate([self._counts, *(np.stack([x.n_a, x.n_b, x.n_groups, x.n_links], axis=1) for x in parts)])
            for x in parts:
                self._listed += x.listed
            self._off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(self._off), *(np.diff(x.bounds) for x in parts)]))])
            self._pairs = np.concatenate([self._pairs, *(x.pairs for x in parts)])
            self._links = np.concatenate([self._links, *(x.links for x in parts)])
        at = np.fromiter(map(self._row.__getitem__, fragments), np.int64, len(fragments))
        entries = _rows(self._off, at)
        off = np.concatenate([[0], np.cumsum(np.diff(self._off)[at])])
        out = self._counts[at], [self._listed[i] for i in at.tolist()], off, self._pairs[entries], self._links[entries]
        if len(self._row) > self._remembered:
            self._row = dict(zip(fragments, range(len(fragments)), strict=True))
            self._counts, self._listed, self._off, self._pairs, self._links = out
            self._listed = list(self._listed)
        return out


_BLOCKS = "block string, pairs array<bigint>, documents array<bigint>, body binary"


def _pack(**arrays: np.ndarray) -> bytes:
    import io

    import zstandard

    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(out.getbuffer())


def _unpack(body: bytes) -> dict[str, np.ndarray]:
    import io

    import zstandard

    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(body))) as stored:
        return {k: stored[k] for k in stored.files}


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _rows(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of the entries of rows ``at`` of a table with offsets ``off``, row after row."""
    size = np.diff(off)[at]
    ends = np.cumsum(size)
    return np.repeat(off[:-1][at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _block(ids: pa.Array, text: pa.Array, aligner: Aligner, memory: _Memory) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(distinct pairs of a slice, documents of the slice that hold each, the documents and fragments behind them)."""
    n = len(text)
    spaced = pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
    body, off = raw(spaced)
    start = np.zeros(len(body), bool)
    if len(body):
        start[1:] = aligner.cuts[body[:-1], body[1:]]
    for i in np.flatnonzero(pc.match_substring_regex(spaced, aligner.whole).to_numpy(zero_copy_only=False)):
        start[off[i] : off[i + 1]] = False
    start[off[:-1][off[:-1] < off[1:]]] = True
    places = np.flatnonzero(start)
    frags = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(np.append(places, len(body))), pa.py_buffer(body)).dictionary_encode()
    counts, listed, pair_off, flat, links = memory(frags.dictionary.to_pylist())
    codes = frags.indices.to_numpy()
    size = np.diff(np.searchsorted(places, off))
    bad = np.array([text is None for text in listed], bool)
    if bad.any():
        spoilt = np.zeros(n, bool)
        spoilt[np.repeat(np.arange(n), size)[bad[codes]]] = True
        codes, size = codes[~np.repeat(spoilt, size)], np.where(spoilt, 0, size)
    bounds = np.concatenate([[0], np.cumsum(size)])
    sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[codes], axis=0)])
    totals = sums[bounds[1:]] - sums[bounds[:-1]]
    named = list(map(listed.__getitem__, codes.tolist()))
    cut = bounds.tolist()
    shas = [hashlib.sha256(";".join(named[x:y]).encode()).digest() if x < y else bytes(32) for x, y in zip(cut, cut[1:], strict=False)]
    # a document's distinct fragments, with how often they occur
    key, occurs = np.unique(np.repeat(np.arange(n), size) * max(len(listed), 1) + codes, return_counts=True)
    doc, frag = np.divmod(key, max(len(listed), 1))
    held = np.bincount(doc, minlength=n)
    pairs, number = np.unique(flat, return_inverse=True)
    number = number.reshape(-1)
    holders = np.zeros(len(pairs), np.int64)
    # in portions of documents, so that what is expanded stays bounded (or one document)
    ends = np.cumsum(held)
    width = np.concatenate([[0], np.cumsum(np.diff(pair_off)[frag])])[np.concatenate([[0], ends])]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(width, width[at] + EXPANDED, side="right")) - 1)
        part = frag[ends[at] - held[at] : ends[to - 1]]
        owner = np.repeat(np.repeat(np.arange(to - at), held[at:to]), np.diff(pair_off)[part])
        found = np.sort(owner * len(pairs) + number[_rows(pair_off, part)])
        first = np.ones(len(found), bool)
        first[1:] = found[1:] != found[:-1]
        holders += np.bincount(found[first] % max(len(pairs), 1), minlength=len(pairs))
        at = to
    used = holders > 0
    stored = _pack(
        doc_id=ids.fill_null(0).to_numpy(), no_id=ids.is_null().to_numpy(zero_copy_only=False), totals=totals, sha=np.frombuffer(b"".join(shas), np.uint8),
        held=_narrow(held), frag=_narrow(frag), occurs=_narrow(occurs), width=_narrow(np.diff(pair_off)), number=_narrow((np.cumsum(used) - 1)[number] * used[number]),
        links=_narrow(links * used[number]))
    return pairs[used], holders[used], stored


def _blocks(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        def made():
            aligner = Aligner(byte_vocabulary, piece_vocabulary)
            return aligner, _Memory(aligner)

        aligner, memory = held(("aligned", byte_vocabulary, piece_vocabulary), made)
        for batch in slices(batches, SLICE_BYTES):
            pairs, holders, body = _block(batch.column(0), batch.column(1), aligner, memory)
            one = pa.array([0, len(pairs)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(one, pa.array(pairs)), pa.ListArray.from_arrays(one, pa.array(holders)),
                 pa.array([body], pa.binary())], ["block", "pairs", "documents", "body"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keep(rows.mapInArrow(run, _BLOCKS), "aligned")


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def align(docs: DataFrame, byte_vocabulary: str | None = None, piece_vocabulary: str | None = None) -> DataFrame:
    """Groups of tokens of two vocabularies per document, and how its links fare in the whole corpus.

    Side A encodes a space and the text by the byte-level vocabulary, side B the
    text by the SentencePiece one, special tokens' strings as plain text. Tokens
    lie on bytes; bytes where tokens of both sides end cut them into groups; a
    link is a pair of occurrences (A, B) in one group. The count of an id pair
    is the number of documents in which it is linked.

    Per row: n_a, n_b, n_groups, n_links, n_best (links whose pair has the
    highest count of all pairs of its A id, ties included), count_sum (counts
    added over links) and groups_sha256 of ``a1,a2|b1;a3|b2,b3``. Texts that are
    null or empty, or that the tokens of a side do not spell, have zeros and ''.
    Repeated rows and ids are documents of their own; null ids stay null.

    Texts are encoded once. A slice of them (some MB, or one longer text) is
    written as a block with its distinct pairs; Spark adds the counts of pairs
    over blocks, and sends every block the counts of its own pairs.
    """
    if byte_vocabulary is None or piece_vocabulary is None:
        import public_tokenizers

        byte_vocabulary = byte_vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        piece_vocabulary = piece_vocabulary or public_tokenizers.path(sentence.VOCABULARY)
    blocks = _blocks(docs, byte_vocabulary, piece_vocabulary)
    asked = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "documents")).alias("place", "p")).select(
        "block", "place", F.col("p.pairs").alias("pair"), F.col("p.documents").alias("documents"))
    counts = keep(pair_counts(asked), "pair-counts")
    answers = asked.select(F.col("block").alias("of"), "place", "pair").join(counts, "pair").select("of", "place", "count", "best")
    return blocks.select("block", "body").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_scored, RESULT)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, count, best: documents of each pair, and whether none with the same A id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("documents").alias("count"))
    highest = counts.groupBy(F.shiftright("pair", BITS).alias("a")).agg(F.max("count").alias("highest"))
    return counts.withColumn("a", F.shiftright("pair", BITS)).join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _scored(block: pa.Table, answers: pa.Table) -> pa.Table:
    """Rows of the documents of a block, from the counts of its pairs."""
    x = _unpack(block.column("body")[0].as_py())
    place = answers.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = answers.column("count").to_numpy(), answers.column("best").to_numpy()
    n = len(x["doc_id"])
    ends = np.concatenate([[0], np.cumsum(x["held"].astype(np.int64))])
    cut = np.concatenate([[0], np.cumsum(x["width"].astype(np.int64))])
    frag, occurs, links = x["frag"].astype(np.int64), x["occurs"].astype(np.int64), x["links"].astype(np.int64)
    out = []
    # a fragment is worth its links times what their pairs are worth; pairs of no document have no links
    for worth in (best, count):
        total = np.concatenate([[0], np.cumsum(links * (worth[x["number"]] if len(worth) else 0))])
        total = np.concatenate([[0], np.cumsum((total[cut[1:]] - total[cut[:-1]])[frag] * occurs)])
        out.append(total[ends[1:]] - total[ends[:-1]])
    shas, none = x["sha"].tobytes(), (x["held"] == 0).tolist()
    listed = ["" if none[i] else shas[32 * i : 32 * i + 32].hex() for i in range(n)]
    totals = x["totals"]
    return pa.table({
        "doc_id": pa.array(x["doc_id"], pa.int64(), mask=x["no_id"]), "n_a": totals[:, 0], "n_b": totals[:, 1], "n_groups": totals[:, 2],
        "n_links": totals[:, 3], "n_best": out[0], "count_sum": out[1], "groups_sha256": pa.array(listed, pa.string())})
