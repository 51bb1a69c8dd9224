"""Encoding and decoding by a merge-type SentencePiece vocabulary.

The encoder keeps an agenda of adjacent symbol pairs whose union is a piece,
ordered by score and then by place, and merges the best pair until none is
left; symbols that are no piece become their bytes. Texts are encoded through
their distinct fragments, and every fragment is checked against the
sentencepiece library before it is used.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.llm.fragments import FragmentEncoder, held, slices

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: A text that has the space sign itself is not cut.
WHOLE = SPACE


class Agenda:
    """Merge encoder over the pieces and scores of a vocabulary."""

    def __init__(self, processor):
        n = processor.get_piece_size()
        normal = [i for i in range(n) if not (processor.is_control(i) or processor.is_byte(i) or processor.is_unknown(i) or processor.is_unused(i))]
        self.ids = {processor.id_to_piece(i): i for i in normal}
        self.scores = {processor.id_to_piece(i): processor.get_score(i) for i in normal}
        self.bytes = {int(processor.id_to_piece(i)[1:-1], 16): i for i in range(n) if processor.is_byte(i)}
        self.unknown = processor.unk_id()

    def __call__(self, text: str) -> list[int]:
        """Ids of a text that is already escaped (spaces are the space sign)."""
        symbols: list[str] = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n and (score := self.scores.get(pair := symbols[left] + symbols[right])) is not None:
                heapq.heappush(agenda, (-score, left, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, pair = heapq.heappop(agenda)
            right = after[left]
            if right >= n or not symbols[left] or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        out: list[int] = []
        for s in symbols:
            if s:
                if (i := self.ids.get(s)) is not None:
                    out.append(i)
                elif self.bytes:
                    out += [self.bytes[b] for b in s.encode()]
                else:
                    out.append(self.unknown)
        return out


def _cuts(agenda: Agenda) -> np.ndarray:
    """Cut between ASCII characters that are neighbours in no piece, and before a space after any other character."""
    cuts = np.zeros((256, 256), bool)
    cuts[:128, :128] = True
    for piece in agenda.ids:
        shown = piece.replace(SPACE, " ")
        for a, b in zip(shown, shown[1:], strict=False):
            if ord(a) < 128 and ord(b) < 128:
                cuts[ord(a), ord(b)] = False
    inner = any(SPACE in piece.lstrip(SPACE) for piece in agenda.ids)
    cuts[128:, 32] = not inner
    return cuts


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>), decoded, n_corrected per document.

    Null texts are empty (no ids, empty decoded text). ``decoded`` is what the
    library decodes from the ids. ``n_corrected`` counts fragments in which the
    agenda and the library differed; the library's ids are then used.
    """
    def rows(ids, off, decoded, wrong):
        return [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(decoded, pa.string()), pa.array(wrong, pa.int64())]

    return _encoded(docs, vocabulary, rows, ["ids", "decoded", "n_corrected"], "doc_id bigint, ids array<int>, decoded string, n_corrected bigint")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """As ``encode``, with the number of ids and SHA-256 of the ids (decimal, comma-joined) and of the decoded text."""
    def rows(ids, off, decoded, wrong):
        names = pc.cast(pa.array(ids), pa.string())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(off, pa.int32()), names), ",").to_pylist()
        return [
            pa.array(np.diff(off)), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined]),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]), pa.array(wrong, pa.int64())]

    return _encoded(docs, vocabulary, rows, ["n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"],
                    "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_corrected bigint")


def _encoded(docs: DataFrame, vocabulary: str | None, rows, names: list[str], schema: str) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)

    def made():
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        agenda = Agenda(library)
        lead = library.encode("\n")
        wrong: set[str] = set()

        def checked(fragments: list[str]) -> list[list[int]]:
            # a new line is part of no piece, so it shields the fragment from the library's dummy prefix
            theirs = library.encode(["\n" + f for f in fragments], num_threads=1)
            out = []
            for f, t in zip(fragments, theirs, strict=True):
                own = agenda(f.replace(" ", SPACE))
                if own != t[len(lead):]:
                    wrong.add(f)
                    own = t[len(lead):]
                out.append(own)
            return out

        return library, FragmentEncoder(checked, _cuts(agenda), WHOLE), wrong

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, encoder, wrong = held(("pieces", vocabulary), made)
        for batch in slices(batches):
            text = batch.column(batch.schema.get_field_index("text"))
            given = pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
            ids, off = encoder(given)
            parts = np.split(ids, off[1:-1])
            decoded = library.decode([p.tolist() for p in parts], num_threads=1) if len(parts) else []
            corrected = [sum(t.count(f) for f in wrong) for t in given.to_pylist()] if wrong else [0] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), *rows(ids, off, decoded, corrected)], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
