"""Token ids of texts by a byte-level merge vocabulary of the ``tokenizers`` library, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from photospark.llm.fragments import FragmentEncoder, held, slices

#: The id that ends each document.
END = 2
#: Distinct fragments remembered: their ids are short arrays.
REMEMBERED = 500_000
#: Texts with white space beyond ASCII, file separators or the vocabulary's own special token are encoded whole.
WHOLE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|endoftext\|>"


def _cuts() -> np.ndarray:
    """The vocabulary's pattern never joins a character and white space after it, nor a letter and punctuation after it."""
    cuts = np.zeros((256, 256), bool)
    space = [9, 10, 11, 12, 13, 32]
    letters = [*range(65, 91), *range(97, 123)]
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    cuts[np.ix_([c for c in range(256) if c not in space], space)] = True
    cuts[np.ix_(letters, signs)] = True
    return cuts


def encoder(vocabulary: str) -> FragmentEncoder:
    """Encoder of texts by the vocabulary file, without added ids; it holds one slice and a bounded memory of fragments."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    return FragmentEncoder(lambda part: [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)], _cuts(), WHOLE, REMEMBERED)


def pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int, end: int = END) -> Iterator[tuple]:
    """(doc_id, ids, piece lengths, piece starts) arrays per slice of texts.

    Each document is its ids and ``end``. Documents longer than ``capacity``
    are cut into pieces of that length, the first being shorter if need be.
    Yields (doc ids of the pieces, piece numbers, starts within the document,
    lengths, all ids, starts within all ids).
    """
    encode = held(("bytes", vocabulary), lambda: encoder(vocabulary))
    for batch in slices(batches):
        plain, off = encode(batch.column(batch.schema.get_field_index("text")))
        docs = np.arange(batch.num_rows)
        size = np.diff(off) + 1
        ids = np.full(len(plain) + len(docs), end, np.uint32)
        ids[np.arange(len(plain)) + np.repeat(docs, size - 1)] = plain
        count = -(-size // capacity)
        first = size - (count - 1) * capacity
        doc = np.repeat(docs, count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
        length = np.where(piece == 0, first[doc], capacity)
        doc_id = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(doc))
        yield doc_id, piece, start, length, ids, (off[:-1] + docs)[doc] + start
