"""Packing, SentencePiece and binary output: exact round trips with the libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from photospark.llm import bestfit, binary, sentence

ODD = [
    None, "", " ", "a", "  two  spaces ", "tab\tnew\n\nline \n x", "don't stop, they'll (go) 'SX'!?", "a b c 　d", "x\x1cy\x1f z", "<|endoftext|> and a<|endoftext|>b <s>",
    "▁already ▁▁ here ▁", "日本語 テキスト🙂 emoji🙂🙂", "é" * 50, "\x00\x01", "mixed123numbers 45,678.90", "….…,,, —dash— «q»", "word " * 3000, "ab" * 4000,
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    bits = ["the", " ", "  ", "\n", "é", "'s", ",", ".", "123", "Word", "🙂", "▁", "\t", "-", "(x)", "日本"]
    return ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(120))) for _ in range(150)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, length int, piece int").repartition(4)


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_pack_is_lossless_and_gapless(docs, ids):
    rows = bestfit.pack(docs).collect()
    for i, own in ids.items():
        at = 0
        for k, r in enumerate(sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["length"] <= 1024
            assert r["ids_crc32"] == zlib.crc32(np.array(own[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024


def test_pack_of_odd_tables(spark):
    one = spark.createDataFrame([(1, "a b")] * 3 + [(None, None)], "doc_id bigint, text string")
    assert bestfit.pack(one).count() == 4
    assert bestfit.pack(one.limit(0)).count() == 0


def optimum(items, capacity):
    """Least number of bins by exhaustive search."""
    best = [len(items)]

    def put(rest, rooms):
        if len(rooms) >= best[0]:
            return
        if not rest:
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= rest[0]}.values():
            put(rest[1:], [r - rest[0] * (k == i) for k, r in enumerate(rooms)])
        put(rest[1:], [*rooms, capacity - rest[0]])

    put(sorted(items, reverse=True), [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(6)
    for _ in range(150):
        items = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))]
        fixed, left = bestfit.reduce_instance(Counter(items), 20)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert Counter(items) == Counter(rest) + Counter(s for p, n in fixed for s in p * n)
        assert sum(n for _, n in fixed) + optimum(rest, 20) == optimum(items, 20)


def test_plan_places_every_piece_once():
    rng = random.Random(7)
    for _ in range(60):
        counts = Counter(rng.randrange(1, 65) for _ in range(rng.randrange(1, 400)))
        ranks, bins = {s: [] for s in counts}, {}
        for s, lo, n, sequence, offset in bestfit.slots(counts, 64):
            ranks[s] += range(lo, lo + n)
            for k in range(n):
                bins.setdefault(sequence + k, []).append((offset, s))
        assert all(sorted(r) == list(range(counts[s])) for s, r in ranks.items())
        for members in bins.values():
            ends = [0] + [o + s for o, s in sorted(members)]
            assert [o for o, _ in sorted(members)] == ends[:-1] and ends[-1] <= 64


def test_sentencepiece_as_the_library(docs, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: library.encode(t or "") for i, t in enumerate(texts)}
    rows = {r["doc_id"]: r for r in sentence.encode(docs).collect()}
    assert {i: r["ids"] for i, r in rows.items()} == want
    assert {i: r["decoded"] for i, r in rows.items()} == {i: library.decode(x) for i, x in want.items()}
    assert sum(r["n_corrected"] for r in rows.values()) == 0
    for r in sentence.digests(docs).collect():
        assert r["n_tokens"] == len(want[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want[r["doc_id"]])).encode()).hexdigest()
    assert sentence.digests(docs.limit(0)).count() == 0


def test_agenda_alone_equals_the_library(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    agenda = sentence.Agenda(library)
    for t in texts:
        if t and len(t) < 2000:
            assert agenda("▁" + t.replace(" ", "▁")) == library.encode(t)


def test_best_fit_decreasing_takes_the_least_room():
    rng = random.Random(8)
    for _ in range(50):
        lengths = [rng.randrange(1, 33) for _ in range(rng.randrange(80))]
        rooms, bins = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [r for r in rooms if r >= lengths[i]]
            if fits:
                rooms[rooms.index(min(fits))] -= lengths[i]
            else:
                rooms.append(32 - lengths[i])
                bins.append(i)
        got = binary.best_fit_decreasing(lengths, 32)
        assert sorted(i for b in got for i in b) == list(range(len(lengths)))
        assert sorted(32 - sum(lengths[i] for i in b) for b in got) == sorted(rooms)


def test_packed_rows_give_the_ids_back(docs, ids, tmp_path):
    rows = binary.write_packed(docs, str(tmp_path / "packed")).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    found = {}
    for r in rows:
        matrix = np.frombuffer(r["input_ids"], "<u2")
        assert len(matrix) == 1024 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] and r["position_resets"] == r["cu_seqlens"][:-1]
        assert (matrix[r["n_tokens"] :] == binary.PAD).all()
        for k, (doc, piece) in enumerate(zip(r["segment_docs"], r["segment_pieces"], strict=True)):
            found[doc, piece] = matrix[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].tolist()
    for i, own in ids.items():
        assert sum((found[k] for k in sorted(k for k in found if k[0] == i)), []) == own
    assert binary.packed(docs.limit(0)).count() == 0
    assert binary.packed(docs.select(F.lit(None).cast("bigint").alias("doc_id"), "text")).count() > 0


def test_ids_that_do_not_fit_are_refused(spark):
    docs = spark.createDataFrame([(1, "some words with large ids, unquestionably")], "doc_id bigint, text string")
    with pytest.raises(Exception, match="does not fit into <u1"):
        binary.packed(docs, dtype="<u1").collect()
    assert binary.packed(docs, dtype="<u4").first()["n_tokens"] == binary.packed(docs).first()["n_tokens"]
